"""Readers, writers and the stream."""

import gzip
import json

import pytest

from rankloom.sources import trec
from rankloom.streaming import judgments


def test_runs_round_trip(spark, tmp_path):
    rows = [("00101", "x", "d1", 0, 2.5), ("00101", "x", "d2", 1, 2.5), ("7", "y", "d1", 0, -1.0)]
    runs = spark.createDataFrame(rows, "qid string, source string, docid string, rank int, score double")
    trec.write_runs(runs, f"{tmp_path}/out")
    lines = spark.read.text(f"{tmp_path}/out")
    assert sorted(map(tuple, trec.parse_runs(lines.select("value")).collect())) == sorted(rows)
    with pytest.raises(Exception):
        trec.write_runs(runs, f"{tmp_path}/out")


def test_lenient_reader(spark, tmp_path):
    with gzip.open(tmp_path / "bm25.run.gz", "wt") as f:
        f.write("q Q0 d9 5 1.5 tag\nshort line\nq Q0 d1 2 0.5 tag extra\n")
    got = sorted(map(tuple, trec.read_runs(spark, str(tmp_path / "bm25.run.gz")).collect()))
    assert got == [("q", "bm25", "d1", 0, 0.5), ("q", "bm25", "d9", 1, 1.5)]
    (tmp_path / "bad.run").write_text("q Q0 d x 1.0 tag\n")
    with pytest.raises(Exception):
        trec.read_runs(spark, str(tmp_path / "bad.run")).collect()


def test_qrels(spark, tmp_path):
    lines = spark.createDataFrame([("q 0 d 1", 1), ("q 0 d 3", 2), ("q 0 d", 3), ("q 0.5 e 0", 4)], "value string, line_no int")
    assert sorted(map(tuple, trec.parse_qrels(lines).collect())) == [("q", "d", 3), ("q", "e", 0)]
    (tmp_path / "t.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    assert [tuple(r) for r in trec.read_qrels_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("q1", "d1", 1)]


def test_violations(spark):
    lines = ["q Q0 a 1 3.0 t", "q Q0 b 2 4.0 t", "q Q0 b 4 1.0 t", "q Q0 c é 1.0 t", "q Q0 dé 4 nan t", "too short"]
    got = sorted((r["docid"] or "", r["problem"]) for r in trec.violations(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert ("", "fields") in got and ("b", "duplicate") in got and ("b", "order") in got and ("c", "number") in got and ("dé", "id") in got and ("dé", "number") in got
    clean = ["q Q0 a 1 3.0 t", "q Q0 b 2 3.0 t"]
    assert trec.violations(spark.createDataFrame([(x,) for x in clean], "value string")).count() == 0


def test_cache_candidates_identity(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"query": {"qid": "q", "text": "t"}, "candidates": [{"docid": "d", "score": 2.0, "doc": {"_id": "d", "title": "a", "text": "b"}}, {"docid": "e", "score": 1.0, "doc": {"_id": "e", "title": "", "text": "x"}}]}))
    runs, texts = trec.read_cache(spark, str(tmp_path / "c.jsonl"))
    assert sorted((r["docid"], r["rank"]) for r in runs.collect()) == [("d", 0), ("e", 1)] and texts.count() == 2
    (tmp_path / "top.tsv").write_text('q\tp\ta "query\tpassage text\n')
    assert trec.read_candidates(spark, str(tmp_path / "top.tsv")).first()["query"] == 'a "query'
    assert trec.content_identity(spark, str(tmp_path / "top.tsv")).first()["bytes"] == 26


def test_stream(spark, tmp_path):
    for i, rows in enumerate([[("q", "a", 2), ("q", "b", 0)], [("q", "c", 1), ("q", "a", 2)]]):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"qid": q, "docid": d, "grade": g, "ts": f"2024-01-01T0{i}:00:00"}) for q, d, g in rows))
    coef = spark.createDataFrame([("q", "a", 3), ("q", "b", -2), ("q", "c", -1)], "qid string, docid string, coef bigint")
    out = judgments.running_bounds(judgments.read_judgments(spark, str(tmp_path)), coef)
    run = out.writeStream.outputMode("complete").format("memory").queryName("bounds").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert tuple(spark.table("bounds").first()) == ("q", 2, -3, 3)


def test_exact_scores(spark):
    one = "1." + "0" * 39
    lines = [f"q Q0 a 0 {one}1 t", f"q Q0 b 1 {one}2 t", "q Q0 d 2 1 t", "q Q0 c 3 1.00 t", "q Q0 e 4 -0.5 t", "q Q0 f 5 -0.55 t", "q Q0 g 6 -12 t", "q Q0 h 7 0012.5 t"]
    got = trec.rank_exact_scores(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("rank").collect()
    assert [r["docid"] for r in got] == ["h", "b", "a", "c", "d", "e", "f", "g"]
    with pytest.raises(Exception):
        trec.rank_exact_scores(spark.createDataFrame([("q Q0 a 0 1e5 t",)], "value string")).collect()


def test_strict_json(spark):
    lines = ['{"a": 1, "b": {"c": 1}}', '{"a": 1, "a": 2, "b": 0}', '{"a": 1, "b": {"c": 1, "c": 2}}', "{", "[1]", '{"a": 1}', None]
    got = {r["value"]: r["problem"] for r in trec.json_problems(spark.createDataFrame([(x,) for x in lines], "value string"), ["a", "b"]).collect()}
    assert got == {lines[1]: "duplicate", lines[2]: "duplicate", "{": "syntax", "[1]": "keys", '{"a": 1}': "keys", None: "syntax"}


def test_demo(spark):
    from rankloom.operators import fusion, metrics

    runs, qrels = fusion.demo_runs(spark, 5, 60, 3, 20)
    assert runs.count() == 5 * 3 * 20 and metrics.evaluate(fusion.rrf(runs), qrels).count() <= 5


def test_last_line_of_files_wins(spark, tmp_path):
    (tmp_path / "a.qrels").write_text("q 0 d 3\nq 0 e 1\n" + "q 0 f 0\n" * 50 + "q 0 d 1\nq 0 e 2\n")
    assert sorted(map(tuple, trec.read_qrels(spark, str(tmp_path / "a.qrels")).collect())) == [("q", "d", 1), ("q", "e", 2), ("q", "f", 0)]
    assert trec.oversized(spark, str(tmp_path), 10_000).count() == 0 and trec.oversized(spark, str(tmp_path), 100).count() == 1


def test_strict_judgments(spark):
    frame = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    lines = frame("q 0.5 a 0", "q 0 b 3", "q 1 a 2", "q 1 c 4", "r 1 a x", "q 1 a", "", "s -1 é 1")
    found = lambda **k: sorted(((r["qid"], r["docid"], r["problem"]) for r in trec.qrels_violations(lines, **k).collect()), key=str)
    plain = [("q", "a", "duplicate"), ("q", "a", "duplicate"), ("q", "c", "grade"), ("r", "a", "grade"), ("s", "é", "id"), (None, None, "fields")]
    assert found() == sorted(plain, key=str)
    assert found(rounds=True) == sorted([*plain, ("q", "b", "round"), ("s", "é", "round")], key=str)
    q, d = spark.createDataFrame([("q",), ("r",), ("z",)], "qid string"), spark.createDataFrame([("a",), ("b",), ("c",)], "docid string")
    assert found(queries=q, inventory=d) == sorted([*plain, ("s", "é", "query"), ("s", "é", "document"), ("z", None, "missing")], key=str)
    assert sorted(r["round"] for r in trec.parse_judgments(lines, d).collect()) == ["0", "0.5", "1", "1", "1"]
    assert {(r["docid"], r["copies"]) for r in trec.judged_pairs(lines).collect()} >= {("a", 2), ("b", 1)}
    names = frame(" a", "b ", "a", "c d", "")
    assert sorted(r["docid"] for r in trec.parse_inventory(names).collect()) == ["a", "b"]
    assert sorted(r["docid"] for r in trec.parse_inventory(names, "line").collect()) == [" a", "a", "b ", "c d"]
    assert sorted(map(tuple, trec.inventory_violations(names).collect())) == [("", "id"), ("a", "duplicate"), ("c d", "id")]
    assert [tuple(r) for r in trec.inventory_violations(names.limit(0)).collect()] == [(None, "empty")]


def test_tagged_runs(spark):
    lines = spark.createDataFrame([(x, "t") for x in ("q Q0 a 0 1.0 t", "q Q0 a 1 0.5 t", "q Q0 b +2 nan t", "q Q0 c -1 1e3 u", "too short")] + [("q Q0 a 0 1 w", "w")], "value string, source string")
    got = sorted(((r["source"], r["docid"], r["problem"]) for r in trec.tagged_violations(lines, None, spark.createDataFrame([("q",), ("r",)], "qid string"), 3).collect()), key=str)
    assert got == sorted([("t", "a", "duplicate")] * 2 + [("t", "b", "number"), ("t", "c", "rank"), ("t", "c", "tag"), ("t", None, "fields"), ("t", None, "depth"), ("t", None, "depth"), ("w", None, "depth")], key=str)


def test_caches_and_corpora(spark, tmp_path):
    row = {"query": {"qid": "q", "text": "t"}, "candidates": [{"docid": "b", "score": 1.0, "doc": {"_id": "b", "title": "", "text": "x"}}, {"docid": "a", "score": 1.0, "doc": {"_id": "a", "title": "", "text": "y"}}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n")
    assert [r["value"] for r in trec.cache_lines(spark, str(tmp_path / "c.jsonl"), "tag").orderBy("value").collect()] == ["q Q0 a 2 1.0 tag", "q Q0 b 1 1.0 tag"]
    runs, texts = trec.read_cache(spark, str(tmp_path / "c.jsonl"))
    corpus = spark.createDataFrame([("b", "", "other")], "_id string, title string, text string")
    assert sorted(map(tuple, trec.cache_mismatches(texts, corpus).collect())) == [("a", "missing"), ("b", "text")]
    bad = trec.component_violations(corpus, spark.createDataFrame([("p",)], "qid string"), spark.createDataFrame([("p", "z", 1)], "qid string, docid string, grade int"), runs)
    assert sorted(map(tuple, bad.collect())) == [("qrels docid", "z"), ("runs docid", "a"), ("runs qid", "q")]
    lines = spark.createDataFrame([("1\tp\tfirst\tx", 1), ("1\tp\tsecond\tx", 2)], "value string, line_no int")
    assert [tuple(r) for r in trec.first_queries(lines).collect()] == [("1", "first")]


def test_scenarios_and_reports(spark):
    from rankloom.operators import fusion, metrics

    runs, qrels = fusion.scenario_runs(spark, 40)
    rows = runs.groupBy("qid", "docid").pivot("source").agg({"rank": "first"}).collect()
    same = {q: sum(r["ranker1"] == r["ranker2"] for r in rows if r["qid"] == q) for q in fusion.SCENARIOS}
    assert same["agreement"] == same["cabal"] == 40 and same["disagreement"] < 12
    got = metrics.report({"rrf": fusion.rrf(runs), "k1": fusion.rrf(runs, 1)}, qrels).collect()
    assert [r["variant"] for r in got] == ["rrf", "k1"] and got[0]["ties"] == got[0]["queries"] and got[0]["p"] == 1.0
