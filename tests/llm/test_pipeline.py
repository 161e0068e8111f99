"""The pipeline against stages applied by hand, and the SQL of the queries on the small tables."""

import hashlib
import os
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from rankloom.llm import langid  # noqa: E402
from tests.llm.test_operators import components_by_hand, fingerprint_by_hand  # noqa: E402


def test_run_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 100)
    rng = random.Random(9)
    vocab = {"aa": [f"tha{i}" for i in range(60)], "bb": [f"éle{i}x" for i in range(60)]}
    text = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    rows = [(i, text(x, 30), x, "s", 0) for i, x in zip(range(120), ["aa", "bb"] * 60)]
    item = "this passage is one of the benchmark and must not be in any document at all"
    rows += [(200, rows[0][1], "aa", "s", 0), (201, rows[1][1].upper(), "bb", "s", 0), (202, text("aa", 20) + " " + item, "aa", "s", 0), (203, "12 34 !", "aa", "s", 0), (204, None, "aa", "s", 0), (205, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for t, i in last.items()}
    fps = {i: fingerprint_by_hand(t) for i, t in left.items()}
    roots, first = components_by_hand(set(fps.values())), {}
    for i, f in fps.items():
        first[roots[f]] = min(i, first.get(roots[f], i))
    left = {i: left[i] for i in first.values() if item not in left[i]}
    got = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontamination", "byte_bpe"]


def test_stages_without_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "byte_bpe":
            assert out.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no supplied tables")
@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_license_scan", "op5_warc"])
def test_sql(spark, name):
    from rankloom.llm import queries
    from tests.oracle import same

    same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")
