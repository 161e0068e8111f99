"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from rankloom.llm import bpe, decontam, exact_dedup, html_extract, langid, license_scan, packing, simhash, toxicity, warc
from rankloom.llm.common import fold, skew_join

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, n bigint, key string, fp bigint, score double, row int"
EXTRA = ("d", 1, "k", 2, 0.5, 3)


def docs(spark, rows):
    """rows of (doc_id, text[, lang]) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, (x or ["en"])[0], "s", 0, *EXTRA) for i, t, *x in rows], DOCS)


LONG = "word and other words " * 20000
EDGE = [(1, None), (2, ""), (3, "same text"), (4, "same text"), (4, "same text"), (None, "same text"), (5, "Same text"), (6, LONG), (7, LONG), (None, None), (8, "é 日本 \U0001f600 \x1c x"), (9, "  \t\n"), (None, "only null ids"), (None, "only null ids")]


def collected(df):
    return [tuple(r) for r in df.collect()]


# exact deduplication


def classes_by_hand(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: __import__("pyspark.sql.functions", fromlist=["x"]).lit(b"same")], ids=["sha256", "all collide"])
def test_exact_classes(spark, digest):
    got = exact_dedup.classify(docs(spark, EDGE), digest=digest).select("doc_id", "keep_id", "group_size")
    assert sorted(collected(got), key=str) == classes_by_hand(EDGE)


def test_exact_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 6}") for i in range(600)]
    got = exact_dedup.classify(docs(spark, rows)).select("doc_id", "keep_id", "group_size")
    assert sorted(collected(got), key=str) == classes_by_hand(rows)


def test_exact_deduplicate(spark):
    df = docs(spark, EDGE)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted({t or "" for _, t in EDGE})
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


# SimHash


def fingerprint_by_hand(text):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


def test_fingerprints(spark):
    texts = [t for _, t in EDGE if t is not LONG] + ["a", "a b", "A B c D", "x " * 40000]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == fingerprint_by_hand(t)


def test_components(spark):
    got = simhash.cluster(docs(spark, EDGE))
    by = {}
    fps = [fingerprint_by_hand(t) for _, t in EDGE]
    roots = components_by_hand(set(fps))
    for (i, _), f in zip(EDGE, fps):
        by.setdefault(roots[f], []).append(i)
    want = sorted(((i, min((x for x in by[roots[f]] if x is not None), default=None)) for (i, _), f in zip(EDGE, fps)), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == want
    assert simhash.cluster(docs(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [3, 12, 40])
def test_links_of_planted_fingerprints(spark, spread):
    """Small buckets, large buckets and a bucket that the mask search has to join, against all pairs."""
    rng = random.Random(spread)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b for b in base}
    bits = rng.sample(range(64), spread)
    for b in base:
        for _ in range(150):
            f = b
            for p in rng.sample(bits, rng.randint(0, min(3, spread))):
                f ^= 1 << p
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).astype(np.int64)) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    want = components_by_hand(fps)
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7)], "a bigint, b bigint")
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_near_deduplicate(spark):
    df = docs(spark, EDGE)
    kept = simhash.near_deduplicate(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r["component_id"] for r in simhash.cluster(df).collect() if r["component_id"] is not None}


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizers():
    import tiktoken

    path, pattern = bpe.vocabulary()
    return bpe.Tokenizer(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_encoding_equals_the_library(tokenizers):
    own, library = tokenizers
    rng = random.Random(5)
    letters = list("aaabcdeéèñßthe  \n\t'!|%$0123Ωж漢字😀\x1c ́")
    tokens = list(own.machine.token.values())
    texts = ["", " ", "a" * 3000, *(t or "" for _, t in EDGE)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 9))).decode("utf-8", "replace") for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t


def test_caches_change_nothing(tokenizers, monkeypatch):
    own, library = tokenizers
    monkeypatch.setattr(bpe, "STATES", 20)
    monkeypatch.setattr(bpe, "PIECES", 5)
    for t in ("unbelievable transducers", "déterminisation paresseuse", "x" * 100 + "yz"):
        assert own.encode(t * 3) == library.encode_ordinary(t * 3)


def test_long_pieces_and_few_states(tokenizers, monkeypatch):
    own, library = tokenizers
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert own.encode(long) == library.encode_ordinary(long)
    monkeypatch.setattr(bpe, "STATES", 500)
    machine = bpe.Transducer(own.machine.ranks)
    for at in range(0, 100_000, 1000):
        machine.encode(long[at : at + 50_000 if not at else at + 1000].encode())
        assert len(machine.states) <= 501  # the cap holds inside a piece too


def test_ranks_must_be_trained():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})
    every = {bytes((i,)): i for i in range(256)}
    with pytest.raises(ValueError):
        bpe.Transducer(every | {b"ab": 400, b"abc": 300})
    assert bpe.Transducer(every | {b"ab": 300, b"abc": 400}).encode(b"abcab") == [400, 300]


def test_streaming_decoder():
    data = "aé漢😀z".encode()
    for cuts in itertools.combinations(range(1, len(data)), 3):
        stream, out = bpe.Utf8Stream(), ""
        for a, b in zip((0, *cuts), (*cuts, len(data))):
            out += stream.feed(data[a:b])
        assert out + stream.feed(b"", final=True) == "aé漢😀z"
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xff\xe6\xbc") + stream.feed(b"", final=True) == "a��"


def test_digests(spark, tokenizers):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(docs(spark, EDGE), *bpe.vocabulary()).collect()}
    want = set()
    for i, t in EDGE:
        ids = tokenizers[1].encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digest_documents(docs(spark, []), *bpe.vocabulary(), with_ids=True).count() == 0


# packing


def test_best_fit_decreasing():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 300):
        lengths = [rng.randint(1, 64) for _ in range(n)]
        rows, left = [], []
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            fit = [r for r in range(len(rows)) if left[r] >= lengths[i]]
            if fit:
                least = min(left[r] for r in fit)
                r = next(r for r in fit if left[r] == least)
                rows[r].append(lengths[i])
                left[r] -= lengths[i]
            else:
                rows.append([lengths[i]])
                left.append(64 - lengths[i])
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(i for row in got for i in row) == list(range(n))
        # which of several rows with equal room takes a length is open; how full the rows get isn't
        assert sorted(sum(lengths[i] for i in row) for row in got) == sorted(map(sum, rows))


@pytest.mark.parametrize("group", [50, 10**6])
def test_packing_loses_nothing(spark, group):
    import tiktoken

    path, pattern = bpe.vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = {}
    for r in packing.pack(docs(spark, EDGE), path, pattern, 128, group).collect():
        ids, places = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(places) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    want = {}
    for i, t in EDGE:
        want.setdefault(i, []).extend(library.encode_ordinary(t or ""))
    for i, ids in want.items():
        assert sorted(x for _, part in found.get(i, []) for x in part) == sorted(ids)
    assert [x for _, part in sorted(found[6]) for x in part] == want[6]
    assert packing.pack(docs(spark, []), path, pattern).count() == 0


# language ID


def language_rows(n=240):
    words = {"aa": "the of and to in that is was for with", "bb": "le la de et les des que une pour dans", "cc": "ß der die und das ist nicht mit ein ü"}
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(words[x].split()) for _ in range(rng.randint(5, 60))), x) for i, x in zip(range(n), itertools.cycle(words))]


def test_gradients():
    rng = np.random.default_rng(0)
    E, U, V = rng.normal(size=(257, 9)), rng.normal(size=(3, 6)), rng.normal(size=(3, 3))
    x = rng.integers(0, 5, (4, 6)).astype(np.int16)
    target = rng.normal(size=(6, 4, 3))
    loss = lambda: float((langid._run(E, U, V, x) * target).sum())
    _, saved = langid._run(E, U, V, x, True)
    grads = langid._back(E, U, V, x, saved, target)
    for p, g in zip((E, U, V), grads):
        for at in [tuple(rng.integers(0, min(s, 5)) for s in p.shape) for _ in range(6)]:
            p[at] += 1e-2
            up = loss()
            p[at] -= 2e-2
            down = loss()
            p[at] += 1e-2
            assert abs((up - down) / 2e-2 - g[at]) < 5e-2 * max(1, abs(g[at]))


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rows = language_rows()
    df = docs(spark, [*rows, (1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", "aa"), (1003, "the of and", None)])
    model = langid.train([t.encode() for _, t, _ in rows[:180]], [x for *_, x in rows[:180]], steps=150)
    got = {r["doc_id"]: r for r in langid.predict(df, model, "doc_id", "score_" if "score_" in df.columns else "source").collect()}
    right = [got[i]["lang_pred"] == x for i, _, x in rows[180:]]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(df.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.predict(df, None, "doc_id").collect()} == {"und"}
    assert langid.predict(docs(spark, []), model, "doc_id").count() == 0


def test_every_position_is_labelled():
    model = langid.Model(["a", "b"], langid._init(2, 4, np.random.default_rng(1)))
    for n in (1, 95, 96, 97, 300):
        x = langid.windows(np.arange(n, dtype=np.uint8))
        assert int((x != 256).sum()) == n
        logs = model.positions(x)
        assert np.allclose(np.exp(logs).sum(axis=2), 1, atol=1e-4) and logs.shape[:2] == x.T.shape
    one = model.documents([b"some text", b"another"])
    assert np.allclose(one, np.concatenate([model.documents([b"some text"]), model.documents([b"another"])]))


# toxicity


def test_toxicity(spark):
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, " ".join([rng.choice(clean) for _ in range(40)] + (["zorg", "blag"] if bad else []))))
        if i % 2 == 0 or not bad and i % 4 == 1:
            labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (0, 1)]
    df = docs(spark, [*rows, (5000, None), (5001, ""), (5002, "zorg blag")])
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(df.where(fold(df["doc_id"], 3) != 1), lab.where(fold(lab["doc_id"], 3) != 1))
    got = {r["doc_id"]: r for r in toxicity.score(df, model, "doc_id").collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5002]["predicted"] == 1
    assert toxicity.fit(df, lab.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(df, None, "doc_id").collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model, "doc_id").count() == 0


# decontamination


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, h bigint, size int")


ITEM = "Yesterday evening Alice bought 12 apples and 7 pears at the market for 30 euros before walking back to the village with Alice and Robert."


def test_templates(spark, monkeypatch):
    changed = ITEM.replace("Alice", "Maria").replace("Robert", "Pavel").replace("12", "45").replace("7", "9").replace("30", "88").replace("euros", "dollars")
    mixed = changed.replace("Maria", "Susan", 1)
    rows = [(1, "Some words first. " + ITEM + " And some more."), (2, "x y z. " + changed), (3, "x y z. " + mixed), (4, "Nothing of the kind stands here, not at all."), (5, None), (6, ""), (6, ""), (None, ITEM), (7, LONG + ITEM), (8, ITEM[:60]), (9, ITEM.title()), (10, ITEM.upper()), (11, ITEM.replace(" 12", ". 12").replace("apples", "Apples"))]
    bench = items(spark, [(10, ITEM, 0, 0), (10, ITEM, 0, 0), (11, None, 0, 0), (12, "ok", 0, 0), (None, ITEM, 0, 0), (13, "a short question here", 0, 0)])
    for most in (decontam.IN_WORKERS, 0):
        monkeypatch.setattr(decontam, "IN_WORKERS", most)
        got = sorted(((r["doc_id"], r["contaminated"], r["item_id"]) for r in decontam.flag(docs(spark, rows), bench).collect()), key=str)
        want = [(1, True, 10), (2, True, 10), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (6, False, None), (None, True, 10), (7, True, 10), (8, False, None), (9, True, 10), (10, True, 10), (11, True, 10)]
        assert got == sorted(want, key=str)
    df = docs(spark, rows)
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 6, 8]
    assert decontam.flag(docs(spark, []), bench).count() == 0
    assert decontam.clean(df, items(spark, [])).count() == len(rows)


def test_names_that_begin_sentences_and_quotations(spark):
    item = "Tom has 12 apples. Tom gives 5 apples to Ann. Tom then eats 2 apples. How many are left?"
    other = item.replace("Tom", "Karl").replace("Ann", "Eva").replace("12", "31").replace("5", "8").replace("2", "6")
    counted = "Mia had three red marbles in the bag. Mia then put four blue marbles in the bag as well."
    recounted = counted.replace("Mia", "Ole").replace("three", "7").replace("four", "nine")
    words = "the river runs past a mill where old boats lie under trees and children play until dark falls over quiet fields while their parents mend nets beside open doors or carry baskets of fish along narrow paths that lead from one harbour wall to another before winter storms close every road".split()
    quoted = " ".join(words[20:45])
    rows = [(1, other), (2, other.replace("Karl then", "Paul then")), (3, recounted), (4, f"He said: {quoted}, and no more."), (5, "So " + " ".join(words[20:32])), (6, "Karl has no time. Eva likes green tea.")]
    bench = items(spark, [(1, item, 0, 0), (2, counted, 0, 0), (3, " ".join(words), 0, 0)])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.flag(docs(spark, rows), bench).collect())
    assert got == [(1, 1), (2, None), (3, 2), (4, 3), (5, None), (6, None)]


# WARC


def test_warc(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/x y", big), (2, "http://b/\r\n", big), (3, None, big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, "u", "z" * 1000), (8, "u", "y" * 1000), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, original int")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = sorted(collected(warc.read(spark, path)), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        other = len(data) >= 1000 and i != best
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", best if other else None))
    assert got == sorted(want, key=str)
    empty = f"file://{tmp_path}/e"
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# HTML


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 3) for r in rows], "page_id bigint, url string, html string, key string, n_chars int")


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice">We use cookies</div>
    <div class="wrap"><article><header><h1>Title &amp; more</h1></header><p class="ad">buy</p><p>a<br>b <b>c</b>&nbsp;d<p>e &lt;f&gt;
    <ul><li>one<li>two</ul><form><input>q</form><aside>side</aside><!-- gone --><div class="comments"><article><p>nice</p></article></div></article></div><footer>&copy; f</footer>"""
    assert [b for b, _ in html_extract.blocks(page)] == ["Title & more", "a b c d", "e <f>", "one", "two"]
    assert html_extract.blocks("") == [] and html_extract.blocks("plain") == [("plain", False)]
    assert [b for b, _ in html_extract.blocks("<article><p>a</p></article><footer>never closed <p>x")] == ["a"]
    assert [b for b, _ in html_extract.blocks('<div class="has-sidebar"><article><p>in</p></article></div>')] == ["in"]
    assert [b for b, _ in html_extract.blocks('<main><article><p>in</p></article></main><div class="comments"><article><p>no</p></article></div>')] == ["in"]
    assert [b for b, _ in html_extract.blocks("<nav>open <article><p>kept &am</p></article>")] == ["kept &am"]


def test_elements_without_end_tag():
    def kept(page):
        return [b for b, _ in html_extract.blocks(page)]

    assert kept('<article><p>a<p class="notice">Cookies <b>x</b> y<p>First</p><p>Second</article><p>no') == ["a", "First", "Second"]
    assert kept('<article><p class="notice">Cookies<div>one</div><p>two</article>') == ["one", "two"]
    assert kept('<article><ul><li>a<li class="ad">buy<ul><li>more</ul><li>b</ul><p>c</article>') == ["a", "b", "c"]
    assert kept('<article><dl><dt>a<dd class="promo">buy<dt>b<dd>c</dl></article>') == ["a", "b", "c"]
    assert kept('<article><table><tr><td>a<td class="ad"><div>buy<td>b<tr class="ad"><td>buy<tr><td>c</table><p>d</article>') == ["a", "b", "c", "d"]
    assert kept('<article><section><div class="ad">buy <p>now</section><p>a</article>') == ["a"]
    assert kept('<article><p>a <span class="ad">buy</p><p>b</article>') == ["a", "b"]
    assert kept('<p>a</p><div class="ad">buy') == ["a"]
    assert kept('<div><article><p>a</div><p>b</article><p>no') == ["a", "b"]


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 1), (2, 1), (60, 1), (200, 3), (300, 40)):
        tokens = rng.integers(0, k, n)
        order, common = html_extract.suffix_array(tokens)
        suffixes = sorted(range(n), key=lambda i: tokens[i:].tolist())
        assert order.tolist() == suffixes
        for at in range(1, n):
            a, b = tokens[suffixes[at - 1] :].tolist(), tokens[suffixes[at] :].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[at] == same


def test_shared_substrings_by_hand(monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    monkeypatch.setattr(html_extract, "LENGTH", 3)
    monkeypatch.setattr(html_extract, "LONG", 5)
    rows = pd.DataFrame([("h", i // 2, i % 2, [rng.randrange(3) for _ in range(rng.randrange(12))]) for i in range(16)], columns=["host", "key", "block", "tokens"])
    got = {(r.kind, r.window): r.pages for r in html_extract._shared(rows).itertuples()}
    want = {}
    for kind, length in ((0, 3), (1, 5)):
        for _, key, _, tokens in rows.itertuples(index=False):
            for i in range(len(tokens) - length + 1):
                want.setdefault((kind, int(html_extract._window_keys("h", kind, np.array(tokens[i : i + length], np.int64), length)[0])), set()).add(key)
    assert got == {k: len(v) for k, v in want.items()}


def test_copies_of_articles_stay(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(n))
    article, notice, menu = words(60), words(25), words(8)
    rows = [(i, f"http://small.example/{i}", f"<body><div>{article}</div></body>") for i in range(3)] + [(3, "http://small.example/x", f"<div>{words(9)}</div>")]
    # an article on three pages among many, each with the host's notice; the notice goes, the article stays
    rows += [(10 + i, f"http://large.example/{i}", f"<body><div>{menu}</div><div>{notice}</div><div>{article if i < 3 else words(40)}</div></body>") for i in range(30)]
    # a paragraph that markup vouches for, on all pages of a host
    rows += [(50 + i, f"http://news.example/{i}", f"<article><p>{words(30)}</p><p>{notice}</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert all(got[i] == article for i in range(3)) and all(got[10 + i] == article for i in range(3))
    assert all(notice not in got[10 + i] and menu not in got[10 + i] and len(got[10 + i].split()) == 40 for i in range(3, 30))
    assert all(notice not in got[50 + i] and len(got[50 + i].split()) == 30 for i in range(12))


def test_words_in_class_names():
    kept = lambda x: [b for b, _ in html_extract.blocks(x)]
    assert kept('<article><div class="social-science">a b</div><p class="noticeable">c</p></article>') == ["a b", "c"]
    assert kept('<article><div class="related">see also the text</div><div class="related-posts"><a href="x">one two</a> and</div></article>') == ["see also the text"]
    assert kept('<article><p>a</p><div class="ad-slot-3">buy</div><div class="comments_list">no</div></article>') == ["a"]
    listing = "<div class=nav>" * 3 + "".join(f"<article><p>t{i}</p></article><div class='ad'>x</div>" for i in range(3000))
    assert len(kept(listing)) == 3000


def test_host_boilerplate(spark, monkeypatch):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))
    notice = "this line stands on every single page of the host"
    rows, want = [], {}
    for i in range(30):
        own = words(20)
        rows.append((i, f"http://h.example/{i}", f"<body><div>{notice} {own}</div><div>short one</div></body>"))
        want[i] = own
    article = words(30)
    rows += [(100 + i, f"http://h.example/a{i}", f"<article><p>{article}</p></article>") for i in range(5)]
    rows += [(300 + i, f"http://menus.example/{i}", f"<nav>home news sports weather contact {i // 20} us</nav><div>home news sports weather contact {i // 20} us</div><div>{want.setdefault(300 + i, words(9))}</div>") for i in range(20)]
    rows += [(200, "http://other.example/", f"<div>{notice}</div>"), (201, None, None), (202, None, ""), (None, None, "<p>x</p>"), (0, rows[0][1], rows[0][2])]
    monkeypatch.setattr(html_extract, "GROUP_TOKENS", 200)
    got = {}
    for r in html_extract.extract(pages_of(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [own] * (2 if i == 0 else 1) for i, own in want.items()), (got[300], want[300])
    assert all(got[100 + i] == [article] for i in range(5))
    assert got[200] == [notice] and got[201] == got[202] == [""] and got[None] == ["x"]
    assert html_extract.extract(pages_of(spark, [])).count() == 0


# licences


def test_licences(spark):
    rows = [
        ("a", "r/LICENSE", "MIT License\nReleased under the MIT License.", True),
        ("b", "r/x/y/main.c", "int main;", False),
        ("c", "r/x/own.c", "/* Licensed under the Apache License, Version 2.0. */\ncode", False),
        ("d", "r/x/z/COPYING", "This work is licensed under the GNU General Public License, version 3.", True),
        ("e", "r/x/z/q/deep.c", None, False),
        ("f", "q/none.c", "", None),
        ("g", None, "All rights reserved.", False),
        ("h", "top.c", "text", False),
        ("h2", "r/x/y/main.c", "int main;", False),
        ("i", "q/odd.c", "the licence of a driver was lost in the woods near the old mill by the river", False),
    ]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "key string, path string, text string, is_licence_file boolean, n int, term string")
    got = {r["key"]: (r["licence"], r["evidence"], r["inherited_from"]) for r in license_scan.scan(files).collect()}
    assert got == {
        "a": ("MIT", "licence file", None),
        "b": ("MIT", "inherited", "r"),
        "c": ("Apache-2.0", "header", None),
        "d": ("GPL-3.0", "licence file", None),
        "e": ("GPL-3.0", "inherited", "r/x/z"),
        "f": (None, "none", None),
        "g": ("Proprietary", "header", None),
        "h": (None, "none", None),
        "h2": ("MIT", "inherited", "r"),
        "i": (None, "none", None),
    }
    assert license_scan.scan(files.limit(0)).count() == 0


def test_real_licences(spark):
    ts = {k: [t for kind, t in v if kind in ("text", "notice")] for k, v in license_scan.TEMPLATES.items()}
    wrapped = lambda t, c: "\n".join(f"{c} {' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    rows = [
        ("mit", "a/LICENSE", "MIT License\n\nCopyright (c) 2019 Some Body and others\n\n" + wrapped(ts["MIT"][0].removeprefix("MIT License "), "")),
        ("spdx", "a/x.c", "// SPDX-License-Identifier: MIT\n" + "int main and much more code of its own " * 9),
        ("spdx2", "b/x.c", "/* SPDX-License-Identifier: GPL-2.0-only */"),
        ("bsd3", "c/COPYING", "Copyright 2001 The People\n" + wrapped(ts["BSD-3-Clause"][0], "")),
        ("bsd2", "d/COPYING", "Copyright 2001 The People\n" + wrapped(ts["BSD-2-Clause"][0], "")),
        ("apache", "e/x.py", "# Copyright 2020 Foo Inc.\n" + wrapped(ts["Apache-2.0"][1], "#") + "\n\nimport os\n" + "words of code " * 3000),
        ("gpl2", "f/x.c", wrapped(ts["GPL-2.0"][0], " *") + "\ncode"),
        ("gpl3", "g/x.c", wrapped(ts["GPL-3.0"][0], "//") + "\ncode"),
        ("under", "a/y.c", "code of its own"),
        ("rows", "a/y.c", "code of its own"),
        ("prose", "h/a.txt", "he lost his licence when " + "the words went on and on in other ways " * 20000),
    ]
    files = spark.createDataFrame([(*r, None) for r in rows], "key string, path string, text string, is_licence_file boolean")
    got = {r["key"]: (r["licence"], r["evidence"]) for r in license_scan.scan(files).collect()}
    assert got == {"mit": ("MIT", "licence file"), "spdx": ("MIT", "header"), "spdx2": ("GPL-2.0", "header"), "bsd3": ("BSD-3-Clause", "licence file"), "bsd2": ("BSD-2-Clause", "licence file"), "apache": ("Apache-2.0", "header"), "gpl2": ("GPL-2.0", "header"), "gpl3": ("GPL-3.0", "header"), "under": ("MIT", "inherited"), "rows": ("MIT", "inherited"), "prose": (None, "none")}


# shared helpers


def test_skew_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("alone", 2), (None, 3)], "key string, v int")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "key string, w int")
    for how in ("left", "inner"):
        got = sorted(collected(skew_join(left, right, "key", 203, how)), key=str)
        assert got == sorted(collected(left.join(right, "key", how)), key=str)


# HTML: bodies beside an article element, and long untidy pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><p>Intro text of the page.</p></div><article class='card'><p>teaser</p></article>", ["Intro text of the page.", "teaser"]),
        ("<main><article><p>First part.</p></article><p>Rest of the body.</p></main>", ["First part.", "Rest of the body."]),
        ("<p>Before.</p><main><p>Inside.</p></main><p>After.</p>", ["Before.", "Inside.", "After."]),
        ("<main><p>Inside.</p></main><div><a href=x>one</a> <a href=y>two</a></div>", ["Inside."]),
        ("<article><p>Text.</p></article><div class='sidebar'><p>More</p></div><footer>end</footer>", ["Text."]),
    ],
)
def test_text_beside_an_article_stays(page, want):
    assert [t for t, _ in html_extract.blocks(page)] == want


@pytest.mark.parametrize("part", ["<a ", "<b>x ", "<div>", '<a "', "<p>x<b>", "<td>", "</p>", "<ul><li>", "<script ", "<article>", "<article><div class='share'>", "<!-", "<a 'x", "<i><td><b>"])
def test_time_grows_as_the_page_does(part):
    import time

    def seconds(size):
        page = part * (size // len(part))
        began = time.process_time()
        html_extract.blocks(page, [])
        return time.process_time() - began

    small = max(seconds(1 << 17), 0.02)
    assert seconds(1 << 19) < 10 * small  # four times the page


# licences as they are found in the wild

SHELF = "/usr/share/common-licenses"
NAMED = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not __import__("os").path.isdir(SHELF), reason="no licence files")
def test_real_licence_files(spark):
    import os

    files = [(n, f"{n}/LICENSE-text", open(f"{SHELF}/{n}", encoding="utf-8").read(), None) for n in NAMED if os.path.exists(f"{SHELF}/{n}")]
    files += [(f"{n}/x", f"{n}/src/x.c", "int x;", None) for n, *_ in files]
    got = {r["key"]: (r["licence"], r["evidence"]) for r in license_scan.scan(spark.createDataFrame(files, "key string, path string, text string, is_licence_file boolean")).collect()}
    for n, *_ in files:
        assert got[n] == ((NAMED[n], "licence file") if "/" not in n else (NAMED[n[:-2]], "inherited")), n


def test_licences_that_are_not_the_templates(spark):
    bsd = """/* Copyright (c) 2011, Somebody. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * * Redistributions of source code must retain the above copyright notice, this
 *   list of conditions and the following disclaimer.
 * * Redistributions in binary form must reproduce the above copyright notice,
 *   this list of conditions and the following disclaimer in the documentation
 *   and/or other materials provided with the distribution.
 * * Neither the name of Somebody nor the names of other people
 *   may be used to endorse or promote products derived from this
 *   software without specific prior written permission.
 * THIS SOFTWARE IS PROVIDED BY SOMEBODY "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
 */
int main(void) { return 0; }
"""
    files = [
        ("bsd", "a/main.c", bsd),
        ("beside", "a/other.c", "int y;"),
        ("spdx", "b/x.py", "# SPDX-License-Identifier: MIT\nx = 1\n"),
        ("near spdx", "b/y.py", "y = 1\n"),
        ("rights", "c/z.py", "# Copyright 2020 Firm. All rights reserved.\nz = 1\n"),
        ("unknown", "d/LICENSE", "You may use this program under the licence of our village: bring bread on Sundays, and tell nobody about the well."),
        ("mentioned", "e/COPYING", "This project is released under the MIT License."),
        ("near mention", "e/src/a.c", "int a;"),
        ("both", "f/a.py", "# SPDX-License-Identifier: Apache-2.0\n# All rights reserved.\n# This work is licensed under the GNU General Public License, version 2.\n"),
    ]
    got = {r["key"]: (r["licence"], r["evidence"]) for r in license_scan.scan(spark.createDataFrame([(*f, None) for f in files], "key string, path string, text string, is_licence_file boolean")).collect()}
    assert got["bsd"] == ("BSD-3-Clause", "header") and got["beside"] == (None, "none")
    assert got["spdx"] == ("MIT", "header") and got["near spdx"] == (None, "none")
    assert got["rights"] == ("Proprietary", "header") and got["unknown"] == (None, "none")
    assert got["mentioned"] == ("MIT", "licence file") and got["near mention"] == ("MIT", "inherited")
    assert got["both"] == ("Apache-2.0", "header")


# WARC: ids of any text


def test_warc_ids_of_any_text(spark, tmp_path):
    ids = ["a b", "line\r\nend", "100%", "<x>", "none", "é日", "", None, "a:b", "%41"]
    page = "words " * 300
    rows = [(i, "http://h/x", page if k % 2 else f"{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write(df, f"{tmp_path}/warc")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, f"{tmp_path}/warc", "string").collect()}
    original = max((i for i, _, t in rows if t == page and i is not None), key=lambda x: x.encode())
    assert set(got) == set(ids)
    for i, _, t in rows:
        copy = t == page and i != original
        assert got[i] == (len(t), "revisit" if copy else "response", original if copy else None)


# toxicity: rows that repeat


def test_repeated_rows_neither_flood_nor_vanish(spark):
    rows = [(1, "a plain text about the weather")] * 30000 + [(2, "zorg zorgling in a nasty text")] * 20000 + [(i, f"zorg nasty number {i}" if i % 9 == 0 else f"plain number {i}") for i in range(3, 800)]
    groups = spark.createDataFrame(rows, "doc_id int, text string").groupBy("doc_id", "text").count().selectExpr("doc_id", "xxhash64(text) as of", "count as n")
    for salt in (1, 2, 3):
        drawn = {r["doc_id"]: r["times"] for r in toxicity._draw(groups, 0.1, salt).collect()}
        assert drawn[1] in (3000, 3001) and drawn[2] in (2000, 2001) and 40 < sum(v for k, v in drawn.items() if k > 2) < 130
        assert drawn == {r["doc_id"]: r["times"] for r in toxicity._draw(groups.repartition(7), 0.1, salt).collect()}
    df = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(2, 1), (1, 0), *((i, int(i % 9 == 0)) for i in range(3, 800))], "doc_id int, toxic int")
    model = toxicity.fit(df, labels)
    assert model.score("zorg nasty") > 0.7 > model.score("plain number 4")


def test_toxicity_is_written_once():
    import ast

    names = [x.name for x in ast.parse(open(toxicity.__file__).read()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
    assert len(names) == len(set(names))  # a later one would be used instead, unseen


def test_toxicity_draws_repeated_rows_by_their_number(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "UNLABELLED", 200)
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.update(p=p, u=u))
    rows = [(1, "the same row again")] * 1000 + [(i, f"plain number {i}" + " zorg" * (i % 9 == 0)) for i in range(2, 1002)]
    toxicity.fit(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(2, 1002)], "doc_id int, toxic int"))
    assert sum("again" in f for f in seen["u"]) in (99, 100, 101)  # its share, not all or none
    assert 150 < len(seen["u"]) < 250 and all("zorg" in f for f in seen["p"])
