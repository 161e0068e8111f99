"""Benchmark decontamination by template canonicalisation.

Texts become templates: lower-case words, with typed placeholders for numbers, for units after a number, and for names (capitalised words that don't begin a sentence). Windows of WINDOW template tokens are joined by hash (and compared in full) with those of the benchmark items, and on each diagonal (place in the text less place in the item) the slots must be consistent: every value of an item's slot goes to one value of the text's, and no two to one; diagonals are added up, longest first, as long as their slots agree. So a question whose numbers or names were changed throughout is caught, and unrelated text of the same form isn't. A document is contaminated by an item if, in one of three readings, consistent diagonals cover at least CONTAINMENT of the item's windows, or one of them has an unbroken run of usable windows that covers RUN words. The readings: with placeholders; as plain words, so that changed capitals or punctuation don't hide a passage; and with placeholders also for capitalised words that begin a sentence (but for fixed function words) and for number words. Signs of arithmetic count as words but in the second reading.

Windows of fewer than LITERALS plain words say nothing and are not used. An item shorter than a window is one window of its own length; an item without any usable window (fewer than LITERALS plain words) is never found.

If the benchmark has at most IN_WORKERS windows of IN_BYTES together, document windows that it lacks are left out before the join, in the workers; beyond that all windows are joined, frequent ones (at most 1 / HOT_SHARE) apart. The rows that result are the same.

Defined results: null text counts as empty and is clean; a null item is skipped; items that repeat count once. Rows that repeat get the same row each. An empty table gives no rows; with an empty benchmark all are clean. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, skew_join, small_batches, table

WINDOW, LITERALS, CONTAINMENT, IN_WORKERS, IN_BYTES, KNOWN = 5, 3, 0.5, 1 << 20, 1 << 26, 400_000
#: Characters of texts that are read together.
TOGETHER = 1 << 19
#: Words of an unbroken run that suffices, whatever its share of the item.
RUN = 13
TOKENS = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n%$€£+*/=×÷]|(?<![^\W_])-(?=\s*\d)").findall
#: Stands between texts; no token.
BREAK = "\x00"
#: Fixed words: units that may follow a number.
UNITS = frozenset("% $ € £ percent dollar dollars euro euros pound pounds cent cents m km cm mm mile miles meter meters metre metres foot feet inch inches yard yards kg g mg gram grams kilogram kilograms lb lbs oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kph degree degrees watt watts volt volts".split())
#: Fixed words that begin a sentence and are no names.
FUNCTION = frozenset("a an the this that these those he she it they we you i his her its their our my your there here then when while if unless although though because in on at to for from with without by of as into over under between among about and but or nor so yet after before during since until once how what which who whom whose why where is are was were be been do does did has have had can could will would shall should may might must let please each every all some any both many most much few several other another no not only even just also however therefore thus finally first next last later now today tomorrow yesterday suppose given assume find calculate".split())
#: Fixed number words.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: With placeholders; with words only: punctuation or capitals that were lost or added don't hide a passage; with placeholders for names that begin a sentence and for number words as well.
READINGS = ("slots: ", "words: ", "names: ")
WORD, CAPITAL, NUMBER, UNIT, END, SYMBOL, SIGN = range(7)
SLOTS = {CAPITAL: "<name>", NUMBER: "<number>", UNIT: "<unit>"}
SLOT_HASHES = np.array([xxhash.xxh64_intdigest(SLOTS.get(k, "")) for k in range(7)], np.uint64)


class Templates(dict):
    """Token to number, and by number a kind, a hash, and the kind that the third reading adds; what is known of a token is kept, up to a bound."""

    def __init__(self):
        super().__init__()
        self.kinds, self.hashes, self.wide = np.empty(1024, np.int8), np.empty(1024, np.uint64), np.empty(1024, np.int8)

    def __missing__(self, t: str) -> int:
        low = t.lower()
        if t in ".!?\n" or t == BREAK:
            kind = END
        elif t[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT if t.isalpha() else SYMBOL
        elif t in "+*/=×÷-":
            kind = SIGN
        else:
            kind = CAPITAL if len(t) > 1 and t[0].isupper() and t[1:] == t[1:].lower() else WORD
        self[t] = i = len(self)
        if i == len(self.kinds):
            self.kinds, self.hashes, self.wide = (np.concatenate([x, np.empty_like(x)]) for x in (self.kinds, self.hashes, self.wide))
        self.kinds[i], self.hashes[i] = kind, xxhash.xxh64_intdigest(low)
        self.wide[i] = NUMBER if low in NUMBERS else CAPITAL if kind == CAPITAL and low not in FUNCTION else WORD
        return i

    def read(self, texts: list[str]):
        """The texts' tokens, the text of each, and for each reading the tokens that count, their slot kinds (WORD if none) and the hashes of their template tokens. Texts are read together, as arrays of few tokens cost more time than they save."""
        if len(self) > KNOWN:
            self.clear()
        tokens, ends = [], []
        for text in texts:
            tokens += TOKENS(text)
            tokens.append(BREAK)
            ends.append(len(tokens))
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        kind, words, wide = self.kinds[ids], self.hashes[ids], self.wide[ids]
        before = np.roll(kind, 1)  # the last of all is a break, so the first begins a sentence
        slot = np.zeros(len(ids), np.int8)
        slot[(kind == CAPITAL) & (before != END)] = CAPITAL
        slot[kind == NUMBER] = NUMBER
        slot[((kind == UNIT) | (kind == SYMBOL)) & (before == NUMBER)] = UNIT
        slot[(kind == END) | (kind == SYMBOL) & (before != NUMBER)] = END
        more = np.where((wide == NUMBER) | (slot == WORD), wide, slot)
        more[(more == WORD) & (kind == UNIT) & (np.roll(wide, 1) == NUMBER)] = UNIT
        keep = np.flatnonzero(slot != END)
        plain = keep[kind[keep] != SIGN]
        narrow, broad = ((keep, k, np.where(k == WORD, words[keep], SLOT_HASHES[k])) for k in (slot[keep], more[keep]))
        return tokens, np.repeat(np.arange(len(texts)), np.diff([0, *ends])), [narrow, (plain, np.zeros(len(plain), np.int8), words[plain]), broad]


def windows(text: np.ndarray, slot: np.ndarray, hashes: np.ndarray, size: int, reading: int = 0) -> np.ndarray:
    """The hash of each window, unlike in each reading; zero if it has too few plain words or goes on in another text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, reading, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += mixed[i : i + n]
    out ^= out >> np.uint64(31)
    out[text[:n] != text[size - 1 :]] = 0
    if slot.any():
        plain = np.cumsum(np.r_[0, slot == WORD])
        out[plain[size:] - plain[:-size] < min(LITERALS, size)] = 0
    return out


def _window_row(tokens: list[str], slots: list[int], reading: int) -> tuple[str, str]:
    """A window's template, and its slots' values as kind=value lines."""
    low = [t.lower() for t in tokens]
    return READINGS[reading] + " ".join(SLOTS.get(k, t) for k, t in zip(slots, low)), "\n".join(f"{SLOTS[k]}={t}" for k, t in zip(slots, low) if k != WORD)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """h, template, item_id, item_at, nth (of the item's usable windows), item_slots, size, n_windows of the items."""
    small_batches(benchmark.sparkSession)
    kind = dict(benchmark.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates()
        for b in batches:
            out = [[] for _ in range(9)]
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                tokens, of, readings = own.read([text])
                for reading, (keep, slot, hashes) in enumerate(readings):
                    size = min(WINDOW, len(keep))
                    if size < LITERALS:
                        continue
                    h = windows(of[keep], slot, hashes, size, reading)
                    good = np.flatnonzero(h).tolist()
                    for nth, at in enumerate(good):
                        row = _window_row([tokens[i] for i in keep[at : at + size]], slot[at : at + size].tolist(), reading)
                        for col, v in zip(out, (int(h[at].astype(np.int64)), *row, item, at, size, len(good), reading, nth)):
                            col.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), b.schema.field("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["h", "template", "item_slots", "item_id", "item_at", "size", "n_windows", "reading", "nth"])

    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).dropDuplicates(["item_id", "text"])
    return rows.mapInArrow(run, f"h bigint, template string, item_slots string, item_id {kind}, item_at int, size int, n_windows int, reading int, nth int")


def document_windows(docs: DataFrame, sizes: list[int], among: np.ndarray | None) -> DataFrame:
    """doc_id, of_text (a hash of the text), h, template, doc_slots, doc_at of the windows of docs; among: sorted hashes, others are left out."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates()
        if among is not None:  # most windows are ruled out by a bit of their hash's end
            maybe = np.zeros(1 << 22, bool)
            maybe[among & np.uint64((1 << 22) - 1)] = True
        for b in batches:
            rows = [[] for _ in range(5)]
            texts = b.column("text").to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // TOGETHER
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                tokens, of, readings = own.read([texts[i] for i in some])
                for reading, (keep, slot, hashes) in enumerate(readings):
                    text = of[keep]
                    first = np.searchsorted(text, np.arange(len(some)))
                    for size in sizes:
                        h = windows(text, slot, hashes, size, reading)
                        if among is None:
                            good = np.flatnonzero(h)
                        else:
                            good = np.flatnonzero(maybe[h & np.uint64((1 << 22) - 1)] & (h != 0))
                            good = good[among[np.minimum(np.searchsorted(among, h[good]), len(among) - 1)] == h[good]] if len(good) else good
                        for at in good.tolist():
                            row = _window_row([tokens[i] for i in keep[at : at + size]], slot[at : at + size].tolist(), reading)
                            for col, v in zip(rows, (some[text[at]], int(h[at].astype(np.int64)), *row, at - first[text[at]])):
                                col.append(v)
            take = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("of_text").take(take), *(pa.array(c, k) for c, k in zip(rows[1:], (pa.int64(), pa.string(), pa.string(), pa.int32())))],
                ["doc_id", "of_text", "h", "template", "doc_slots", "doc_at"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("of_text", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, of_text bigint, h bigint, template string, doc_slots string, doc_at int")


def matches(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, of_text, item_id, containment of each document and item that it contains."""
    items = materialize(item_windows(benchmark), "items")
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("template") + F.length("item_slots") + 64).alias("bytes"), F.collect_set("size").alias("sizes")).first()  # at most WINDOW sizes
    among = None
    if few := size["rows"] <= IN_WORKERS and (size["bytes"] or 0) <= IN_BYTES:
        among = np.unique(np.array([0, *(r["h"] for r in items.select("h").distinct().collect())], np.int64).view(np.uint64))
    found = document_windows(docs, sorted(size["sizes"]), among)
    if few:
        pairs = found.join(F.broadcast(items), ["h", "template"])
    else:
        found = materialize(found, "windows")
        by_hash = items.groupBy("h").agg(F.collect_list(F.struct(*[c for c in items.columns if c != "h"])).alias("items"))
        pairs = skew_join(found.withColumnRenamed("template", "doc_template"), by_hash, "h", found.count(), "inner").select("doc_id", "of_text", "doc_at", "doc_slots", "doc_template", F.inline("items")).where("template = doc_template")
    pairs = pairs.select("doc_id", "of_text", "item_id", "reading", "n_windows", "size", "nth", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), "item_at", F.arrays_zip(F.split("item_slots", "\n").alias("i"), F.split("doc_slots", "\n").alias("d")).alias("slots"))
    by = ["doc_id", "of_text", "item_id", "reading", "diagonal"]
    distinct = F.array_distinct(F.flatten(F.collect_set("slots")))
    lines = pairs.groupBy(*by).agg(distinct.alias("slots"), F.collect_set("item_at").alias("places"), F.sort_array(F.collect_set(F.struct("nth", "item_at", "size"))).alias("run"), F.max("n_windows").alias("n_windows"))
    one_to_one = "size(array_distinct(transform({0}, s -> s.i))) = size({0}) and size(array_distinct(transform({0}, s -> s.d))) = size({0})"
    # words that the longest run of windows, each the item's next usable one, covers
    run = F.expr(f"""aggregate(run, named_struct('nth', -9, 'stop', -9, 'words', 0, 'most', 0), (a, x) -> named_struct('nth', x.nth, 'stop', x.item_at + x.size,
        'words', if(x.nth = a.nth + 1, a.words + x.item_at + x.size - greatest(a.stop, x.item_at), x.size),
        'most', greatest(a.most, if(x.nth = a.nth + 1, a.words + x.item_at + x.size - greatest(a.stop, x.item_at), x.size)))).most""")
    # the diagonals whose slots agree, longest first
    both = "array_distinct(concat(a.slots, x.slots))"
    places = F.expr(f"""size(aggregate(array_sort(parts), named_struct('slots', slice(parts[0].slots, 1, 0), 'places', slice(parts[0].places, 1, 0)),
        (a, x) -> if({one_to_one.format(both)}, named_struct('slots', {both}, 'places', array_union(a.places, x.places)), a)).places)""")
    whole = lines.where(one_to_one.format("slots")).withColumn("run", run).groupBy("doc_id", "of_text", "item_id", "reading")
    whole = whole.agg(F.collect_list(F.struct((-F.size("places")).alias("order"), "diagonal", "slots", "places")).alias("parts"), F.max("n_windows").alias("n_windows"), F.max("run").alias("run")).withColumn("n", places)
    whole = whole.groupBy("doc_id", "of_text", "item_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("containment"), F.max("run").alias("run"))
    return whole.where((F.col("containment") >= containment) | (F.col("run") >= RUN)).select("doc_id", "of_text", "item_id", "containment")


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id (the item most of which it contains, of equal ones the first), containment, n_items of every row."""
    best = F.min_by("item_id", F.struct(-F.col("containment"), "item_id"))
    hits = matches(docs, benchmark).groupBy(F.col("doc_id").alias("id_"), F.col("of_text").alias("of_")).agg(best.alias("item_id"), F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_items"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("of_text"))
    both = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("of_text") == F.col("of_")), "left")
    return both.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), "item_id", F.coalesce("containment", F.lit(0.0)).alias("containment"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with the columns of docs. Edge cases are those of the module; rows with one id and unlike texts are judged apart."""
    hits = matches(docs, benchmark).select(F.col("doc_id").alias("id_"), F.col("of_text").alias("of_")).distinct()
    own = docs.columns
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").alias("id"), text.alias("of"))
    return rows.join(hits, F.col("id").eqNullSafe(F.col("id_")) & (F.col("of") == F.col("of_")), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in own])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
