"""Run and judgment files: lenient and strict readers, and writers. Readers are text scans and column expressions; strict ones return violations as rows instead of stopping at the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import rank_within

ID = r"^[\x21-\x7E]+$"


def _fields(lines: DataFrame, n: int) -> DataFrame:
    """lines(value, ...) with f, the fields of lines that have at least n."""
    return lines.withColumn("f", F.split(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), " +")).where(F.size("f") >= n)


def parse_runs(lines: DataFrame) -> DataFrame:
    """lines(value[, source]) of `qid Q0 docid rank score tag` to runs; shorter lines are skipped, bad numbers raise, and ranks become dense from 0 in the stored order (ties by docid). The source is the tag if lines have none."""
    source = F.col("source") if "source" in lines.columns else F.element_at("f", 6)
    rows = _fields(lines, 6).select(F.element_at("f", 1).alias("qid"), source.alias("source"), F.element_at("f", 3).alias("docid"), F.element_at("f", 4).cast("int").alias("stored"), F.element_at("f", 5).cast("double").alias("score"))
    return rank_within(rows, ["qid", "source"], [F.asc("stored"), F.asc("docid")]).select("qid", "source", "docid", "rank", "score")


def read_lines(spark: SparkSession, path) -> DataFrame:
    """value, source (the file's name up to its first dot) and line_no, a struct that orders the lines of a file (its name, the split's start, and a number that grows within the split) of text files: a path, glob or list of them, gzip too."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("source"), place.alias("line_no"))


def oversized(spark: SparkSession, path, limit: int) -> DataFrame:
    """file, bytes of files whose decoded text is longer than a limit; lines are counted in their tasks and never held."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.octet_length("value") + 1).alias("n"))
    return rows.groupBy("file").agg(F.sum("n").alias("bytes")).where(F.col("bytes") > limit)


def read_runs(spark: SparkSession, path) -> DataFrame:
    """Run files; the source is the file's name up to its first dot."""
    return parse_runs(read_lines(spark, path))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """lines(value[, line_no]) of `qid round docid grade` to qrels; of repeated pairs the last line counts (the greatest grade if lines have no number)."""
    order = F.col("line_no") if "line_no" in lines.columns else F.element_at("f", 4).cast("int")
    rows = _fields(lines, 4).select(F.element_at("f", 1).alias("qid"), F.element_at("f", 3).alias("docid"), F.element_at("f", 4).cast("int").alias("grade"), order.alias("at"))
    return rows.groupBy("qid", "docid").agg(F.max_by("grade", "at").alias("grade"))


def read_qrels(spark: SparkSession, path) -> DataFrame:
    """Judgment files; of repeated pairs the last line counts."""
    return parse_qrels(read_lines(spark, path))


def parse_judgments(lines: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """lines(value) of `qid round docid grade` to qid, round (as text), docid, grade of every line of four fields; with inventory(docid) those of other documents are left out."""
    f = F.split(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), " +")
    rows = lines.select(f.alias("f")).where(F.size("f") == 4).select(F.element_at("f", 1).alias("qid"), F.element_at("f", 2).alias("round"), F.element_at("f", 3).alias("docid"), F.expr("try_cast(f[3] as int)").alias("grade"))
    return rows if inventory is None else rows.join(inventory.select("docid").distinct(), "docid", "left_semi").select("qid", "round", "docid", "grade")


def judged_pairs(lines: DataFrame) -> DataFrame:
    """qid, docid, copies of the pairs that lines(value) judge, whatever their grade; more than one copy is a fault."""
    return parse_judgments(lines).groupBy("qid", "docid").agg(F.count(F.lit(1)).alias("copies"))


def qrels_violations(lines: DataFrame, grades: tuple[int, ...] = (0, 1, 2, 3), rounds: bool = False, queries: DataFrame | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """lines(value) to qid, docid, problem of everything strict judgments may not have: a wrong number of fields, an id that isn't printable ASCII, a grade outside grades, a pair twice, with rounds a round that isn't a decimal above zero, and, where given, a query or document outside queries(qid) or inventory(docid), or a query of queries without judgments (missing). Blank lines are skipped. Grade 0 is a judgment; an absent pair is none."""
    f = F.split(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), " +")
    parts = lines.where(F.trim("value") != "").select(f.alias("f"))
    none = F.lit(None).cast("string")
    bad = parts.where(F.size("f") != 4).select(none.alias("qid"), none.alias("docid"), F.lit("fields").alias("problem"))
    rows = parts.where(F.size("f") == 4).select(F.element_at("f", 1).alias("qid"), F.element_at("f", 2).alias("round"), F.element_at("f", 3).alias("docid"), F.element_at("f", 4).alias("grade"))
    rows = rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("qid", "docid")))
    known = lambda df, key, name: rows.join(df.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    if queries is not None:
        rows = known(queries, "qid", "has_query")
    if inventory is not None:
        rows = known(inventory, "docid", "has_document")
    checks = [
        F.when(~(F.col("docid").rlike(ID) & F.col("qid").rlike(ID)), "id"),
        F.when(~F.coalesce(F.expr("try_cast(grade as int)").isin(list(grades)) & F.col("grade").rlike(r"^\d+$"), F.lit(False)), "grade"),
        F.when(F.col("copies") > 1, "duplicate"),
    ]
    if rounds:
        checks.append(F.when(~(F.col("round").rlike(r"^\+?(\d+\.?\d*|\.\d+)$") & F.col("round").rlike("[1-9]")), "round"))
    if queries is not None:
        checks.append(F.when(F.col("has_query").isNull(), "query"))
    if inventory is not None:
        checks.append(F.when(F.col("has_document").isNull(), "document"))
    found = bad.unionByName(rows.select("qid", "docid", F.explode(F.array_compact(F.array(*checks))).alias("problem")))
    if queries is not None:
        found = found.unionByName(queries.select("qid").distinct().join(rows.select("qid"), "qid", "left_anti").select("qid", none.alias("docid"), F.lit("missing").alias("problem")))
    return found


def parse_inventory(lines: DataFrame, form: str = "token") -> DataFrame:
    """docid of lines(value): token (a line's only token), line (the whole line as it is) or trimmed (the line without blanks around it)."""
    value = {"token": F.trim("value"), "line": F.col("value"), "trimmed": F.trim("value")}[form]
    rows = lines.select(value.alias("docid")).where("docid <> ''")
    return (rows.where(~F.col("docid").contains(" ")) if form == "token" else rows).distinct()


def inventory_violations(lines: DataFrame) -> DataFrame:
    """docid, problem of lines that aren't one printable ASCII token, or that repeat one; an empty inventory has the problem empty."""
    rows = lines.select(F.trim("value").alias("docid")).groupBy("docid").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(~F.col("docid").rlike(ID), "id").when(F.col("n") > 1, "duplicate")
    empty = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("docid"), F.lit("empty").alias("problem"))
    return rows.select("docid", problem.alias("problem")).where("problem is not null").unionByName(empty)


def tagged_violations(lines: DataFrame, inventory: DataFrame | None = None, queries: DataFrame | None = None, depth: int = 1000) -> DataFrame:
    """lines(value, source) of decimal-scored runs, bound to the tag source, to source, qid, docid, problem: fields, tag, number (a score that isn't a finite decimal), rank (not an ASCII whole number of at least 0), duplicate, document or query (outside inventory(docid) or queries(qid)), depth (a query of more than depth rows, or one of queries that the source lacks). Supplied ranks only need to be numbers; order is by score."""
    none = F.lit(None).cast("string")
    parts = lines.select("source", F.split(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), " +").alias("f"))
    bad = parts.where(F.size("f") != 6).select("source", none.alias("qid"), none.alias("docid"), F.lit("fields").alias("problem"))
    rows = parts.where(F.size("f") == 6).select("source", *[F.element_at("f", i).alias(c) for i, c in enumerate(("qid", "unused", "docid", "rank", "score", "tag"), 1)])
    rows = rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("source", "qid", "docid")))
    checks = [
        F.when((F.col("tag") != F.col("source")) | ~F.col("unused").rlike(ID) | ~F.col("docid").rlike(ID), "tag"),
        F.when(~F.col("score").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number"),
        F.when(~F.col("rank").rlike(r"^\+?[0-9]+$"), "rank"),
        F.when(F.col("copies") > 1, "duplicate"),
    ]
    if inventory is not None:
        rows = rows.join(inventory.select("docid").distinct().withColumn("has_document", F.lit(True)), "docid", "left")
        checks.append(F.when(F.col("has_document").isNull(), "document"))
    if queries is not None:
        rows = rows.join(queries.select("qid").distinct().withColumn("has_query", F.lit(True)), "qid", "left")
        checks.append(F.when(F.col("has_query").isNull(), "query"))
    found = bad.unionByName(rows.select("source", "qid", "docid", F.explode(F.array_compact(F.array(*checks))).alias("problem")))
    sizes = rows.groupBy("source", "qid").agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(sizes.where(F.col("n") > depth).select("source", "qid", none.alias("docid"), F.lit("depth").alias("problem")))
    if queries is not None:
        every = lines.select("source").distinct().join(queries.select("qid").distinct(), F.lit(True))  # each list must answer each query
        found = found.unionByName(every.join(sizes, ["source", "qid"], "left_anti").select("source", "qid", none.alias("docid"), F.lit("depth").alias("problem")))
    return found


def read_qrels_tsv(spark: SparkSession, path) -> DataFrame:
    """Binary judgments with the header query-id, corpus-id, score."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    if rows.columns != ["query-id", "corpus-id", "score"]:
        raise ValueError(f"unlike header: {rows.columns}")
    return rows.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("docid"), F.col("score").cast("int").alias("grade"))


def read_candidates(spark: SparkSession, path) -> DataFrame:
    """qid, pid, query, passage of a file of four tab-separated columns."""
    return spark.read.csv(path, sep="\t", quote="", schema="qid string, pid string, query string, passage string")


def first_queries(lines: DataFrame) -> DataFrame:
    """lines(value, line_no) of four tab-separated columns to qid, query: the text of the query's first line."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) == 4).select(f[0].alias("qid"), f[2].alias("query"), "line_no")
    return rows.groupBy("qid").agg(F.min_by("query", "line_no").alias("query"))


CACHE = "query struct<qid string, text string>, candidates array<struct<docid string, score double, doc struct<_id string, title string, text string>>>"


def read_cache(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Retrieval caches (JSON lines) as runs, ranks by place, and texts(docid, title, text)."""
    rows = spark.read.schema(CACHE).json(path).select("query.qid", F.posexplode("candidates").alias("rank", "c"))
    return rows.select("qid", F.lit("cache").alias("source"), "c.docid", "rank", "c.score"), rows.select("c.docid", "c.doc.title", "c.doc.text").dropDuplicates(["docid"])


def cache_lines(spark: SparkSession, path, tag: str) -> DataFrame:
    """Retrieval caches as run lines(value), ranks from 1 in the stored order, so ties keep it."""
    runs, _ = read_cache(spark, path)
    return runs.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", (F.col("rank") + 1).cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def cache_mismatches(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """docid, problem of texts(docid, title, text) that the corpus(_id, title, text) lacks (missing) or has otherwise (text)."""
    own = corpus.select(F.col("_id").alias("docid"), F.struct("title", "text").alias("theirs"))
    both = texts.select("docid", F.struct("title", "text").alias("ours")).join(own, "docid", "left")
    problem = F.when(F.col("theirs").isNull(), "missing").when(~F.col("ours").eqNullSafe(F.col("theirs")), "text")
    return both.select("docid", problem.alias("problem")).where("problem is not null")


def component_violations(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, runs: DataFrame) -> DataFrame:
    """problem, id: judged documents or run documents that corpus(_id) lacks, judged queries or run queries that queries(qid) lacks."""
    docs, known = corpus.select(F.col("_id").alias("docid")), queries.select("qid")
    out = None
    for name, rows in (("qrels", qrels), ("runs", runs)):
        for key, side in (("docid", docs), ("qid", known)):
            got = rows.select(key).distinct().join(side, key, "left_anti").select(F.lit(f"{name} {key}").alias("problem"), F.col(key).alias("id"))
            out = got if out is None else out.unionByName(got)
    return out


def read_text_table(spark: SparkSession, path) -> DataFrame:
    """A Parquet corpus of exactly _id, title and text."""
    rows = spark.read.parquet(path)
    if rows.dtypes != [("_id", "string"), ("title", "string"), ("text", "string")]:
        raise ValueError(f"unlike columns: {rows.dtypes}")
    return rows


def content_identity(spark: SparkSession, path) -> DataFrame:
    """path, bytes, sha256, md5 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def violations(lines: DataFrame, origin: int = 1) -> DataFrame:
    """lines(value[, source]) to [source,] qid, docid, problem of everything a strict run may not have: a wrong number of fields, an id that isn't printable ASCII, a number that isn't finite, a document twice, a gap in ranks, a score above the one before. With a source each is a run of its own."""
    f = F.split(F.trim("value"), " +")
    own = ["source"] if "source" in lines.columns else []
    parts = lines.select(*own, f.alias("f"), "value")
    bad = parts.where(F.size("f") != 6).select(*own, F.lit(None).cast("string").alias("qid"), F.lit(None).cast("string").alias("docid"), F.lit("fields").alias("problem"))
    rows = parts.where(F.size("f") == 6).select(*own, F.element_at("f", 1).alias("qid"), F.element_at("f", 3).alias("docid"), F.expr("try_cast(f[3] as int)").alias("rank"), F.expr("try_cast(f[4] as double)").alias("score"))
    by_rank = Window.partitionBy(*own, "qid").orderBy("rank", "docid")
    rows = rows.withColumn("at", F.row_number().over(by_rank) - 1 + origin).withColumn("above", F.lag("score").over(by_rank)).withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*own, "qid", "docid")))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    problems = F.array_compact(
        F.array(
            F.when(~(F.col("docid").rlike(ID) & F.col("qid").rlike(ID)), "id"),
            F.when(~finite | F.col("rank").isNull(), "number"),
            F.when(F.col("copies") > 1, "duplicate"),
            F.when(F.col("rank") != F.col("at"), "rank"),
            F.when(F.col("score") > F.col("above"), "order"),
        )
    )
    return bad.unionByName(rows.select(*own, "qid", "docid", F.explode(problems).alias("problem")))


def format_runs(runs: DataFrame, origin: int = 0) -> DataFrame:
    """runs to lines(value); scores with six decimals."""
    return runs.select(F.format_string("%s Q0 %s %d %.6f %s", "qid", "docid", F.col("rank") + origin, "score", "source").alias("value"))


def write_runs(runs: DataFrame, path: str) -> None:
    """One folder for each source; lines in the order of queries and ranks within a file. Refuses to overwrite."""
    number = F.expr("try_cast(qid as bigint)")
    rows = runs.repartitionByRange("source", number, "qid").sortWithinPartitions("source", number, "qid", "rank")
    rows.select("source", F.format_string("%s Q0 %s %d %.6f %s", "qid", "docid", "rank", "score", "source").alias("value")).write.mode("errorifexists").partitionBy("source").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys. Refuses to overwrite."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def rank_exact_scores(lines: DataFrame, depth: int | None = None) -> DataFrame:
    """lines(value) of six fields with decimal scores of any length to qid, source, docid, rank, score_text, moved: ranked by exact score, then docid; the stored rank is ignored but compared (moved). A score that isn't a decimal raises."""
    from rankloom.functions.text import decimal_key

    rows = _fields(lines, 6).select(F.element_at("f", 1).alias("qid"), F.element_at("f", 6).alias("source"), F.element_at("f", 3).alias("docid"), F.element_at("f", 4).cast("int").alias("stored"), F.element_at("f", 5).alias("score_text"))
    key = F.coalesce(decimal_key(F.col("score_text")), F.raise_error(F.concat(F.lit("not a decimal: "), "score_text")).cast("struct<size:int,whole:string,part:string>"))
    ranked = rank_within(rows.withColumn("key", key), ["qid", "source"], [F.desc("key"), F.asc("docid")], depth)
    return ranked.select("qid", "source", "docid", "rank", "score_text", (F.col("stored") != F.col("rank")).alias("moved"))


def json_problems(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """lines(value) to value, problem of lines that aren't strict JSON objects: syntax, duplicate (a key twice, at any depth), or keys (not exactly those given). Spark's reader takes the last of duplicate keys silently, so this one parses in Python, by Arrow batches."""
    import json

    import pandas as pd

    class Twice(ValueError):
        pass

    def once(pairs):
        found = dict(pairs)
        if len(found) < len(pairs):
            raise Twice
        return found

    def problem(text):
        try:
            got = json.loads(text, object_pairs_hook=once)
        except Twice:
            return "duplicate"
        except (TypeError, ValueError):
            return "syntax"
        return "keys" if not isinstance(got, dict) or keys is not None and sorted(got) != sorted(keys) else None

    def run(batches):
        for b in batches:
            out = pd.DataFrame({"value": b["value"], "problem": [problem(x) for x in b["value"]]})
            yield out[out["problem"].notna()]

    return lines.select("value").mapInPandas(run, "value string, problem string")
