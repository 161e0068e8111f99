"""Evaluates run files: python -m rankloom --qrels FILE --runs FILE... [--k 60] [--fusion rrf v5 ...] [--demo]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rankloom.operators import consensus, fusion, metrics, ranking
from rankloom.sources import trec


def main() -> None:
    p = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    p.add_argument("--qrels")
    p.add_argument("--runs", nargs="+")
    p.add_argument("--k", type=int, default=60)
    p.add_argument("--fusion", nargs="+", default=["rrf", "v21", "v3", "v5", "ref_scoremix"], help="rrf, v21, v3, " + ", ".join([*consensus.VARIANTS, *consensus.ALPHA]))
    p.add_argument("--demo", action="store_true", help="synthetic runs and judgments")
    args = p.parse_args()
    if not args.demo and not (args.qrels and args.runs):
        p.error("give --qrels and --runs, or --demo")
    spark = SparkSession.builder.appName("rankloom").getOrCreate()
    runs, qrels = fusion.demo_runs(spark) if args.demo else (trec.read_runs(spark, args.runs), trec.read_qrels(spark, args.qrels))
    sources = [r["source"] for r in runs.select("source").distinct().orderBy("source").collect()]  # one for each run file
    runs = runs.join(ranking.cohort(runs, qrels, sources), "qid", "left_semi")
    runs = ranking.judged(runs, qrels)
    rankings = {name: fusion.rrf(runs, args.k) if name == "rrf" else consensus.fuse(runs, sources, name, args.k) for name in args.fusion}
    metrics.report(rankings, qrels).show(len(rankings), truncate=False)


if __name__ == "__main__":
    main()
