"""python -m tesserae.cli: ingest a folder, search it, run guarded SQL, summarise an evaluation."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.operators import chunking, index, retrieval
from tesserae.plans.guard import Sandbox
from tesserae.sources import formats, golden, ingest


def build(spark: SparkSession, folder: str, out: str) -> dict:
    """Files to chunks under ``out``; failures are counted, not raised."""
    parsed = ingest.parse(formats.scan(spark, folder)).cache()
    elements = parsed.filter("kind NOT IN ('error', 'symbol', 'sheet_row')")
    made = chunking.chunks(chunking.sections(elements.withColumn("seq", F.col("seq").cast("long"))))
    made.write.mode("overwrite").parquet(f"{out}/chunks")
    parsed.filter("kind = 'symbol'").write.mode("overwrite").parquet(f"{out}/symbols")
    counts = {r.kind: r["count"] for r in parsed.groupBy("kind").count().collect()}
    parsed.unpersist()
    return counts


def find(spark: SparkSession, out: str, question: str, mode: str, k: int) -> list[dict]:
    chunks = spark.read.parquet(f"{out}/chunks")
    hits = retrieval.hits(chunks, spark.createDataFrame([(1, question)], "qid long, question string"), mode)
    kept = index.diversify(hits, top=k).orderBy("place").select("chunk_id", "score", F.substring("text", 1, 200).alias("text"))
    return [r.asDict() for r in kept.collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae")
    verbs = parser.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("ingest")
    p.add_argument("folder")
    p.add_argument("out")
    p = verbs.add_parser("search")
    p.add_argument("out")
    p.add_argument("question")
    p.add_argument("--mode", default="hybrid", choices=["hybrid", "dense", "sparse"])
    p.add_argument("-k", type=int, default=6)
    p = verbs.add_parser("sql")
    p.add_argument("query")
    p.add_argument("tables", nargs="+", help="name=path of a Parquet table")
    p = verbs.add_parser("eval")
    p.add_argument("golden")
    p.add_argument("answers")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "ingest":
        result: object = build(spark, a.folder, a.out)
    elif a.verb == "search":
        result = find(spark, a.out, a.question, a.mode, a.k)
    elif a.verb == "sql":
        frames = {n: spark.read.parquet(p) for n, _, p in (t.partition("=") for t in a.tables)}
        with Sandbox(spark, frames) as box:
            result = box.run(a.query)
    else:
        result = golden.report(golden.judge(golden.read_golden(spark, a.golden), spark.read.parquet(a.answers)))
    print(json.dumps(result, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
