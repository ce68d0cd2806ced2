"""Command line: ``python -m textmill rank|extract|cite|query|list ...``. Exit 0 done, 1 nothing to show, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textmill")
    commands = parser.add_subparsers(dest="command", required=True)
    rank = commands.add_parser("rank", help="rank documents (Parquet or JSON lines with url, title, headings, text) for a question")
    rank.add_argument("--query", required=True)
    rank.add_argument("--docs", required=True)
    rank.add_argument("--limit", type=int)
    text = commands.add_parser("extract", help="text, title and extractor of the files below a path")
    text.add_argument("path")
    cite = commands.add_parser("cite", help="claims and citation tokens of the reports below a path")
    cite.add_argument("path")
    cite.add_argument("--token", help="regular expression of a citation token")
    one = commands.add_parser("query", help="run a registered query over a folder of tables")
    one.add_argument("name")
    one.add_argument("folder")
    one.add_argument("--rows", type=int, default=20, help="how many rows to print")
    commands.add_parser("list", help="names of the registered queries")
    args = parser.parse_args(argv)
    from textmill.plans.registry import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    if args.command == "query" and args.name not in QUERIES:
        print(f"textmill: no query {args.name}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args.command == "query":
        out = QUERIES[args.name](spark, args.folder).limit(args.rows)
    elif args.command == "extract":
        from textmill.sources.store import local_documents

        out = local_documents(spark, args.path).select("url", "title", "extractor", "note", "text")
    elif args.command == "cite":
        from textmill.functions import citations

        reports = spark.read.text(args.path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("r"))
        told = citations.collect_citations("r", args.token or citations.SOURCE_TOKEN)
        out = reports.select("path", F.size(citations.claim_units_column("r")).alias("claims"), told.alias("t")).select("path", "claims", "t.grounding", "t.inert_only")
    else:
        from textmill.operators.ranking import rank_documents

        docs = spark.read.json(args.docs) if args.docs.endswith((".json", ".jsonl")) else spark.read.parquet(args.docs)
        if "url" not in docs.columns:
            print("textmill: documents need a url", file=sys.stderr)
            return 2
        for c in ("title", "headings", "text"):
            docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
        out = rank_documents(docs.where("url is not null and url <> ''"), args.query, args.limit)
    shown = 0
    for r in out.toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))
        shown += 1
    return 0 if shown else 1


if __name__ == "__main__":
    sys.exit(main())
