"""Command line: ``python -m attestry resolve REQUESTS CATALOG OUT [--flows F] [--edges E] [--min-score X]`` and ``python -m attestry query NAME TABLES OUT``.

Tables are Parquet, or JSON lines where the path ends in .json or .jsonl; results are Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="attestry")
    commands = parser.add_subparsers(dest="command", required=True)
    r = commands.add_parser("resolve", help="decide every request against a catalogue")
    for name in ("requests", "catalog", "out"):
        r.add_argument(name)
    r.add_argument("--flows")
    r.add_argument("--edges")
    r.add_argument("--min-score", type=float)
    q = commands.add_parser("query", help="run a registered query over a folder of tables")
    for name in ("name", "tables", "out"):
        q.add_argument(name)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("attestry").getOrCreate()
    if a.command == "resolve":
        from attestry.operators.decide import decide

        more = {"least_score": a.min_score} if a.min_score is not None else {}
        found = decide(load(spark, a.requests), load(spark, a.catalog), *[load(spark, p) if p else None for p in (a.flows, a.edges)], **more)
    else:
        from attestry import queries, queries_catalog, queries_ledger  # noqa: F401

        if a.name not in queries.QUERIES:
            parser.error(f"no query {a.name}; there are {', '.join(sorted(queries.QUERIES))}")
        found = queries.QUERIES[a.name](spark, a.tables)
    found.write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()
