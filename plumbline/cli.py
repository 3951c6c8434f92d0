"""python -m plumbline.cli COMMAND ...: the engine over files. Tables are Parquet; results are shown or, with --out, written."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from plumbline import engine


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    commands = {
        "check": ["plans", "rules", "municipality"],
        "ingest": ["pages", "library", "municipality"],
        "library": ["library"],
        "search": ["chunks", "query"],
        "evaluate": ["truth", "predictions"],
    }
    for name, arguments in commands.items():
        one = sub.add_parser(name)
        for a in arguments:
            one.add_argument(a)
        one.add_argument("--out", help="folder to write Parquet to")
    return top


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """The result of a command line."""
    a = _parser().parse_args(arguments)
    read = spark.read.parquet
    if a.command == "check":
        found = engine.check_ruleset(spark, read(a.plans), a.rules, a.municipality)["results"]
    elif a.command == "ingest":
        found = engine.ingest(spark, read(a.pages), a.library, a.municipality)
    elif a.command == "library":
        found = engine.library(spark, a.library)
    elif a.command == "search":
        found = engine.search(read(a.chunks), spark.createDataFrame([(0, a.query)], "query_id long, query string"))
    else:
        found = engine.evaluate(read(a.truth), read(a.predictions))
    if a.out:
        found.write.mode("overwrite").parquet(a.out)
        return spark.read.parquet(a.out)
    return found


def main() -> None:
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:]).show(truncate=False)


if __name__ == "__main__":
    main()
