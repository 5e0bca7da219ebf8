"""Commands over stored tables: ``python -m tenderline init|import|enrich --root FOLDER ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Engine

#: Fields that a contract's lookup may fill.
FOUND = ["contract_method"]


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tenderline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("init", "make empty tables where there are none"), ("import", "store a contract index (CSV)"), ("enrich", "store found values (Parquet with id and fields) and log them")):
        c = commands.add_parser(name, help=about)
        c.add_argument("--root", required=True, help="folder of the tables, shared by all executors")
        if name != "init":
            c.add_argument("path")
        if name == "enrich":
            c.add_argument("--fields", default=",".join(FOUND), help="columns to take, joined by commas")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command and prints one line of JSON; 1 if nothing could be stored for errors."""
    args = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("tenderline").getOrCreate()
    engine, state = Engine(spark, args.root), {}
    if args.command == "init":
        state = {"created": engine.init()}
    elif args.command == "import":
        state = engine.import_index(args.path)
    else:
        found = spark.read.parquet(args.path)
        engine.enrich(found, args.fields.split(","))
        state = {"logged": found.count()}
    print(json.dumps(state))
    return int(state.get("status") == "failed")


if __name__ == "__main__":
    sys.exit(main())
