"""python -m slipworks list | run QUERY FOLDER OUT [--format parquet|csv|json] [--cpus N]"""

from __future__ import annotations

import argparse
import importlib.util


def main(arguments: list[str] | None = None) -> int:
    from slipworks.plans import registry
    from slipworks.session import clean, local_session, reachable

    known = registry.queries()
    if getattr(importlib.util.find_spec("__spark_entry__"), "origin", None):
        known = importlib.import_module("__spark_entry__").queries()  # with those of subpackages
    parser = argparse.ArgumentParser(prog="slipworks", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the names of all queries")
    run = commands.add_parser("run", help="runs a query over a folder of tables and stores its result")
    run.add_argument("query", choices=sorted(known), metavar="QUERY")
    run.add_argument("folder")
    run.add_argument("out")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--cpus", type=int, default=8)
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(known)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or local_session(given.cpus)
    reachable(spark)
    result = known[given.query](spark, given.folder)
    result.write.mode("errorifexists").options(**({"header": "true"} if given.format == "csv" else {})).format(given.format).save(given.out)
    clean(spark)
    print(f"{given.query}: {spark.read.format(given.format).options(**({'header': 'true'} if given.format == 'csv' else {})).load(given.out).count()} rows in {given.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
