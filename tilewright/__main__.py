"""``python -m tilewright list`` and ``python -m tilewright run QUERY --data FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse

from . import plans


def main(arguments: list[str] | None = None) -> int:
    known = plans.registered()
    parser = argparse.ArgumentParser(prog="tilewright", description="Run a registered query over the tables of a folder.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query and write or show its result")
    run.add_argument("query", choices=sorted(known), metavar="QUERY")
    run.add_argument("--data", required=True, help="folder of NAME.parquet tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it 20 rows are shown")
    options = parser.parse_args(arguments)
    if options.command == "list":
        print("\n".join(sorted(known)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tilewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = known[options.query][0](spark, options.data)
    if options.out:
        result.write.mode("errorifexists").parquet(options.out)
    else:
        result.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
