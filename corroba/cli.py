"""Command line: ``python -m corroba.cli list | rules | run QUERY DATA [OUT]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corroba")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("rules", help="the rule registry")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("out", nargs="?", help="a folder for Parquet files; without it the first rows are shown")
    args = parser.parse_args(given)

    from corroba.plans.queries import QUERIES
    from corroba.rules.labels import RULES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
    elif args.command == "rules":
        for rule, (kind, attributes) in sorted(RULES.items()):
            print(rule, kind, ",".join(attributes))
    else:
        if args.query not in QUERIES:
            parser.error(f"no query {args.query}")
        found = QUERIES[args.query](SparkSession.builder.appName(f"corroba {args.query}").getOrCreate(), args.data)
        found.write.parquet(args.out) if args.out else found.show()


if __name__ == "__main__":
    main()
