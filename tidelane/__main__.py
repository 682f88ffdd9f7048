"""Command line: names the registered queries, or writes one over a folder of tables."""

from __future__ import annotations

import argparse

from .plans import catalog
from .session import get_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelane", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries, with a * where SQL says the same")
    run = commands.add_parser("run", help="write a query's rows as Parquet")
    run.add_argument("name", choices=sorted(catalog.QUERIES), metavar="NAME")
    run.add_argument("tables", help="folder of the tables")
    run.add_argument("out", help="folder of the result")
    run.add_argument("--master", help="Spark master, unless the session's settings name one")
    chosen = parser.parse_args(argv)
    if chosen.command == "list":
        print("\n".join(f"{name}{' *' if name in catalog.ORACLE_SQL else ''}" for name in sorted(catalog.QUERIES)))
        return
    spark = get_session(master=chosen.master)
    catalog.QUERIES[chosen.name](spark, chosen.tables).write.mode("errorifexists").parquet(chosen.out)


if __name__ == "__main__":
    main()
