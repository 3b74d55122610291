"""``python -m lectern QUERY TABLES [OUT]``: runs a registered query over a folder of tables; without OUT it is shown."""

from __future__ import annotations

import argparse


def main() -> None:
    from .plans.queries import QUERIES
    from .session import local_session

    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("tables", help="folder with NAME.parquet")
    parser.add_argument("out", nargs="?", help="folder for the result as Parquet")
    parser.add_argument("--cpus", default="8")
    args = parser.parse_args()
    found = QUERIES[args.query](local_session(args.cpus), args.tables)
    if args.out:
        found.write.parquet(args.out)
    else:
        found.show(50, truncate=80)


if __name__ == "__main__":
    main()
