"""Command line: search an index, or check it."""

from __future__ import annotations

import argparse

from .operators.index import Index
from .operators.search import SearchParams
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docquarry")
    parser.add_argument("--index", required=True, help="root of a published index")
    sub = parser.add_subparsers(dest="command", required=True)
    search = sub.add_parser("search", help="the best hits of a query")
    search.add_argument("query")
    search.add_argument("-l", "--limit", type=int, default=10)
    sub.add_parser("health", help="whether the tables of the index fit together")
    args = parser.parse_args(argv)
    spark = local_session()
    index = Index(spark, args.index)
    if args.command == "health":
        row = index.health().first()
        print(f"version {row['version']}: {row['docs']} documents, {row['terms']} terms, {row['files']} files, {'healthy' if row['healthy'] else 'BROKEN'}")
        return 0 if row["healthy"] else 1
    params = SearchParams(args.query.lower() if args.query.islower() else args.query, size=args.limit)
    for r in index.reader().hits(params).orderBy("rank").collect():
        print(f"{r['file_name']} ({r['file_ext']}): {r['score']:.2f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
