"""``python -m tessera.cli build DOCS INDEX`` and ``python -m tessera.cli search INDEX [QUERIES]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.plans.search import Index, formatted, search
from tessera.sources import corpus


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--analyzer", choices=("exact", "rules"), default="rules")
    sub = parser.add_subparsers(dest="action", required=True)
    build = sub.add_parser("build")
    build.add_argument("docs"), build.add_argument("index")
    build.add_argument("--compat", action="store_true", help="stopword postings keep their last document only")
    find = sub.add_parser("search")
    find.add_argument("index"), find.add_argument("queries", nargs="?")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.action == "build":
        Index.write(corpus.directory(spark, args.docs), args.index, args.analyzer, args.compat)
        return
    idx = Index.load(spark, args.index, args.analyzer)
    batches = [corpus.queries(spark, args.queries)] if args.queries else (corpus.inline(spark, [line.rstrip("\n")]) for line in sys.stdin)
    for queries in batches:
        for row in formatted(search(idx, queries), queries, idx).orderBy("query_id", "rank", "part").toLocalIterator():
            print(row.value)


if __name__ == "__main__":
    main()
