"""Command line: `python -m lodefall list`, `run QUERY FOLDER [--out PATH]`, `search FOLDER QUESTION`, `candidates ROOT ...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lodefall import session
from lodefall.operators import analytics
from lodefall.plans import archive, catalog, indexes, intake, questions, records, rules, service  # noqa: F401 - they add their queries
from lodefall.plans.registry import QUERIES
from lodefall.session import table
from lodefall.sources import files


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="lodefall")
    kinds = found.add_subparsers(dest="kind", required=True)
    kinds.add_parser("list", help="the names of all queries")
    run = kinds.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    asked = kinds.add_parser("search", help="search the documents of a folder of tables")
    asked.add_argument("folder")
    asked.add_argument("question")
    asked.add_argument("--top", type=int, default=5)
    seen = kinds.add_parser("candidates", help="what indexing would look at, by extension")
    seen.add_argument("roots", nargs="+")
    seen.add_argument("--exclude", action="append", default=[])
    return found


def main(given: list[str] | None = None) -> int:
    args = parser().parse_args(given)
    if args.kind == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = session("lodefall")
    if args.kind == "run":
        found = QUERIES[args.query](spark, args.folder)
        found.write.mode("overwrite").parquet(args.out) if args.out else found.show(args.rows, False)
    elif args.kind == "search":
        texts = table(spark, args.folder, "documents").select("doc_id", "text")
        found = indexes.answered(spark, args.folder, texts, args.question, args.top)
        found.show(args.top, False)
    else:
        seen = files.candidates(spark, args.roots, exclude=args.exclude)
        analytics.extension_stats(seen, "ext", F.col("size"), 20).show(21, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
