"""Runs registered queries over a folder of tables: python -m quillstone --tables DIR [--out DIR] [--master local[8]] NAME..."""

from __future__ import annotations

import argparse
import sys
import time
from datetime import UTC, datetime

from .plans import registry
from .session import session
from .sources.files import locate


def run_folder(now: datetime) -> str:
    """The name of a run's folder: names are in the order of their times."""
    return f"{now:%Y-%m-%d_%H-%M-%S_%f}"


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    parser.add_argument("names", nargs="*", help="queries; none: list them")
    parser.add_argument("--tables", action="append", default=[], help="folder of the tables; of several the first that has all is taken")
    parser.add_argument("--out", help="folder under which the run writes a folder per query; without it rows are counted only")
    parser.add_argument("--master", default="local[*]")
    asked = parser.parse_args(arguments)
    if not asked.names:
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if unknown := [n for n in asked.names if n not in registry.QUERIES]:
        parser.error(f"no query is named {', '.join(unknown)}")
    spark = session(asked.master)
    folder = locate(spark, asked.tables, ["orders", "lineitem", "embeddings"])
    run = run_folder(datetime.now(UTC))
    for name in asked.names:
        began = time.perf_counter()
        rows = registry.QUERIES[name](spark, folder)
        if asked.out:
            rows.write.parquet(f"{asked.out}/{run}/{name}")
            n = spark.read.parquet(f"{asked.out}/{run}/{name}").count()
        else:
            n = rows.count()
        print(f"{name}\t{n}\t{time.perf_counter() - began:.1f}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
