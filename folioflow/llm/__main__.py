"""Queries on text corpora from the command line: python -m folioflow.llm NAME --data DIR --out DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from folioflow.common import ship
from folioflow.llm.queries import QUERIES


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioflow.llm", description=__doc__)
    parser.add_argument("name", choices=sorted(QUERIES))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"folioflow {args.name}").getOrCreate()
    ship(spark)
    QUERIES[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
