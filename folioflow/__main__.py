"""Jobs from the command line.

    python -m folioflow query NAME --data DIR --out DIR      a registered query into a folder
    python -m folioflow list                                 names of the registered queries
    python -m folioflow refresh --meta F --log F --releases F --state DIR
                                                             one committed run of the refresh plan
    python -m folioflow stream --source DIR --state DIR --checkpoint DIR
                                                             new metadata files into the committed listings
    python -m folioflow tree --markdown PATH --out DIR       node rows of Markdown files
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from folioflow.common import ship
from folioflow.operators import incremental, tree
from folioflow.plans import registry
from folioflow.sources import files
from folioflow.streaming.refresh import start_refresh


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("list")
    options = {"query": ["data", "out"], "refresh": ["meta", "log", "releases", "state"], "stream": ["source", "state", "checkpoint"], "tree": ["markdown", "out"]}
    for job, names in options.items():
        p = jobs.add_parser(job)
        if job == "query":
            p.add_argument("name")
        for n in names:
            p.add_argument(f"--{n}", required=True)
    args = parser.parse_args(argv)
    if args.job == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.builder.appName(f"folioflow {args.job}").getOrCreate()
    ship(spark)
    if args.job == "query":
        if args.name not in registry.QUERIES:
            parser.error(f"no query named {args.name}")
        registry.QUERIES[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)
    elif args.job == "refresh":
        tables = [spark.read.parquet(x) for x in (args.meta, args.log, args.releases)]
        print(incremental.refresh_plan(incremental.CommitLog(spark, args.state), *tables).count())
    elif args.job == "stream":
        start_refresh(spark, args.source, args.state, args.checkpoint).awaitTermination()
    else:
        tree.tree_nodes(files.read_markdown(spark, args.markdown)).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
