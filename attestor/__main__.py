"""``python -m attestor NAME FOLDER [OUTPUT]``: run a registered query over a folder of tables; show it or write it as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from attestor.plans import evaluation_queries, registry, retrieval_queries, study_queries  # noqa: F401


def main() -> None:
    parser = argparse.ArgumentParser(prog="attestor", description=__doc__)
    parser.add_argument("name", choices=sorted(registry.QUERIES))
    parser.add_argument("folder")
    parser.add_argument("output", nargs="?")
    given = parser.parse_args()
    spark = SparkSession.builder.appName(f"attestor {given.name}").getOrCreate()
    found = registry.QUERIES[given.name](spark, given.folder)
    if given.output:
        found.write.mode("errorifexists").parquet(given.output)
    else:
        found.show(50, truncate=120)
    spark.stop()


if __name__ == "__main__":
    main()
