"""Queries of the contamination search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.llm.contamination import find_leaks


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).select("doc_id", "item_id")


def p8_suites(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and documents by suite."""
    leaks = p8_found(spark, sf).join(table(spark, sf, "eval_items").select("item_id", "suite").distinct(), "item_id")
    return leaks.groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_suites": p8_suites}
ORACLE: dict[str, str] = {}
