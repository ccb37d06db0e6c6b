"""Queries of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.llm.packing import fill_report, pack_tokens


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_tokens(table(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_containers(spark, sf))


def p7_cover(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each text added up: characters, whether they follow each other, and what breaks the rules."""
    pieces = p7_containers(spark, sf).withColumn("size", F.sum("tokens").over(Window.partitionBy("doc_id")))
    wrong = F.count_if((F.col("tokens") > 2048) | (F.col("container_id").isNull() != (F.col("tokens") == 0)))
    return pieces.groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).alias("chars"), (F.max("piece_no") == F.count("*")).alias("numbered"), wrong.alias("wrong"),
        # only texts beyond the capacity are split
        ((F.count("*") > 1) & (F.max("size") <= 2048)).alias("split_early"),
    )


def p7_overfull(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by whether they hold more than the capacity, and texts by whether they have space."""
    held = p7_containers(spark, sf).groupBy(F.col("container_id").isNull().alias("empty"), "container_id").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"))
    return held.groupBy("empty").agg(F.count_if(F.col("tokens") > 2048).alias("overfull"), F.sum(F.when(F.col("empty"), F.col("texts"))).alias("texts_without"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_cover": p7_cover, "p7_overfull": p7_overfull}
ORACLE = {
    "p7_cover": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, true AS numbered, 0::BIGINT AS wrong, false AS split_early FROM documents",
    "p7_overfull": """
SELECT coalesce(text = '', true) AS empty, 0::BIGINT AS overfull, CASE WHEN coalesce(text = '', true) THEN count(*) END AS texts_without FROM documents GROUP BY coalesce(text = '', true)
""",
}
