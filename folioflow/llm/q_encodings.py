"""Queries of the encoding repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.llm.encodings import find_multibyte_spans, find_wrong_encoding


def _sources(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"act_lines": (table(spark, sf, "act_lines"), "line_id", "text"), "act_blocks": (table(spark, sf, "act_blocks"), "block_id", "text")}


def p3_method(spark: SparkSession, sf: str) -> DataFrame:
    """The byte-structure automaton alone over both tables: rows with multibyte spans, restored."""
    return find_multibyte_spans(_sources(spark, sf)).select("src_table", "row_id", "damage", "restored")


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return find_wrong_encoding(_sources(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_repaired(spark, sf).select("src_table", "row_id")


def p3_damages(spark: SparkSession, sf: str) -> DataFrame:
    """Affected rows by kind of damage."""
    return p3_repaired(spark, sf).groupBy("src_table", "damage", "lost").agg(F.count("*").alias("n"))


QUERIES = {"p3_method": p3_method, "p3_found": p3_found, "p3_repaired": p3_repaired, "p3_damages": p3_damages}
ORACLE: dict[str, str] = {}
