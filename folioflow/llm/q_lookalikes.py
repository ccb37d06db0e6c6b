"""Queries of the look-alike operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import materialize, table
from folioflow.llm.encodings import find_wrong_encoding
from folioflow.llm.lookalikes import find_look_alikes


def _sources(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"act_blocks": (table(spark, sf, "act_blocks"), "block_id", "text"), "act_footnotes": (table(spark, sf, "act_footnotes"), "footnote_id", "text")}


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """What the letter statistics of the encoding repair are taken over."""
    return table(spark, sf, "act_blocks").select("text").unionByName(table(spark, sf, "act_lines").select("text"))


def p4_method(spark: SparkSession, sf: str) -> DataFrame:
    """Normalisation properties alone over both tables: rows with unstable segments, and their form."""
    return find_look_alikes(_sources(spark, sf), method_only=True).select("src_table", "row_id", "kinds", "canonical")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = materialize(find_look_alikes(_sources(spark, sf)).select("src_table", "row_id", "text"), "alike")
    # only rows found can be wrongly decoded ones to leave out
    wrong = find_wrong_encoding({"act_blocks": (found.filter("src_table = 'act_blocks'"), "row_id", "text")}, sample=_texts(spark, sf))
    return found.select("src_table", "row_id").join(wrong.select("src_table", "row_id"), ["src_table", "row_id"], "left_anti")


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every affected row; wrongly decoded ones are restored first."""
    wrong = find_wrong_encoding(_sources(spark, sf), sample=_texts(spark, sf))
    return find_look_alikes(_sources(spark, sf), restored=materialize(wrong, "wrong"))


def p4_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Affected rows by what was changed."""
    return p4_canonical(spark, sf).select("src_table", F.explode("kinds").alias("kind")).groupBy("src_table", "kind").agg(F.count("*").alias("n"))


QUERIES = {"p4_method": p4_method, "p4_found": p4_found, "p4_canonical": p4_canonical, "p4_kinds": p4_kinds}
ORACLE: dict[str, str] = {}
