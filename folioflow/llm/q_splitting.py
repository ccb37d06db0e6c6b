"""Queries of the splitting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.llm.splitting import split_groups, split_texts


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items that the operator cuts: those with a second piece."""
    blocks = table(spark, sf, "act_blocks")
    cut = split_texts(blocks, "block_id", only_cut=True).filter("piece_no = 2")
    acts = split_groups(blocks, "doc_id", "seq", "block_id").filter("piece_no = 2")
    return cut.select(F.lit("block").alias("item_kind"), F.col("block_id").cast("string").alias("item_key")).unionByName(
        acts.select(F.lit("act").alias("item_kind"), F.col("doc_id").alias("item_key"))
    )


def p6_block_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(table(spark, sf, "act_blocks"), "block_id")


def p6_act_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_groups(table(spark, sf, "act_blocks"), "doc_id", "seq", "block_id")


def p6_block_check(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each block put together again: their text by its hash, and what breaks the limits."""
    pieces = p6_block_pieces(spark, sf).withColumn("core", F.expr("substring(text, overlap_chars + 1)"))
    wrong = F.count_if((F.length("text") > 1500) | (F.col("overlap_chars") > 150) | ((F.col("piece_no") > 1) & (F.col("overlap_chars") == 0)))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "core"))), lambda p: p["core"]), "")
    return pieces.groupBy("block_id").agg(F.md5(ordered.cast("binary")).alias("joined"), wrong.alias("wrong"), (F.count("*") > 1).alias("cut"))


def p6_act_check(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each act added up: characters that are no blanks or line ends, sections, and what breaks the limits."""
    pieces = p6_act_pieces(spark, sf).withColumn("core", F.expr("substring(text, overlap_chars + 1)"))
    wrong = F.count_if((F.length("text") > 12_000) | (F.col("overlap_chars") > 150) | ((F.col("piece_no") > 1) & (F.col("overlap_chars") == 0)))
    chars = F.sum(F.length(F.regexp_replace("core", "[ \n]", "")))
    return pieces.groupBy("doc_id").agg(
        chars.alias("chars"), F.sum(F.regexp_count("core", F.lit("§"))).alias("sections"), wrong.alias("wrong"), (F.max("piece_no") == F.count("*")).alias("numbered"),
    )


QUERIES = {"p6_found": p6_found, "p6_block_pieces": p6_block_pieces, "p6_act_pieces": p6_act_pieces, "p6_block_check": p6_block_check, "p6_act_check": p6_act_check}
ORACLE = {
    "p6_found": """
WITH b AS (SELECT DISTINCT block_id, doc_id, coalesce(length(text), 0) AS n FROM act_blocks)
SELECT 'block' AS item_kind, CAST(block_id AS VARCHAR) AS item_key FROM b WHERE n > 1500
UNION ALL SELECT 'act', doc_id FROM b WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING sum(n) > 12000
""",
    "p6_block_check": "SELECT DISTINCT block_id, md5(text) AS joined, 0::BIGINT AS wrong, length(text) > 1500 AS cut FROM act_blocks WHERE text <> ''",
    "p6_act_check": """
WITH b AS (SELECT DISTINCT block_id, doc_id, text FROM act_blocks WHERE doc_id IS NOT NULL AND text <> '')
SELECT doc_id, sum(length(regexp_replace(text, '[ \n]', '', 'g')))::BIGINT AS chars, sum(length(text) - length(replace(text, '§', '')))::BIGINT AS sections, 0::BIGINT AS wrong, true AS numbered
FROM b GROUP BY doc_id HAVING sum(length(text)) > 12000
""",
}
