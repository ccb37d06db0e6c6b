"""Reproducible samples and acceptance rules. Draws are the order of a digest, the same in every engine and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def draw_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: str, taken: DataFrame | None = None) -> DataFrame:
    """n rows that earlier samples (taken) don't have."""
    rest = df.join(taken.select(key).distinct(), key, "left_anti") if taken is not None else df
    return rest.withColumn("_draw", draw_key(seed, F.col(key))).orderBy("_draw", key).limit(n).drop("_draw")


def split_sample(df: DataFrame, key: str, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The first n and the next n of one draw."""
    order = df.withColumn("_draw", draw_key(seed, F.col(key))).orderBy("_draw", key)
    both = order.limit(2 * n).withColumn("_rank", F.row_number().over(Window.orderBy("_draw", key)))
    return both.filter(F.col("_rank") <= n).drop("_draw", "_rank"), both.filter(F.col("_rank") > n).drop("_draw", "_rank")


def stratified(df: DataFrame, key: str, stratum: Column, k: int, seed: str) -> DataFrame:
    """k rows per stratum. Ranks are taken by salted part first, so a large stratum is never in one task."""
    drawn = df.withColumn("_stratum", stratum).withColumn("_draw", draw_key(seed, F.col(key)))
    drawn = drawn.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = Window.partitionBy("_stratum", "_salt").orderBy("_draw", key)
    kept = drawn.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    final = Window.partitionBy("_stratum").orderBy("_draw", key)
    return kept.withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= k).drop("_draw", "_salt", "_rank").withColumnRenamed("_stratum", "stratum")


def pick_page(pages: DataFrame, tries: int = 5, least_words: int = 50, seed: str = "p") -> DataFrame:
    """One page per act: of up to tries drawn pages the first with enough words: doc_id, page, words."""
    drawn = pages.withColumn("_draw", draw_key(seed, F.concat_ws("/", "doc_id", "page")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_draw", "page"))
    tried = drawn.withColumn("_rank", rank).filter((F.col("_rank") <= tries) & (F.col("words") >= least_words))
    return tried.groupBy("doc_id").agg(F.min_by(F.struct("page", "words"), "_rank").alias("x")).select("doc_id", "x.*")


def last_ratings(ratings: DataFrame, key: str, order: str) -> DataFrame:
    columns = [c for c in ratings.columns if c != key]
    return ratings.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select(key, "x.*")


def acceptance(ratings: DataFrame, accuracy: str = "accuracy", defect: str = "defect", median: float = 0.95, share: float = 0.9, good: float = 58 / 64, defects: float = 8 / 64) -> DataFrame:
    """Whether a rated sample passes: its median, the share of good items and the share of defects, with thresholds as rates."""
    sums = ratings.agg(
        F.count("*").alias("items"), F.round(F.median(accuracy), 6).alias("median"),
        F.count_if(F.col(accuracy) >= share).alias("good"), F.count_if(F.col(defect)).alias("defects"),
    )
    n = F.col("items")
    passed = (F.col("median") >= median) & (F.col("good") >= good * n) & (F.col("defects") <= defects * n)
    return sums.withColumn("passed", F.coalesce(passed, F.lit(False)))
