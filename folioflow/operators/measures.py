"""Measurement: token bags, rates, quantiles, summaries."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions.text import tokens


def token_bag(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Occurrences of each token per key: key, token, n."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def bag_pairs(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Both counts of each token that either side has: key, token, a, b. One shuffle: the bags are added up by tag."""
    both = ref.select(key, "token", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(hyp.select(key, "token", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    return both.groupBy(key, "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def rate(part: Column, whole: Column) -> Column:
    """Share rounded to six places; nothing out of nothing is 0."""
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def bag_overlap(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Multiset overlap of two token bags: key, ref, hyp, common, kept (of ref), grounded (of hyp)."""
    sums = bag_pairs(ref, hyp, key).groupBy(key).agg(F.sum("a").alias("ref"), F.sum("b").alias("hyp"), F.sum(F.least("a", "b")).alias("common"))
    return sums.select(key, "ref", "hyp", "common", rate(F.col("common"), F.col("ref")).alias("kept"), rate(F.col("common"), F.col("hyp")).alias("grounded"))


def lost(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Tokens that ref has more often than hyp, as often as they are missing (multiset difference)."""
    return bag_pairs(ref, hyp, key).filter("a > b").select(key, "token", (F.col("a") - F.col("b")).alias("n"))


def common(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Tokens of both, as often as both have them (multiset intersection)."""
    return bag_pairs(ref, hyp, key).filter("a > 0 and b > 0").select(key, "token", F.least("a", "b").alias("n"))


def totals(scores: DataFrame, by: list[str], below: float = 0.95) -> DataFrame:
    """Micro and macro rates of score rows (ref, hyp, common, kept, grounded) by group and over all (NULL group)."""
    aggregates = [
        F.count("*").alias("items"), F.sum("ref").alias("ref"), F.sum("hyp").alias("hyp"), F.sum("common").alias("common"),
        F.round(F.avg("kept"), 6).alias("macro_kept"), F.count_if(F.col("kept") < below).alias("below"),
    ]
    sets = scores.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(*aggregates)
    return sets.withColumn("micro_kept", rate(F.col("common"), F.col("ref"))).withColumn("micro_grounded", rate(F.col("common"), F.col("hyp")))


def value_counts(df: DataFrame, by: str, value: Column) -> DataFrame:
    return df.select(by, value.alias("v")).filter("v is not null").groupBy(by, "v").agg(F.count("*").alias("c"))


def quantiles(df: DataFrame, by: str, value: Column) -> DataFrame:
    """n, least, most, median and the quartiles that are elements of the sorted values (places n div 4 and 3n div 4).

    Values are counted first, so a group of any size is as many rows as it has different values.
    """
    counts = value_counts(df, by, value)
    upto = Window.partitionBy(by).orderBy("v")
    seen = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    n = F.col("n")
    low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    return seen.groupBy(by).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), at(F.floor(n / 4)).alias("q1"),
        ((low + high) / 2).alias("median"), at(F.floor(3 * n / 4)).alias("q3"),
    )


def weighted_share(df: DataFrame, by: str, value: Column, weight: Column) -> DataFrame:
    """Weighted mean per group; rows without value or weight are left out."""
    both = df.filter(value.isNotNull() & weight.isNotNull())
    return both.groupBy(by).agg(F.round(F.try_divide(F.sum(value * weight), F.sum(weight)), 6).alias("share"), F.count("*").alias("rows"))


def mode_by(df: DataFrame, by: list[str], value: Column, weight: Column | None = None, least: int = 1) -> DataFrame:
    """Most frequent value per group with at least least occurrences; the smallest of equally frequent ones: by, mode, n."""
    counts = df.select(*by, value.alias("v"), (weight if weight is not None else F.lit(1)).alias("w")).filter("v is not null").groupBy(*by, "v").agg(F.sum("w").alias("n"))
    best = counts.filter(F.col("n") >= least).groupBy(*by).agg(F.max_by(F.struct("v", "n"), F.struct("n", -F.col("v"))).alias("x"))
    return best.select(*by, F.col("x.v").alias("mode"), F.col("x.n").alias("n"))


def bootstrap_median(df: DataFrame, value: str, replicates: int = 200, seed: str = "b", places: int = 2) -> DataFrame:
    """Percentile interval of the median over resamples: low, median, high, replicates.

    Rows are counted by rounded value first. The median of n rows drawn with replacement is the value at a random place: the
    middle one of n evenly spread numbers in order, which is drawn by its own (beta) distribution, for an even n the two in the
    middle. So the draws are exact, and the work is different values plus replicates, on any layout.
    """
    counts = df.select(F.round(F.col(value).cast("double"), places).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    state = zlib.crc32(seed.encode())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ranks = [], []
            for r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, k = np.random.default_rng([state, r]), (n + 1) // 2
                low = high = rng.beta(k, n - k + 1)
                if n % 2 == 0:
                    high = low + (1 - low) * rng.beta(1, n - k)
                at += [r, r]
                ranks += [min(n, max(1, math.ceil(u * n))) for u in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ranks, pa.int64())], names=["r", "rank"])

    # one row on the right side
    total = F.broadcast(counts.agg(F.sum("c").alias("n")).filter("n is not null"))
    draws = df.sparkSession.range(1, replicates + 1).crossJoin(total).mapInArrow(draw, "r long, rank long")
    placed = counts.select(F.lit(None).cast("long").alias("r"), F.sum("c").over(Window.orderBy("v")).alias("rank"), "v")
    both = placed.unionByName(draws.withColumn("v", F.lit(None).cast("double")))
    # downwards, as a frame to the end of the rows costs their square
    above = Window.orderBy(F.desc("rank")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("v", F.last("v", ignorenulls=True).over(above)).filter("r is not null")
    medians = found.groupBy("r").agg(F.avg("v").alias("m"))
    return medians.agg(
        F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.975).alias("high"), F.count("*").alias("replicates")
    )
