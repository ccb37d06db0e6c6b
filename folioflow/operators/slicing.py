"""Own act on shared pages, found by title instead of by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions.text import plain_form, written_date
from folioflow.operators.alignment import similarity
from folioflow.operators.blocks import ACT_TYPE, SIGNATURE


def title_parts(text: Column) -> Column:
    """Head (type and issuer), date and subject of a title in plain form."""
    plain = plain_form(text)
    return F.struct(
        F.trim(F.regexp_extract(plain, r"^(.*?)(?: Z DNIA | W SPRAWIE |$)", 1)).alias("head"), written_date(F.lower(text)).alias("day"),
        F.trim(F.regexp_extract(plain, r"(?: W SPRAWIE | O | ZMIENIAJACE? )(.*)$", 1)).alias("subject"),
    )


def same_header(left: Column, right: Column) -> Column:
    """Whether two headers name one act: like type and issuer, the same day, a like subject."""
    a, b = title_parts(left), title_parts(right)
    return F.coalesce((similarity(a["head"], b["head"]) >= 0.8) & a["day"].eqNullSafe(b["day"]) & (similarity(a["subject"], b["subject"]) >= 0.75), F.lit(False))


def header_candidates(lines: DataFrame, ahead: int = 3) -> DataFrame:
    """Lines that begin with an act type in capitals, joined with the lines after them on the page: doc_id, seq, header."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    parts = [F.col("text"), *[F.coalesce(F.lead("text", k).over(order), F.lit("")) for k in range(1, ahead + 1)]]
    return lines.withColumn("header", F.concat_ws(" ", *parts)).filter(F.upper("text").rlike(ACT_TYPE)).select("doc_id", "page", "seq", "header")


def title_scores(candidates: DataFrame, titles: DataFrame) -> DataFrame:
    """Score of each candidate against the title of its document: doc_id, seq, score (0 where type or date differ too much).

    titles: doc_id, title."""
    joined = candidates.join(titles, "doc_id")
    a, b = title_parts(F.col("header")), title_parts(F.col("title"))
    parts = joined.select("doc_id", "page", "seq", a.alias("a"), b.alias("b"))
    head, rest = similarity(F.col("a.head"), F.col("b.head")), similarity(F.col("a.subject"), F.col("b.subject"))
    scored = parts.withColumn("_head", head).withColumn("_rest", rest)
    day = F.col("a.day").isNull() | F.col("b.day").isNull() | (F.col("a.day") == F.col("b.day"))
    good = (F.col("_head") >= 0.8) & day & (F.coalesce("_rest", F.lit(0.0)) >= 0.5)
    return scored.select("doc_id", "page", "seq", F.when(good, F.round((F.col("_head") + F.col("_rest")) / 2, 6)).otherwise(0.0).alias("score"))


def own_start(scores: DataFrame, lead: float = 0.1, least: float = 0.6) -> DataFrame:
    """Place of the best candidate of each document if it leads the next by enough: doc_id, seq, score."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "seq")
    ranked = scores.filter("score > 0").withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    return ranked.filter((F.col("_rank") == 1) & (F.col("score") >= least) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= lead))).select("doc_id", "seq", "score")


def act_end(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """End of an act on scans: the next type header behind a signature or with a date: doc_id, stop_seq (exclusive).

    starts: doc_id, seq."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    signed = F.coalesce(F.lag("text").over(order).rlike(SIGNATURE), F.lit(False))
    dated = F.coalesce(F.lead("text").over(order).rlike(r"^\W{0,3}z dnia \d{1,2}"), F.lit(False))
    heads = lines.withColumn("_end", F.col("text").rlike(ACT_TYPE) & (signed | dated)).filter("_end")
    later = heads.select("doc_id", F.col("seq").alias("_s")).join(starts.select("doc_id", "seq"), "doc_id").filter("_s > seq")
    return later.groupBy("doc_id").agg(F.min("_s").alias("stop_seq"))


def neighbour_cut(candidates: DataFrame, titles: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Place where a neighbour's title fits a header better than the own one: doc_id, stop_seq.

    neighbours: doc_id, title (several per document)."""
    own = title_scores(candidates, titles).select("doc_id", "seq", F.col("score").alias("own"))
    others = title_scores(candidates, neighbours).groupBy("doc_id", "seq").agg(F.max("score").alias("other"))
    first = own.filter("own > 0").groupBy("doc_id").agg(F.min("seq").alias("_start"))
    better = own.join(others, ["doc_id", "seq"]).filter("other > own").join(first, "doc_id", "left").filter("_start is null or seq > _start")
    return better.groupBy("doc_id").agg(F.min("seq").alias("stop_seq"))
