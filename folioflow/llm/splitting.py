"""Splitting oversized items at natural boundaries.

A text is consumed by one regular expression whose alternatives have bounded quantifiers and stand in
the order of the strength of the boundary they end at: the rest of the text, a paragraph, a line, a
sentence, a clause, a blank, any character. The matches are the cores of the pieces and follow each
other without gaps. Each piece but the first begins with the end of the core before it, cut to at
most the wanted overlap at a word start. Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.common import previous, running_sum


def core_pattern(core: int) -> str:
    """Regular expression that consumes a text in stretches of at most core characters."""
    low = core // 2

    def ending(boundary: str, width: int) -> str:
        return f".{{{low},{core - width}}}{boundary}"

    return "(?s)" + "|".join([
        rf".{{1,{core}}}\z",
        ending(r"\n[ \t]{0,4}\n", 6),
        ending(r"\n", 1),
        ending(r"[.!?…][\"'”’)\]]{0,2}\s", 4),
        ending(r"[;:]\s", 2),
        ending(r",\s", 2),
        ending(r"\s", 1),
        f".{{1,{core}}}",
    ])


def _cores(text: Column, core: int) -> Column:
    return F.regexp_extract_all(text, F.lit(core_pattern(core)), F.lit(0))


def natural_tail(text: Column, overlap: int) -> Column:
    """The end of text: overlap characters, less those before the first word start among them.

    Where no blank stands among them it is overlap characters exactly.
    """
    if overlap == 0:
        return F.lit("")
    ahead = F.right(text, F.lit(overlap + 1))
    tail = F.right(text, F.lit(overlap))
    cut = F.regexp_replace(tail, r"(?s)^\S*\s+", "")
    fits = (F.length(text) <= overlap) | F.left(ahead, F.lit(1)).rlike(r"^\s")
    return F.when(fits | (cut == ""), tail).otherwise(cut)


def split_texts(df: DataFrame, key: str, text: str = "text", limit: int = 1500, overlap: int = 150, only_cut: bool = False) -> DataFrame:
    """Pieces of at most limit characters: key, piece_no (from 1), overlap_chars, text.

    Characters are code points. A text within the limit is one piece (left out with only_cut); NULL and empty texts
    give none. Without the first overlap_chars of each piece, the pieces of a text joined in order are the
    text. Rows with the same key and text give their pieces once; other columns are left out.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > (limit if only_cut else 0))
    # texts delivered twice go before anything is cut
    once = source.withColumn("_hash", F.xxhash64("_text")).dropDuplicates(["_key", "_hash"])
    cores = F.when(F.length("_text") <= limit, F.array("_text")).otherwise(_cores(F.col("_text"), limit - overlap))
    pieces = once.select("_key", cores.alias("_cores")).select("_key", F.posexplode(_with_heads(overlap, F.lit(""))).alias("_no", "_p"))
    return pieces.select(
        F.col("_key").alias(key), (F.col("_no") + 1).alias("piece_no"),
        F.length("_p.head").alias("overlap_chars"), F.concat("_p.head", "_p.core").alias("text"),
    )


def _with_heads(overlap: int, first: Column) -> Column:
    """The array _cores as structs of core and head, the end of the core before; first: the head of the first."""
    return F.transform("_cores", lambda c, i: F.struct(c.alias("core"), F.when(i > 0, natural_tail(F.get("_cores", i - 1), overlap)).otherwise(first).alias("head")))


def split_groups(
    df: DataFrame, group: str, order: str, item: str, text: str = "text", limit: int = 12_000, overlap: int = 150, span: int = 2048,
) -> DataFrame:
    """Ordered pieces of the groups (acts) whose texts have more than limit characters in sum.

    Output: group, piece_no (from 1), overlap_chars, text. The text of a group is its texts in order, with an empty line
    between them; it is cut by the same expression as in split_texts, at the strongest boundary before the limit. As a
    group may be a third of all rows, its text is put together in regions of span places of the order, which end at
    the end of a text, and every region is cut by itself; a group of fewer places is one region or two. Without the
    first overlap_chars of each and without the line ends at the end of each region, the pieces of a group joined in order
    are its text. Rows are ordered by order, then item; NULL orders come first. Rows delivered twice
    (same order, item and text) count once; NULL and empty texts count 0; rows without a group belong to none.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    place = F.floor(F.col(order).cast("long") / span)
    # rows without a place come first, spread by their ids
    spare = F.floor(F.coalesce(F.col(item).cast("string").try_cast("long"), F.lit(0)) / span) - (1 << 50)
    source = df.filter((F.col(text) != "") & F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), F.coalesce(place, spare).alias("_region"), F.col(order).cast("long").alias("_order"), F.col(item).alias("_item"), F.col(text).alias("_text")
    )
    # which groups are large is told by lengths; the texts are moved only once, to their regions
    narrow = source.select("_group", "_region", "_order", "_item", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_n")).distinct()
    sizes = narrow.groupBy("_group", "_region").agg(F.sum("_n").alias("_n"))
    large = sizes.groupBy("_group").agg(F.sum("_n").alias("_n"), (F.count("*") > 1).alias("_many")).filter(F.col("_n") > limit)
    wanted = sizes.select("_group", "_region").join(large.select("_group", "_many"), "_group")
    # a set: rows delivered twice stand once
    regions = source.groupBy("_group", "_region").agg(F.array_sort(F.collect_set(F.struct("_order", "_item", "_text"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda p: p["_text"]), "\n\n")
    cut = regions.join(wanted, ["_group", "_region"]).select("_group", "_region", "_many", _cores(whole, limit - overlap).alias("_cores"))
    # what the regions of a group tell each other: their number of pieces and the end of their last one
    info = cut.filter("_many").select("_group", "_region", F.size("_cores").alias("_n"), natural_tail(F.element_at("_cores", -1), overlap).alias("_tail"))
    info = running_sum(previous(info, ["_group"], ["_region"], "_tail", "_head"), ["_group"], ["_region"], F.col("_n"), "_before")
    both = cut.join(info.select("_group", "_region", "_head", "_before"), ["_group", "_region"], "left")
    pieces = both.select("_group", F.coalesce("_before", F.lit(0)).alias("_before"), F.posexplode(_with_heads(overlap, F.coalesce("_head", F.lit("")))).alias("_no", "_p"))
    return pieces.select(
        F.col("_group").alias(group), (F.col("_before") + F.col("_no") + 1).cast("long").alias("piece_no"),
        F.length("_p.head").alias("overlap_chars"), F.concat("_p.head", "_p.core").alias("text"),
    )
