"""Alignment of token sequences and the scores that rest on it.

Sequences are compared per row (one page, paragraph or unit), as Arrow batches: the alignment needs both lists at once and
decides step by step. Everything around it (sums, rates, classes) is done with expressions.
"""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators.measures import rate


def _rows(df: DataFrame, keys: list[str], columns: list[str], make: Callable, ddl: str) -> DataFrame:
    """One or more rows per row: make gets the values of columns and gives tuples in the order of ddl."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = dict(df.dtypes)
    full = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ddl
    schema = to_arrow_schema(StructType.fromDDL(full))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            out = [(*row[:n], *t) for row in zip(*values) for t in make(*row[n:])]
            cols = list(zip(*out)) if out else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], names=schema.names)

    return df.select(*keys, *columns).mapInArrow(run, full)


def matched_in_order(a: list[str] | None, b: list[str] | None) -> int:
    """Tokens in matching blocks (longest block first, then on either side of it)."""
    if not a or not b:
        return 0
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def longest_common(a: list[str] | None, b: list[str] | None) -> int:
    """Length of the longest common subsequence, with one bit vector per distinct token."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        m = places.get(t, 0) & row
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def in_order_scores(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, ref, hyp (tokens), matched, lcs, recall, precision. NULL and empty lists count 0."""
    found = _rows(pairs, keys, [ref, hyp], lambda a, b: [(len(a or []), len(b or []), matched_in_order(a, b), longest_common(a, b))], "ref long, hyp long, matched long, lcs long")
    return found.withColumn("recall", rate(F.col("matched"), F.col("ref"))).withColumn("precision", rate(F.col("matched"), F.col("hyp")))


def alignment_map(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Place of each token of a in b and of b in a, -1 where unaligned."""
    to_b, to_a = [-1] * len(a), [-1] * len(b)
    for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        for k in range(m.size):
            to_b[m.a + k], to_a[m.b + k] = m.b + k, m.a + k
    return to_b, to_a


def aligned_pairs(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row per token of either side: keys, ref_pos, hyp_pos, -1 where unaligned."""

    def make(a, b):
        to_b, to_a = alignment_map(a or [], b or [])
        return [(i, j) for i, j in enumerate(to_b)] + [(-1, j) for j, i in enumerate(to_a) if i < 0]

    return _rows(pairs, keys, [ref, hyp], make, "ref_pos int, hyp_pos int")


def differences(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp", most: int = 40) -> DataFrame:
    """The first differences of each pair as a report: keys, no, kind, ref_text, hyp_text."""

    def make(a, b):
        a, b = a or [], b or []
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        return [(k, kind, " ".join(a[i:j]), " ".join(b[x:y])) for k, (kind, i, j, x, y) in enumerate(ops[:most], 1)]

    return _rows(pairs, keys, [ref, hyp], make, "no int, kind string, ref_text string, hyp_text string")


def lenient_precision(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp", other: str = "other") -> DataFrame:
    """Precision in which hyp tokens that ref lacks count if the other parts of the document have them: keys, hyp, matched, elsewhere, precision."""

    def make(a, b, o):
        a, b = a or [], b or []
        left = {}
        for t in o or []:
            left[t] = left.get(t, 0) + 1
        to_a = alignment_map(a, b)[1]
        elsewhere = 0
        for t, place in zip(b, to_a):
            if place < 0 and left.get(t):
                left[t] -= 1
                elsewhere += 1
        return [(len(b), len(b) - to_a.count(-1), elsewhere)]

    found = _rows(pairs, keys, [ref, hyp, other], make, "hyp long, matched long, elsewhere long")
    return found.withColumn("precision", rate(F.col("matched") + F.col("elsewhere"), F.col("hyp")))


def similarity(left: Column, right: Column) -> Column:
    """Ratio of matching characters of two short texts (titles, headings), as an Arrow-batched function."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ratio(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])

    return ratio(left, right)


def structure_score(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraph breaks and unit starts through an alignment. pairs: keys, ref, hyp (arrays of paragraphs, each an array of tokens).

    Output: keys, ref_breaks, hyp_breaks, common_breaks, recall, precision. A break is the first token of a paragraph; it is
    common if the aligned token opens a paragraph too.
    """

    def make(a, b):
        flat = lambda x: [t for p in x or [] for t in p]

        def starts(x):
            out, at = set(), 0
            for p in x or []:
                if p:
                    out.add(at)
                at += len(p)
            return out

        to_b, _ = alignment_map(flat(a), flat(b))
        ra, rb = starts(a), starts(b)
        return [(len(ra), len(rb), sum(to_b[i] in rb for i in ra))]

    found = _rows(pairs, keys, ["ref", "hyp"], make, "ref_breaks long, hyp_breaks long, common_breaks long")
    return found.withColumn("recall", rate(F.col("common_breaks"), F.col("ref_breaks"))).withColumn("precision", rate(F.col("common_breaks"), F.col("hyp_breaks")))


def linear_nodes(nodes: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    """Tokens of a tree in pre-order with the path of the node that holds them: keys, pos, token, path. nodes: node_id, path, text."""
    counted = nodes.withColumn("_t", F.coalesce(tokens, F.array().cast("array<string>")))
    before = F.sum(F.size("_t")).over(Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("_at", F.coalesce(before, F.lit(0))).select(*keys, "path", "_at", F.posexplode("_t").alias("_i", "token")).select(*keys, (F.col("_at") + F.col("_i")).alias("pos"), "token", "path")


def tree_score(ref: DataFrame, hyp: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Units of a reference tree found at the same place: keys, units, same, moved, missing.

    ref, hyp: keys, path, pos (first token of each unit); pairs: aligned_pairs. A unit is the same if the unit that starts at
    the aligned token has its path, moved if one starts there with another, missing if none does.
    """
    there = ref.join(pairs.filter("ref_pos >= 0").select(*keys, F.col("ref_pos").alias("pos"), "hyp_pos"), [*keys, "pos"], "left")
    other = hyp.select(*keys, F.col("pos").alias("hyp_pos"), F.col("path").alias("hyp_path"))
    joined = there.join(other, [*keys, "hyp_pos"], "left").groupBy(*keys, "pos", "path").agg(F.bool_or(F.col("hyp_path") == F.col("path")).alias("same"), F.count("hyp_path").alias("n"))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("units"), F.count_if(F.coalesce("same", F.lit(False))).alias("same"),
        F.count_if(~F.coalesce("same", F.lit(False)) & (F.col("n") > 0)).alias("moved"), F.count_if(F.col("n") == 0).alias("missing"),
    )


def article_compare(ref: DataFrame, hyp: DataFrame, keys: list[str], close: float = 0.99) -> DataFrame:
    """The i-th article of a number against the i-th: keys, num, i, state (identical, close, differs, missing, extra).

    ref, hyp: keys, num, seq, text."""
    numbered = lambda df, name: df.select(*keys, "num", F.row_number().over(Window.partitionBy(*keys, "num").orderBy("seq")).alias("i"), F.col("text").alias(name))
    both = numbered(ref, "_a").join(numbered(hyp, "_b"), [*keys, "num", "i"], "full_outer")
    state = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "identical")
        .when(similarity(F.col("_a"), F.col("_b")) >= close, "close").otherwise("differs")
    )
    return both.select(*keys, "num", "i", state.alias("state"))


def marker_counts(ours: DataFrame, theirs: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Common occurrences of markers by kind: kind, ours, theirs, common. Tables: key and a count column per kind."""
    both = ours.alias("a").join(theirs.alias("b"), key, "full_outer")
    rows = [F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"a.{k}"), F.lit(0)).alias("a"), F.coalesce(F.col(f"b.{k}"), F.lit(0)).alias("b")) for k in kinds]
    long = both.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return long.groupBy("kind").agg(F.sum("a").alias("ours"), F.sum("b").alias("theirs"), F.sum(F.least("a", "b")).alias("common"))


def number_coverage(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Article numbers that only one side has: key, num, side. Tables: key, num."""
    a, b = ours.select(key, "num").distinct().withColumn("_a", F.lit(True)), theirs.select(key, "num").distinct().withColumn("_b", F.lit(True))
    both = a.join(b, [key, "num"], "full_outer")
    return both.filter("_a is null or _b is null").select(key, "num", F.when(F.col("_a").isNull(), "theirs").otherwise("ours").alias("side"))


#: Classes of a difference in the order in which they are tried.
TRIAGE = ["same", "blank", "case", "accents", "punctuation", "number", "hyphen", "short", "other"]


def triage(ref_text: Column, hyp_text: Column) -> Column:
    """Class of a difference: the first of TRIAGE that explains it."""
    from folioflow.functions.text import plain_form

    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return (
        F.when(ref_text == hyp_text, "same").when(F.regexp_replace(ref_text, r"\s+", "") == F.regexp_replace(hyp_text, r"\s+", ""), "blank")
        .when(F.lower(ref_text) == F.lower(hyp_text), "case").when(F.regexp_replace(ref_text, "[-­]\\s*", "") == F.regexp_replace(hyp_text, "[-­]\\s*", ""), "hyphen")
        .when(bare(ref_text) == bare(hyp_text), "punctuation").when(plain_form(ref_text) == plain_form(hyp_text), "accents")
        .when(F.regexp_replace(ref_text, r"\d+", "#") == F.regexp_replace(hyp_text, r"\d+", "#"), "number")
        .when((F.length(ref_text) <= 3) & (F.length(hyp_text) <= 3), "short").otherwise("other")
    )


def mutate(tokens: list[str], kind: str, draw: int) -> list[str]:
    """The list with one token deleted, replaced or swapped with the next, the place chosen by a hash."""
    if not tokens:
        return []
    at = draw % len(tokens)
    if kind == "deleted":
        return tokens[:at] + tokens[at + 1 :]
    if kind == "replaced":
        return [*tokens[:at], tokens[at] + "x", *tokens[at + 1 :]]
    at = min(at, len(tokens) - 2)
    return tokens if at < 0 else [*tokens[:at], tokens[at + 1], tokens[at], *tokens[at + 2 :]]


def mutation_test(texts: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Whether the in-order score notices one changed word: kind, items, noticed. Swaps of equal words change nothing and don't count."""
    kinds = ["deleted", "replaced", "swapped"]
    drawn = texts.withColumn("_draw", F.pmod(F.xxhash64(key), F.lit(1 << 30)).cast("int"))

    def make(t, draw):
        t = t or []
        out = []
        for kind in kinds:
            other = mutate(t, kind, draw)
            if other != t:
                # what both begin and end with is in order in any case, so only what differs is aligned
                begin = next(i for i, pair in enumerate(itertools.zip_longest(t, other)) if pair[0] != pair[1])
                end = 0
                while end < min(len(t), len(other)) - begin and t[len(t) - 1 - end] == other[len(other) - 1 - end]:
                    end += 1
                same = begin + end + matched_in_order(t[begin : len(t) - end], other[begin : len(other) - end])
                out.append((kind, same < len(t) or len(other) != len(t)))
        return out

    found = _rows(drawn, [key], [tokens, "_draw"], make, "kind string, noticed boolean")
    return found.groupBy("kind").agg(F.count("*").alias("items"), F.count_if("noticed").alias("noticed"))


def join_numbers(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent number tokens as one: keys, pos, token. tokens: keys, pos, token."""
    order = Window.partitionBy(*keys).orderBy("pos")
    digits = F.col("token").rlike(r"^\d+$")
    flagged = tokens.withColumn("_d", digits).withColumn("_new", (~(F.col("_d") & F.coalesce(F.lag("_d").over(order), F.lit(False)))).cast("int"))
    grouped = flagged.withColumn("_g", F.sum("_new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return grouped.groupBy(*keys, "_g").agg(F.min("pos").alias("pos"), F.array_join(F.transform(parts, lambda x: x["token"]), "").alias("token")).drop("_g")
