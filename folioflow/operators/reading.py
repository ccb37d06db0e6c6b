"""Readings of page images: choice, quality, paragraphs, column order, word repair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


#: Words of units that a number follows, with or without a point.
UNIT_WORDS = (
    "art ust pkt poz nr lit rozdz par str ustęp ustępie ustępu ustępach artykuł artykułu artykule punkt punkcie punktu "
    "załącznik załącznika załączniku rozdział rozdziału część części article paragraph section"
).split()


def lone_one(text: Column) -> Column:
    """A vertical bar by itself read as 1 behind a unit word, or before a comma, 'i', 'lub' or a dash and a number."""
    behind = "|".join(UNIT_WORDS)
    after = F.regexp_replace(text, rf"(?iu)(?<=\b(?:{behind})\.? |§ )\|(?=$|[\s,.;:)–-])", "1")
    return F.regexp_replace(after, r"(?<=\s)\|(?=(?:,| i| lub| oraz| and| or| [-–]) \d)", "1")


def usable(words: str = "words", confidence: str = "confidence") -> Column:
    return F.coalesce((F.col(words) >= 20) & (F.col(confidence) >= 80), F.lit(False))


def line_shape_gate() -> Column:
    """Whether a reading looks like running text by confidence, language and the shape of its lines."""
    longest = F.array_max("line_widths")
    long_lines = F.size(F.filter("line_chars", lambda n: n >= 45)) * 2 >= F.size("line_chars")
    wide_lines = F.size(F.filter("line_widths", lambda w: w >= 0.6 * longest)) * 2 >= F.size("line_widths")
    gate = (F.col("confidence") >= 95) & (F.size("line_chars") >= 5) & F.col("lang").isNotNull() & long_lines & wide_lines
    return F.coalesce(gate, F.lit(False))


def word_gate(tokens: Column, text: Column) -> Column:
    """Three quarters of the tokens are words, at most one symbol in twenty tokens, no caption at the start."""
    words = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{L}{2,}$|^\d+$|^[aeiouwz]$")))
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:()§/%„”\"'–-]"))
    return (words * 4 >= F.size(tokens) * 3) & (symbols * 20 <= F.size(tokens)) & ~text.rlike(r"(?iu)^\s*(rys|tab|wzór|tablica)\b")


def best_reading(readings: DataFrame, key: list[str], order: str) -> DataFrame:
    """The reading of the highest confidence; the first by order of equal ones; one without confidence only if there is no other."""
    columns = [c for c in readings.columns if c not in key]
    rank = F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col(order))
    return readings.groupBy(*key).agg(F.max_by(F.struct(*columns), rank).alias("x")).select(*key, "x.*")


def retry_readings(readings: DataFrame) -> DataFrame:
    """Choice among first reading, turned page, other script and own language: a later attempt wins if it is surer;
    the own-language attempt also if it is as sure. readings: doc_id, page, attempt (0..3), confidence, ..."""
    columns = [c for c in readings.columns if c not in PAGE]
    rank = F.struct(F.coalesce("confidence", F.lit(-1.0)), F.when(F.col("attempt") == 3, 1).otherwise(-F.col("attempt")))
    return readings.groupBy(*PAGE).agg(F.max_by(F.struct(*columns), rank).alias("x")).select(*PAGE, "x.*")


def to_read(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Images whose content, command and engine version the cache lacks."""
    keyed = images.withColumn("cache_key", F.sha2(F.concat_ws("\x00", F.hex("content"), "command", "version"), 256))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def word_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words: doc_id, page, block, par, line, x0, x1, top, bottom, n, conf, text."""
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "text")))
    return words.filter("level = 5 and trim(text) <> ''").groupBy(*PAGE, F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line")).agg(
        F.min("left").alias("x0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.count("*").alias("n"), F.median("conf").alias("conf"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"),
    )


def page_summary(words: DataFrame) -> DataFrame:
    """Words and exact median confidence of each page."""
    kept = words.filter("level = 5 and trim(text) <> ''")
    return kept.groupBy(*PAGE).agg(F.count("*").alias("words"), F.median("conf").alias("confidence"))


UNIT = r"^\s*(§|Art\.|\d+[a-z]?[.)]|[a-z]\))\s*"


def read_paragraphs(lines: DataFrame, header: str = r"(?i)^\s*(dziennik urz|biuletyn|monitor)") -> DataFrame:
    """Paragraphs of the lines of a read page: doc_id, page, para, text.

    Header lines in the top 8 percent are dropped. A line opens a paragraph if it is not below the line
    before, if the gap exceeds one and a half of the median gap and a fifth of the line height, or at a unit. lines: see
    word_lines, with height of the page and seq.
    """
    body = lines.filter(~((F.col("top") < 0.08 * F.col("height")) & F.col("text").rlike(header)))
    order = Window.partitionBy(*PAGE).orderBy("seq")
    gapped = body.withColumn("_gap", F.col("top") - F.lag("bottom").over(order)).withColumn("_above", F.lag("top").over(order))
    usual = gapped.filter("_gap > 0").groupBy(*PAGE).agg(F.median("_gap").alias("_usual"))
    joined = gapped.join(usual, PAGE, "left")
    tall = F.col("_gap") > 1.5 * F.coalesce("_usual", F.lit(0.0)) + 0.2 * (F.col("bottom") - F.col("top"))
    new = F.col("_above").isNull() | (F.col("top") <= F.col("_above")) | F.coalesce(tall, F.lit(False)) | F.col("text").rlike(UNIT)
    numbered = joined.withColumn("para", F.sum(new.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), "([a-ząćęłńóśźż])-\n([a-ząćęłńóśźż])", "$1$2")
    return numbered.groupBy(*PAGE, "para").agg(F.regexp_replace(text, "\n", " ").alias("text"))


def deskew_slope(lines: DataFrame, least: int = 10, apart: float = 200.0, most: float = 0.05) -> DataFrame:
    """Slope of the left margin of each page by the median of slopes between far lines (Theil-Sen): doc_id, page, slope.

    Ignored (0) with fewer than least slopes or beyond most. The pairs of one page stay inside its task. lines: x0, top."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted((r["top"], r["x0"]) for r in table.to_pylist() if r["top"] is not None and r["x0"] is not None)
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in combinations(rows, 2) if b[0] - a[0] > apart]
        slope = median(slopes) if len(slopes) >= least else 0.0
        first = table.slice(0, 1)
        return pa.table({"doc_id": first.column("doc_id"), "page": first.column("page").cast(pa.int32()), "slope": pa.array([slope if abs(slope) <= most else 0.0])})

    return lines.select(*PAGE, "x0", "top").groupBy(*PAGE).applyInArrow(run, "doc_id string, page int, slope double")


def column_split(lines: DataFrame, least_lines: int = 10, least_ends: int = 5) -> DataFrame:
    """x of the gutter of a two-column page: the place with most line ends on its left and line starts on its right: doc_id, page, x.

    lines: x0, x1, width. Pages with few lines or few ends or starts near the middle have none. Candidates
    are the rounded ends near the middle; the score needs one pass over the ordered ends and starts.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        width = max((r["width"] or 0 for r in rows), default=0)
        lo, hi = width * 7 / 16, width * 9 / 16
        ends = sorted(r["x1"] for r in rows)
        starts = sorted(r["x0"] for r in rows)
        near_ends = [x for x in ends if lo <= x <= hi]
        near_starts = [x for x in starts if lo <= x <= hi]
        if len(rows) >= least_lines and len(near_ends) >= least_ends and len(near_starts) >= least_ends:
            scores = {}
            for x in range(round(lo), round(hi) + 1):
                left = sum(1 if e <= x else -1 for e in near_ends)
                right = sum(1 if s >= x else -1 for s in near_starts)
                scores[x] = left + right
            top = max(scores.values())
            best = [x for x, v in scores.items() if v == top]
            out.append({"doc_id": rows[0]["doc_id"], "page": rows[0]["page"], "x": float(best[len(best) // 2])})
        return pa.Table.from_pylist(out, schema=pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("x", pa.float64())]))

    return lines.select(*PAGE, "x0", "x1", "width").groupBy(*PAGE).applyInArrow(run, "doc_id string, page int, x double")


def column_order(lines: DataFrame, split: DataFrame) -> DataFrame:
    """seq of the lines of a page: bands from top to bottom, in a band the left column before the right; lines across the gutter close a band."""
    joined = lines.join(split, PAGE, "left")
    across = F.col("x").isNull() | ((F.col("x0") < F.col("x") - 1) & (F.col("x1") > F.col("x") + 1))
    order = Window.partitionBy(*PAGE).orderBy("top", "x0")
    band = F.sum(F.col("_across").cast("int")).over(order) * 2 - F.col("_across").cast("int")
    placed = joined.withColumn("_across", across).withColumn("_band", band)
    col = F.when(F.col("_across"), 0).when(F.col("x0") >= F.col("x"), 1).otherwise(0)
    final = Window.partitionBy(*PAGE).orderBy("_band", col, "top", "x0")
    return placed.withColumn("seq", F.row_number().over(final)).drop("_across", "_band", "x")


def join_split_rows(lines: DataFrame) -> DataFrame:
    """Pieces of one printed row that stand closer than 0.6 of the page's lower-quartile gap between pieces become one line; a page with fewer
    than five gaps stays as it is."""
    order = Window.partitionBy(*PAGE).orderBy("_row", "x0")
    rows = lines.withColumn("_row", F.round((F.col("top") + F.col("bottom")) / 2 / F.greatest(F.col("bottom") - F.col("top"), F.lit(1))))
    gaps = rows.withColumn("_gap", F.when(F.lag("_row").over(order) == F.col("_row"), F.col("x0") - F.lag("x1").over(order)))
    quartile = gaps.filter("_gap > 0").groupBy(*PAGE).agg(F.when(F.count("_gap") >= 5, F.get(F.sort_array(F.collect_list("_gap")), F.floor(F.count("_gap") / 4).cast("int"))).alias("_q"))
    joined = gaps.join(quartile, PAGE, "left").withColumn("_new", F.coalesce(~(F.col("_gap") < 0.6 * F.col("_q")), F.lit(True)).cast("int"))
    numbered = joined.withColumn("_line", F.sum("_new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return numbered.groupBy(*PAGE, "_line").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")
    ).drop("_line")


def row_order(lines: DataFrame) -> DataFrame:
    """seq of the lines of a one-column page: rows by their centres, a new row half a line height below the last."""
    order = Window.partitionBy(*PAGE).orderBy("_centre", "x0")
    centred = lines.withColumn("_centre", (F.col("top") + F.col("bottom")) / 2)
    new = F.coalesce(F.col("_centre") - F.lag("_centre").over(order) > 0.5 * (F.col("bottom") - F.col("top")), F.lit(True))
    rows = centred.withColumn("_new", new.cast("int")).withColumn("_row", F.sum("_new").over(order))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_row", "x0"))).drop("_centre", "_new", "_row")


def old_gazette(words: Column) -> Column:
    """Whether an issue header stands in the first eighty words."""
    return F.array_join(F.slice(words, 1, 80), " ").rlike(r"(?iu)dziennik (ustaw|urzędowy)|monitor polski")


#: Letters and the letters with marks that readers lose.
MARKED = {"a": "ą", "c": "ć", "e": "ę", "l": "ł", "n": "ń", "o": "ó", "s": "ś", "z": "żź"}


def word_candidates(word: str) -> list[str]:
    """Words with one or two letters given back their marks, or with a one-letter preposition split off."""
    places = [(i, m) for i, c in enumerate(word) for m in MARKED.get(c, "")]
    out = {word[:i] + m + word[i + 1 :] for i, m in places}
    for (i, a), (j, b) in combinations(places, 2):
        if i != j:
            out.add(word[:i] + a + word[i + 1 : j] + b + word[j + 1 :])
    return sorted(out)


def repair_words(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Repairs of unknown words: word, repaired. tokens: word; dictionary: word.

    Only the distinct unknown words of three letters or more are looked at; a repair counts only if
    exactly one candidate is known. Without one, a glued preposition of one letter is split off a word of five or more. Candidates
    are as long as their word, so words longer than every known one have none and aren't tried.
    """
    longest = dictionary.agg(F.max(F.length("word")).alias("longest"))
    unknown = tokens.select(F.lower("word").alias("word")).distinct().filter(F.length("word") >= 3).join(dictionary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tries = [], []
            for w in batch.column(0).to_pylist():
                own = word_candidates(w)
                words += [w] * len(own)
                tries += own
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(tries, pa.string())], names=["word", "try"])

    known = dictionary.select(F.lower("word").alias("try")).distinct()
    tried = unknown.join(F.broadcast(longest), F.length("word") <= F.col("longest")).select("word")
    marked = tried.mapInArrow(run, "word string, try string").join(known, "try", "left_semi").groupBy("word").agg(F.count("*").alias("n"), F.min("try").alias("repaired")).filter("n = 1").drop("n")
    glued = unknown.filter(F.length("word") >= 5).filter(F.substring("word", 1, 1).isin(*"aiouwz")).withColumn("try", F.expr("substring(word, 2)"))
    split = glued.join(known, "try", "left_semi").join(marked, "word", "left_anti").select("word", F.concat(F.substring("word", 1, 1), F.lit(" "), "try").alias("repaired"))
    return marked.unionByName(split)


def section_signs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the section sign given back where 8, $, S or 5 stands for it.

    At the start of a paragraph before a number, unless the number before the point goes on with a list of the page; and
    behind a preposition. paragraphs: doc_id, page, seq, text.
    """
    text = F.col("text")
    start = F.regexp_extract("text", r"^\s*([8$S5])\s?(\d{1,3}[a-z]?)\.\s", 1)
    number = F.regexp_extract("text", r"^\s*(\d+)\.?\s", 1).try_cast("int")
    before = F.lag(number).over(Window.partitionBy(*PAGE).orderBy("seq"))
    lists = F.col("_start").isin("8", "5") & (F.coalesce(before, F.lit(-1)) == F.col("_start").try_cast("int") - 1)
    inner = F.regexp_replace(text, r"(?iu)\b(w|z|do|od|o|według|rozumieniu|podstawie|określonych w|przepisów) [$S8] (?=\d)", "$1 § ")
    outer = F.regexp_replace(inner, r"^(\s*)[8$S5]\s?(?=\d{1,3}[a-z]?\.\s)", "$1§ ")
    return paragraphs.withColumn("_start", start).withColumn("text", F.when((F.col("_start") != "") & ~lists, outer).otherwise(inner)).drop("_start")


def act_lines_of_reading(paragraphs: DataFrame, reach: int = 20) -> DataFrame:
    """Lines of an act from read paragraphs: numbers in [pos, pos + reach] before an act type become lines of their own (act).

    paragraphs: doc_id, page, seq, text, pos. A number glued to a signature or to the end of a paragraph is split off when an act
    type follows. Output: doc_id, page, seq, part, act, text.
    """
    kinds = "USTAWA|ROZPORZĄDZENIE|OBWIESZCZENIE|UCHWAŁA|ZARZĄDZENIE|UMOWA|OŚWIADCZENIE"
    following = F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    glued = rf"^([\s\S]*\S)\s+(\d{{1,4}})\s*$"
    row = paragraphs.withColumn("_next", following)
    number = F.when(F.col("_next").rlike(rf"^\W{{0,3}}({kinds})\b"), F.coalesce(F.regexp_extract("text", r"^\s*(\d{1,4})\s*$", 1).try_cast("int"), F.regexp_extract("text", glued, 2).try_cast("int")))
    inside = number.between(F.col("pos"), F.col("pos") + reach)
    rest = F.when(F.col("text").rlike(r"^\s*\d{1,4}\s*$"), F.lit("")).otherwise(F.regexp_extract("text", glued, 1))
    parts = F.when(inside, F.array(F.struct(rest.alias("text"), F.lit(0).alias("act")), F.struct(number.cast("string").alias("text"), number.alias("act")))).otherwise(
        F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("act")))
    )
    return row.select("doc_id", "page", "seq", F.posexplode(parts).alias("part", "x")).select("doc_id", "page", "seq", "part", "x.act", "x.text").filter("text <> ''")
