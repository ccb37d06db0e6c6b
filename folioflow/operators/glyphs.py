"""Glyph tables of pages: clean-up before lines are formed. Everything is decided per page."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators.measures import mode_by

PAGE = ["doc_id", "page"]


def direction(matrix: Column) -> Column:
    """Writing direction by the text matrix: 0, 90, 180 or 270."""
    quarter = F.bround(F.degrees(F.atan2(matrix[1], matrix[0])) / 90)
    return (F.pmod(quarter.cast("int"), F.lit(4)) * 90).cast("int")


def is_watermark(matrix: Column, tag: Column) -> Column:
    """Marked as an artifact and set at a slant."""
    slant = F.pmod(F.degrees(F.atan2(matrix[1], matrix[0])), F.lit(90.0))
    return F.coalesce((tag == "Artifact") & (slant > 10) & (slant < 80), F.lit(False))


def drop_watermarks(chars: DataFrame) -> DataFrame:
    return chars.filter(~is_watermark(F.col("matrix"), F.col("tag")))


def drop_soft_blanks(chars: DataFrame) -> DataFrame:
    """Without blanks that take no place: a blank or soft hyphen that starts where the next glyph of its line starts, and blanks of a run whose
    middle lies in a letter; of a dropped run one blank stays if the gap is a tenth of the size or more."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    blank = F.col("text").isin(" ", "­", " ")
    near = F.lead("x0").over(order) - F.col("x0")
    same_line = F.abs(F.lead("top").over(order) - F.col("top")) < 0.5 * F.col("size")
    rows = chars.withColumn("_blank", blank).withColumn("_here", blank & F.col("upright") & F.coalesce(same_line & near.between(-0.5, 0.05), F.lit(False)))
    run = F.sum((~F.col("_blank")).cast("int")).over(order)
    rows = rows.withColumn("_run", run)
    # letters by rounded top: blanks meet only letters of their own line
    letters = rows.filter("not _blank").select(*PAGE, F.round("top").alias("_t"), F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    inside = rows.filter("_blank").withColumn("_t", F.round("top")).join(letters, [*PAGE, "_t"]).filter("(x0 + x1) / 2 > _a and (x0 + x1) / 2 < _b").select(*PAGE, "seq").distinct().withColumn("_in", F.lit(True))
    marked = rows.join(inside, [*PAGE, "seq"], "left").withColumn("_drop", F.col("_here") | F.coalesce("_in", F.lit(False)))
    own = Window.partitionBy(*PAGE, "_run")
    marked = marked.withColumn("_after", F.lead("x0").over(order))
    blanks = lambda c: F.when(F.col("_blank"), c)
    marked = marked.withColumns({
        "_left": F.max(F.when(~F.col("_blank"), F.col("x1"))).over(own), "_right": F.max(blanks(F.col("_after"))).over(own),
        "_gone": F.min(blanks(F.col("_drop").cast("int"))).over(own) == 1, "_first": F.min(blanks(F.col("seq"))).over(own) == F.col("seq"),
    })
    wide = F.coalesce(F.col("_right") - F.col("_left") >= 0.1 * F.col("size"), F.lit(False))
    keep = ~F.col("_drop") | (F.col("_gone") & F.col("_first") & wide & ~F.col("_here"))
    return marked.filter(~F.col("_blank") | keep).select(*chars.columns)


def single_math(text: Column, font: Column) -> Column:
    """One of two equal letters that a mathematical font draws for one."""
    twice = (F.length(text) == 2) & (F.substring(text, 1, 1) == F.substring(text, 2, 1)) & font.contains("Math")
    return F.when(twice, F.substring(text, 1, 1)).otherwise(text)


def upright_box(chars: DataFrame, page_width: str = "pw", page_height: str = "ph") -> DataFrame:
    """Boxes of turned text as if it ran from left to right; size by the length of the matrix column."""
    d = direction(F.col("matrix"))
    pw, ph = F.col(page_width), F.col(page_height)
    x0, x1, top, bottom = (F.col(c) for c in ("x0", "x1", "top", "bottom"))
    pick = lambda a, b, c, e: F.when(d == 90, a).when(d == 180, b).when(d == 270, c).otherwise(e)
    boxes = {
        "x0": pick(ph - bottom, pw - x1, top, x0), "x1": pick(ph - top, pw - x0, bottom, x1),
        "top": pick(x0, ph - bottom, pw - x1, top), "bottom": pick(x1, ph - top, pw - x0, bottom),
        "size": F.hypot(F.col("matrix")[2], F.col("matrix")[3]),
    }
    return chars.withColumns(boxes)


def repaired_box(chars: DataFrame, baseline: str = "baseline") -> DataFrame:
    """A box that lies to more than three quarters under its baseline is moved so that 0.3 of it stays there."""
    height = F.col("bottom") - F.col("top")
    below = F.col("bottom") - F.col(baseline)
    shift = F.when(below > 0.75 * height, below - 0.3 * height).otherwise(0.0)
    return chars.withColumn("_shift", shift).withColumns({"top": F.col("top") - F.col("_shift"), "bottom": F.col("bottom") - F.col("_shift")}).drop("_shift")


def hidden_glyphs(chars: DataFrame, header_band: float = 0.08) -> DataFrame:
    """Placed glyphs that no reader sees: in the header band, under own text, or without ink (min_gray above 180): doc_id, page, seq.

    chars: placed (boolean), ph, min_gray. Own and placed glyphs meet by rounded top and a grid of 8 points."""
    placed = chars.filter("placed")
    no_ink = placed.filter((F.col("top") < header_band * F.col("ph")) | (F.coalesce("min_gray", F.lit(0)) > 180)).select(*PAGE, "seq")
    cell = lambda c: F.floor(c / 8)
    own = chars.filter("not placed and trim(text) <> ''").select(*PAGE, cell(F.col("x0")).alias("_c"), F.col("x0").alias("_x"), F.col("top").alias("_y"))
    near = placed.withColumn("_c", F.explode(F.array(*[cell(F.col("x0")) + d for d in (-1, 0, 1)]))).join(own, [*PAGE, "_c"]).filter("abs(x0 - _x) <= 3 and abs(top - _y) <= 3")
    return no_ink.unionByName(near.select(*PAGE, "seq")).distinct()


def drop_drawn_twice(chars: DataFrame, within: float = 0.3) -> DataFrame:
    """Without glyphs drawn again: the same letter, font and size within 0.3 points of one that stays, in content order.

    Which stay depends on those before, so each page decides for itself; candidates come from a grid."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(chars.schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        grid: dict[tuple, list[tuple[float, float]]] = {}
        kept = []
        for r in rows:
            ident = (r["text"], r["fontname"], round(r["size"] or 0, 1))
            cx, cy = round((r["x0"] or 0) / within), round((r["top"] or 0) / within)
            near = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in grid.get((*ident, cx + dx, cy + dy), ()))
            if any(abs(x - r["x0"]) <= within and abs(y - r["top"]) <= within for x, y in near):
                continue
            grid.setdefault((*ident, cx, cy), []).append((r["x0"], r["top"]))
            kept.append(r)
        return pa.Table.from_pylist(kept, schema=schema)

    return chars.groupBy(*PAGE).applyInArrow(run, chars.schema)


def words_of(chars: DataFrame, old_gap: float = 1.0, bold_gap: float = 2.2) -> DataFrame:
    """word number of each glyph: a blank, another line or a gap ends a word; fonts of old issues (named ...PL) set words by gaps alone."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    gap = F.col("x0") - F.lag("x1").over(order)
    limit = F.when(F.col("fontname").endswith("PL"), F.when(F.col("fontname").contains("Bold"), bold_gap).otherwise(old_gap)).otherwise(0.3 * F.col("size"))
    moved = F.abs(F.col("top") - F.lag("top").over(order)) > 0.5 * F.col("size")
    new = F.coalesce((gap > limit) | moved | (F.trim(F.lag("text").over(order)) == ""), F.lit(True))
    return chars.withColumn("_new", new.cast("int")).withColumn("word", F.sum("_new").over(order)).drop("_new")


def merged_sizes(chars: DataFrame, share: float = 0.001) -> DataFrame:
    """size as the most frequent of the sizes within a thousandth of the smallest of their group, per page."""
    counts = chars.groupBy(*PAGE, "size").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*PAGE).orderBy("size")
    new = F.coalesce(F.col("size") > F.lag("size").over(order) * (1 + share), F.lit(True)).cast("int")
    grouped = counts.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order))
    modal = grouped.withColumn("_to", F.max_by("size", F.struct("_n", -F.col("size"))).over(Window.partitionBy(*PAGE, "_g"))).select(*PAGE, "size", "_to")
    return chars.join(modal, [*PAGE, "size"]).withColumn("size", F.col("_to")).select(*chars.columns)


def frames(chars: DataFrame) -> DataFrame:
    """Writing directions of each page, the most frequent first: doc_id, page, angle, n, rank."""
    counts = chars.groupBy(*PAGE, direction(F.col("matrix")).alias("angle")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "angle")))


def unmapped_share(chars: DataFrame) -> DataFrame:
    """Share of glyphs without a character, and whether the page has no usable text layer: doc_id, page, share, unusable."""
    share = F.round(F.avg(F.col("text").startswith("(cid:").cast("int")), 6)
    return chars.groupBy(*PAGE).agg(share.alias("share")).withColumn("unusable", F.col("share") > 0.1)


def images(shapes: DataFrame) -> DataFrame:
    """Image cover of each page: doc_id, page, cover, large (a tenth or more), top, box of the largest. shapes: kind, x0, x1, top, bottom, pw, ph."""
    clip = lambda c, hi: F.greatest(F.lit(0.0), F.least(c, hi))
    box = shapes.filter("kind = 'image'").select(*PAGE, "pw", "ph", clip(F.col("x0"), F.col("pw")).alias("x0"), clip(F.col("x1"), F.col("pw")).alias("x1"), clip(F.col("top"), F.col("ph")).alias("top"), clip(F.col("bottom"), F.col("ph")).alias("bottom"))
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    sums = box.groupBy(*PAGE).agg(F.round(F.sum(area) / F.first(F.col("pw") * F.col("ph")), 6).alias("cover"), F.max_by(F.struct("x0", "top", "x1", "bottom"), F.struct(area, -F.col("top"))).alias("largest"))
    return sums.withColumn("large", F.col("cover") >= 0.1).withColumn("top", F.col("largest.top"))


def hidden_scans(chars: DataFrame, cover: DataFrame, font: str = r"(?i)glyphless|hidden|invisible") -> DataFrame:
    """Pages that are a scan under an invisible text layer: four fifths image and ten glyphs or more in such a font: doc_id, page."""
    counts = chars.filter(F.col("fontname").rlike(font)).groupBy(*PAGE).agg(F.count("*").alias("n")).filter("n >= 10")
    return counts.join(cover.filter("cover >= 0.8"), PAGE, "left_semi").select(*PAGE)


def text_images(chars: DataFrame, cover: DataFrame, most: int = 30) -> DataFrame:
    """Large images that carry text to be read: with at most so many glyphs over them they are no background: doc_id, page, glyphs, read."""
    large = cover.filter("large").select(*PAGE, "largest")
    over = chars.join(large, PAGE).filter("x0 >= largest.x0 and x1 <= largest.x1 and top >= largest.top and bottom <= largest.bottom and trim(text) <> ''")
    n = over.groupBy(*PAGE).agg(F.count("*").alias("glyphs"))
    return large.join(n, PAGE, "left").select(*PAGE, F.coalesce("glyphs", F.lit(0)).alias("glyphs"), (F.coalesce("glyphs", F.lit(0)) <= most).alias("read"))


def _code_page_table() -> tuple[str, str]:
    """Letters that a Polish Mac font shows when read with the western Mac encoding, and what they are."""
    polish = "ĄĆĘŁŃÓŚŹŻąćęłńóśźż"
    read = "".join(c.encode("mac_latin2").decode("mac_roman") for c in polish)
    return read, polish


def mac_polish(text: Column, font: Column) -> Column:
    """Glyphs of fonts named ...PL with the letters that they draw."""
    return F.when(font.endswith("PL"), F.translate(text, *_code_page_table())).otherwise(text)


def plain_math(text: Column) -> Column:
    """Mathematical letters and digits, Latin and Greek, as plain ones: those of the block of mathematical letters by their compatibility form."""
    block = [chr(c) for c in range(0x1D400, 0x1D800) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    return F.translate(text, "".join(block), "".join(unicodedata.normalize("NFKC", c) for c in block))


def glyph_survey(chars: DataFrame) -> DataFrame:
    """Glyphs of several characters by font: fontname, text, pages, n."""
    many = chars.filter((F.length("text") > 1) & ~F.col("text").startswith("(cid:"))
    per_page = many.groupBy("fontname", "text", *PAGE).agg(F.count("*").alias("k"))
    return per_page.groupBy("fontname", "text").agg(F.count("*").alias("pages"), F.sum("k").alias("n"))


def modal_size(chars: DataFrame) -> DataFrame:
    return mode_by(chars, PAGE, F.col("size"))


def clean(chars: DataFrame) -> DataFrame:
    """All steps that need no image: watermarks, blanks, double letters, drawn twice, sizes, code pages."""
    rows = drop_watermarks(chars).withColumn("text", single_math(F.col("text"), F.col("fontname")))
    rows = drop_drawn_twice(drop_soft_blanks(rows))
    return merged_sizes(rows).withColumn("text", plain_math(mac_polish(F.col("text"), F.col("fontname"))))


def _glued(words: DataFrame, fits: Column, opening: str, closing: str, change) -> DataFrame:
    """Words with the small words that fit behind them taken in, chains included. words: doc_id, page, row, word_id, text, x0, x1, top, bottom, size."""
    order = Window.partitionBy(*PAGE, "row").orderBy("x0", "word_id")
    before = {f"_{c}": F.lag(c).over(order) for c in ("text", "x1", "top", "bottom", "size")}
    rows = words.withColumns(before)
    # a chain keeps the measure of the word that it began with
    joined = rows.withColumn("_small", F.coalesce(fits, F.lit(False)))
    chain = F.coalesce(F.lag("_small").over(order) & (F.col("x0") - F.col("_x1") < 1.5) & (F.abs(F.col("size") - F.col("_size")) < 0.5), F.lit(False))
    joined = joined.withColumn("_small", F.col("_small") | chain)
    numbered = joined.withColumn("_g", F.sum((~F.col("_small")).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("x0", "word_id", "_small", "text")))
    grouped = numbered.groupBy(*PAGE, "row", "_g").agg(parts.alias("p"), F.min("word_id").alias("word_id"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("size").alias("size"))
    text = lambda small: F.array_join(F.transform(F.filter("p", lambda x: x["_small"] == small), lambda x: x["text"]), "")
    tail = text(F.lit(True))
    full = F.concat(text(F.lit(False)), F.when(tail == "", "").otherwise(F.concat(F.lit(opening), change(tail), F.lit(closing))))
    return grouped.select(*PAGE, "row", "word_id", full.alias("text"), "x0", "x1", "size")


def index_words(words: DataFrame) -> DataFrame:
    """Small raised words glued to the letter or digit before them, in brackets: 30 and a raised f are '30[f]'."""
    near = (F.col("x0") - F.col("_x1")).between(-2, 1.5) & F.col("_text").rlike(r"[\p{L}\p{N}]$")
    raised = (F.col("size") < 0.8 * F.col("_size")) & (F.col("bottom") < F.col("_bottom") - 0.15 * (F.col("_bottom") - F.col("_top")))
    return _glued(words, near & raised, "[", "]", lambda t: t)


def lowered_words(words: DataFrame) -> DataFrame:
    """Small words below the middle of the word before them, as lowered digits where they are digits: CO and 2 are 'CO₂'."""
    near = (F.col("x0") - F.col("_x1")).between(-2, 1.5)
    low = (F.col("size") < 0.8 * F.col("_size")) & (F.col("top") > (F.col("_top") + F.col("_bottom")) / 2)
    return _glued(words, near & low, "", "", lambda t: F.translate(t, "0123456789", "₀₁₂₃₄₅₆₇₈₉"))
