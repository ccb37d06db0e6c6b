"""Lines of a page: reading order, roles and zones. Windows run over one page, never over a whole act."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.common import running_sum
from folioflow.operators.measures import mode_by

PAGE = ["doc_id", "page"]
#: Page number between dashes.
BARE_NUMBER = r"^\s*[–—-]\s*\d{1,4}\s*[–—-]\s*$"
#: Running header of an issue: journal name with an issue number, or number and position.
ISSUE_HEADER = r"(?i)^(\d+ )?(dziennik urz|biuletyn obw|monitor)|(?i)^nr\.? \d+ .*poz\. ?\d+"


def once(lines: DataFrame) -> DataFrame:
    """Rows delivered twice once; rows without an id are told apart by their place and text."""
    return lines.dropDuplicates(["line_id", "doc_id", "seq", "text"])


def reading_order(lines: DataFrame) -> DataFrame:
    """place of each line on its page by band, column and top; lines without a position keep their sequence."""
    order = Window.partitionBy(*PAGE).orderBy("band", "col", F.when(F.col("y_bottom") > 0, F.col("y_top")).otherwise(0.0), "seq", "line_id")
    return lines.withColumn("place", F.row_number().over(order))


def page_edges(lines: DataFrame, order: str = "seq") -> DataFrame:
    """Lines with their place from the top and from the bottom of the page."""
    up = Window.partitionBy(*PAGE).orderBy(order, "line_id")
    down = Window.partitionBy(*PAGE).orderBy(F.desc(order), F.desc("line_id"))
    return lines.withColumn("from_top", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down))


def header_lines(lines: DataFrame) -> DataFrame:
    """Lines to strip: a running header as the first line of a page; on page 1 the masthead up to the position number."""
    edged = page_edges(lines)
    position = F.min(F.when(F.col("text").rlike(r"^\s*Poz\. ?\d+\s*$"), F.col("from_top"))).over(Window.partitionBy(*PAGE))
    first = (F.col("from_top") == 1) & F.col("text").rlike(ISSUE_HEADER)
    masthead = (F.col("page") == 1) & (F.col("from_top") <= position)
    return edged.withColumn("_role", F.when(masthead, "masthead").when(first, "header")).filter("_role is not null").drop("from_top", "from_end").withColumnRenamed("_role", "role")


def bare_numbers(lines: DataFrame) -> DataFrame:
    """Page numbers: the first line of a later page that is only a dashed number, high up if it has a position.

    after is the line that follows on the page: segmentation treats it as the page's first."""
    edged = page_edges(lines).withColumn("after", F.lead("line_id").over(Window.partitionBy(*PAGE).orderBy("seq", "line_id")))
    high = (F.coalesce("y_bottom", F.lit(0.0)) == 0) | F.col("ph").isNull() | (F.col("y_top") < 0.08 * F.col("ph"))
    return edged.filter((F.col("from_top") == 1) & (F.col("page") > 1) & F.col("text").rlike(BARE_NUMBER) & high).select("line_id", "doc_id", "page", "text", "after")


def old_issue(lines: DataFrame) -> DataFrame:
    """Pages with an issue header or masthead in the top fifth: doc_id, page, old."""
    high = (F.coalesce("y_bottom", F.lit(0.0)) == 0) | (F.col("y_top") < 0.2 * F.coalesce("ph", F.lit(842.0)))
    return lines.groupBy(*PAGE).agg(F.coalesce(F.bool_or(high & F.col("text").rlike(ISSUE_HEADER)), F.lit(False)).alias("old"))


def body_size(lines: DataFrame) -> DataFrame:
    """Font size of most characters of each page: doc_id, page, body."""
    return mode_by(lines, PAGE, F.col("font_size"), F.length("text")).select(*PAGE, F.col("mode").alias("body"))


def note_zone(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Lines of the footnote zone: small ones in the lower two fifths, or below a free rule (doc_id, page, y)."""
    sized = lines.join(body_size(lines), PAGE)
    small = (F.col("font_size") < F.col("body") - 0.5) & (F.col("y_top") > 0.6 * F.coalesce("ph", F.lit(842.0)))
    if rules is None:
        return sized.filter(small).drop("body")
    top = rules.groupBy(*PAGE).agg(F.min("y").alias("rule_y"))
    return sized.join(top, PAGE, "left").filter(small | (F.col("y_top") >= F.col("rule_y"))).drop("body", "rule_y")


def free_rules(shapes: DataFrame) -> DataFrame:
    """Rules 130 to 160 points wide in the left fifth of the page whose ends touch no other shape: doc_id, page, y.

    shapes: doc_id, page, shape_id, x0, x1, top, bottom, pw. Ends are matched in a grid of 4 points,
    so only shapes nearby meet.
    """
    rules = shapes.filter("x1 - x0 between 130 and 160 and bottom - top < 2 and x0 < 0.2 * pw")
    near = lambda v, d: F.floor(v / 4) + d
    ends = rules.select(*PAGE, "shape_id", "top", F.explode(F.array("x0", "x1")).alias("x"))
    cells = ends.withColumn("dx", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])))
    cells = cells.select(*PAGE, "shape_id", "x", "top", near(F.col("x"), F.col("dx")).alias("cx"), near(F.col("top"), F.col("dy")).alias("cy"))
    corners = shapes.select(*PAGE, F.col("shape_id").alias("other"), "top", "bottom", F.explode(F.array("x0", "x1")).alias("ox"))
    others = corners.select(*PAGE, "other", "ox", F.explode(F.array("top", "bottom")).alias("oy"))
    others = others.withColumn("cx", near(F.col("ox"), F.lit(0))).withColumn("cy", near(F.col("oy"), F.lit(0)))
    touched = cells.join(others, [*PAGE, "cx", "cy"]).filter("other <> shape_id and abs(ox - x) <= 2 and abs(oy - top) <= 2").select(*PAGE, "shape_id").distinct()
    return rules.join(touched, [*PAGE, "shape_id"], "left_anti").select(*PAGE, F.col("top").alias("y"))


def act_numbers(lines: DataFrame) -> DataFrame:
    """Lone numbers of one to four digits that stand in the middle of the page in large print."""
    middle = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("pw") / 2) <= 10
    return lines.filter(F.col("text").rlike(r"^\s*\d{1,4}\s*$") & (F.col("font_size") >= 11.5) & middle)


def usual_edges(lines: DataFrame) -> DataFrame:
    """Per column: right end that at least three long lines share, and lead between lines that at least three share."""
    column = [*PAGE, "band", "col"]
    edge = mode_by(lines.filter(F.length("text") >= 40), column, F.round("x1"), least=3).select(*column, F.col("mode").alias("right_edge"))
    order = Window.partitionBy(*column).orderBy("y_top", "seq", "line_id")
    gaps = lines.filter("y_bottom > 0").withColumn("gap", F.round(F.col("y_top") - F.lag("y_bottom").over(order), 1)).filter("gap > 0")
    lead = mode_by(gaps, column, F.col("gap"), least=3).select(*column, F.col("mode").alias("line_lead"))
    return edge.join(lead, column, "full_outer")


def page_kinds(lines: DataFrame) -> DataFrame:
    """doc_id, page, kind: 'text', 'scan', 'ocr', 'sparse' (a text layer of under 20 characters) or 'empty'."""
    sums = lines.groupBy(*PAGE).agg(
        F.sum(F.when(F.col("mark") == "", F.length("text")).otherwise(0)).alias("chars"),
        F.bool_or(F.col("mark") == "scan").alias("scan"), F.bool_or(F.col("mark") == "ocr").alias("ocr"), F.count("text").alias("n"),
    )
    kind = (
        F.when(F.col("n") == 0, "empty").when(F.col("chars") >= 100, "text").when(F.col("scan"), "scan").when(F.col("ocr"), "ocr")
        .when(F.col("chars") < 20, "sparse").otherwise("text")
    )
    return sums.select(*PAGE, kind.alias("kind"))


def page_ranges(pages: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """Pages of each key as ranges: '2-4, 7'. Gaps and islands over distinct pages."""
    distinct = pages.select(key, page).filter(F.col(page).isNotNull()).distinct()
    run = F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page))
    runs = distinct.withColumn("_run", run).groupBy(key, "_run").agg(F.min(page).alias("_a"), F.max(page).alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", "_a", "_b"))
    parts = F.array_sort(F.collect_list(F.struct("_a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("pages"))


def expand_ranges(df: DataFrame, key: str = "doc_id", ranges: str = "pages") -> DataFrame:
    """The pages of written ranges, one row each."""
    part = df.select(key, F.explode(F.split(F.col(ranges), r"\s*,\s*")).alias("_p"))
    bounds = F.transform(F.split("_p", r"\s*-\s*"), lambda x: x.try_cast("int"))
    return part.select(key, F.explode(F.sequence(F.get(bounds, F.lit(0)), F.coalesce(F.get(bounds, F.lit(1)), F.get(bounds, F.lit(0))))).alias("page"))


def trim_pages(pages: Column, first: Column, last: Column) -> Column:
    """A page list without the pages outside the act."""
    return F.filter(pages, lambda p: p.between(first, last))


def act_slices(lines: DataFrame) -> DataFrame:
    """Stretches of lines between act numbers: doc_id, slice (0: before the first), act, first_seq, last_seq, lines."""
    starts = F.when(F.col("act") > 0, 1).otherwise(0)
    numbered = running_sum(lines.select("doc_id", "seq", "line_id", "act"), ["doc_id"], ["seq", "line_id"], starts, "before")
    numbered = numbered.withColumn("slice", F.col("before") + starts)
    return numbered.groupBy("doc_id", "slice").agg(
        F.max(F.when(F.col("act") > 0, F.col("act"))).alias("act"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("lines")
    )


def own_slice(lines: DataFrame, position: Column, reach: int = 20) -> DataFrame:
    """Lines of each document from its own number up to the next number within reach, the order (seq) deciding."""
    own = lines.withColumn("_pos", position)
    start = own.filter("act = _pos").groupBy("doc_id").agg(F.min("seq").alias("_start"))
    later = own.filter((F.col("act") > F.col("_pos")) & (F.col("act") <= F.col("_pos") + reach)).join(start, "doc_id").filter("seq > _start")
    stop = later.groupBy("doc_id").agg(F.min("seq").alias("_stop"))
    bounds = start.join(stop, "doc_id", "left")
    return lines.join(bounds, "doc_id").filter("seq >= _start and (_stop is null or seq < _stop)").drop("_start", "_stop")


def colophon_start(lines: DataFrame) -> DataFrame:
    """Place of the printer's note on the last page of each act, if it names a serial number: doc_id, from_seq."""
    last = lines.groupBy("doc_id").agg(F.max("page").alias("page"))
    end = lines.join(last, ["doc_id", "page"])
    publisher = F.col("text").rlike(r"(?iu)^\s*(wydawca|redakcja|egzemplarze|nakład|druk)")
    marks = end.groupBy("doc_id").agg(F.min(F.when(publisher, F.col("seq"))).alias("from_seq"), F.bool_or(F.col("text").rlike(r"ISSN")).alias("serial"))
    return marks.filter("serial and from_seq is not null").select("doc_id", "from_seq")


def scan_colophon_start(lines: DataFrame) -> DataFrame:
    """The same for scans without a serial number: after the last signature of the last page, never before act text."""
    last = lines.groupBy("doc_id").agg(F.max("page").alias("page"))
    end = lines.join(last, ["doc_id", "page"])
    sign = F.col("text").rlike(r"^\s*(Minister|Prezes|Marszałek|Przewodniczący)[^:]*:")
    note = F.col("text").rlike(r"(?iu)(wydawca|redakcja|tłoczono|drukarni|prenumerat|cena )")
    text = F.col("text").rlike(r"^\s*(§|Art\.)\s*\d")
    marks = end.groupBy("doc_id").agg(F.max(F.when(sign, F.col("seq"))).alias("signed"), F.max(F.when(text, F.col("seq"))).alias("last_unit"))
    after = end.join(marks, "doc_id").filter(note & (F.col("seq") > F.coalesce("signed", F.lit(-1))) & F.col("signed").isNotNull())
    found = after.groupBy("doc_id").agg(F.min("seq").alias("from_seq"), F.max("last_unit").alias("last_unit"))
    return found.filter("last_unit is null or last_unit < from_seq").select("doc_id", "from_seq")


def rows_of_words(words: DataFrame, slack: float = 1.0) -> DataFrame:
    """row number of each word of a page: words whose middles lie within a row, sizes within two points.

    One dimension of islands: words by top; a new row starts where a word's middle lies below all words of the row
    before. words: doc_id, page, word_id, top, bottom, size.
    """
    order = Window.partitionBy(*PAGE).orderBy("top", "word_id")
    reach = F.max("bottom").over(order.rowsBetween(-8, -1))
    new = F.coalesce(((F.col("top") + F.col("bottom")) / 2 > reach + slack) | (F.abs(F.col("size") - F.lag("size").over(order)) >= 2), F.lit(True))
    return words.withColumn("_new", new.cast("int")).withColumn("row", F.sum("_new").over(order)).drop("_new")


def gutters(rows: DataFrame, low: float = 6, high: float = 20, least: int = 3) -> DataFrame:
    """Gap between two columns that at least least rows share: doc_id, page, left, right, rows.

    rows: doc_id, page, row, x0, x1 of the parts of rows. Parts are matched with the next part of their row."""
    order = Window.partitionBy(*PAGE, "row").orderBy("x0")
    gaps = rows.withColumn("_next", F.lead("x0").over(order)).filter(F.col("_next") - F.col("x1") >= low).filter(F.col("_next") - F.col("x1") <= high)
    counted = gaps.groupBy(*PAGE, F.round("_next").alias("right")).agg(F.count("*").alias("rows"), F.round(F.max("x1")).alias("left")).filter(F.col("rows") >= least)
    best = counted.groupBy(*PAGE).agg(F.max_by(F.struct("left", "right", "rows"), F.struct("rows", -F.col("right"))).alias("x"))
    return best.select(*PAGE, "x.*")


def document_gutter(found: DataFrame) -> DataFrame:
    """The gutter of most pages of a document, for its other pages: doc_id, right."""
    return mode_by(found, ["doc_id"], F.col("right")).select("doc_id", F.col("mode").alias("right"))


def columns_and_bands(rows: DataFrame, gutter: DataFrame) -> DataFrame:
    """band and col of each row part: rows across the gutter are bands of their own, between them column 0 before 1."""
    joined = rows.join(gutter.select(*PAGE, "left", "right"), PAGE, "left")
    wide = F.coalesce((F.col("x0") < F.col("left") - 1) & (F.col("x1") > F.col("right") + 1), F.lit(True))
    order = Window.partitionBy(*PAGE).orderBy("top", "x0")
    flagged = joined.withColumn("_wide", wide)
    change = F.coalesce((F.col("_wide") != F.lag("_wide").over(order)), F.lit(False)).cast("int")
    first = F.first("_wide").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")
    banded = flagged.withColumn("_change", change).withColumn("band", F.sum("_change").over(order) + first)
    col = F.when(F.col("_wide"), 0).when(F.col("x0") >= F.col("right") - 1, 1).otherwise(0)
    return banded.withColumn("col", col).drop("_wide", "_change", "left", "right")
