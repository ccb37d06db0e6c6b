"""Paragraphs (blocks) of an act, and its footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.common import previous, running_sum
from folioflow.functions.text import join_lines
from folioflow.operators import paragraphs

#: Labels of units and items, signatures and annex headers.
UNIT = r"^\s*(§ ?\d+|Art\. ?\d+|\d+[a-z]?\.|\d+[a-z]?\)|[a-z]{1,2}\)|[–—-] )"
ITEM = r"^\s*(\d+[a-z]?\)|[a-z]{1,2}\)|[–—-] )"
SIGNATURE = r"^\s*(Minister|Prezes|Marszałek|Przewodniczący|Prezydent|Wojewoda)[^:]{0,80}:"
ANNEX = r"^\s*(Załącznik|ZAŁĄCZNIK)( nr \d+)?\b"
ACT_TYPE = r"^\W{0,3}(USTAWA|ROZPORZĄDZENIE|OBWIESZCZENIE|UCHWAŁA|ZARZĄDZENIE|UMOWA|OŚWIADCZENIE|POSTANOWIENIE)\b"


def once(blocks: DataFrame) -> DataFrame:
    return blocks.dropDuplicates(["block_id"])


def joined_next(lines: DataFrame) -> DataFrame:
    """Each line joined with the next of its page: line_id, joined. The last line of a page stays as it is."""
    after = F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("seq", "line_id"))
    return lines.select("line_id", F.when(after.isNull(), F.col("text")).otherwise(join_lines(F.col("text"), after)).alias("joined"))


def continuation_gaps(lines: DataFrame, least: int = 5) -> DataFrame:
    """Lower quartile (an element) of gap over size before continuation lines, per page with enough of them: doc_id, page, q1.

    Rows delivered twice count once."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq", "line_id")
    gap = (F.col("y_top") - F.lag("y_bottom").over(order)) / F.col("font_size")
    placed = lines.filter("y_bottom > 0 and font_size > 0").withColumn("_twin", F.lag(F.struct("seq", "line_id")).over(order).eqNullSafe(F.struct("seq", "line_id")))
    rows = placed.filter("not _twin").withColumn("gap", F.round(gap, 4))
    going_on = rows.filter(F.col("gap").isNotNull() & ~F.col("text").rlike(UNIT))
    # one page bounds the list
    values = going_on.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("gap")).alias("v")).filter(F.size("v") >= least)
    return values.select("doc_id", "page", F.get("v", F.floor(F.size("v") / 4).cast("int")).alias("q1"))


def point_sequence(blocks: DataFrame) -> DataFrame:
    """Numbered and lettered points with the point before: block_id, label, follows (whether the label is the next one)."""
    label = F.regexp_extract("text", r"^\s*(\d+|[a-z])\)", 1)
    points = blocks.withColumn("label", label).filter("label <> ''")
    seen = previous(points, ["doc_id"], ["seq", "block_id"], "label", "before")
    number = (F.col("label").try_cast("int") == F.col("before").try_cast("int") + 1)
    letter = (F.length("label") == 1) & (F.length("before") == 1) & (F.ascii("label") == F.ascii("before") + 1) & ~F.col("label").rlike(r"\d")
    return seen.select("doc_id", "block_id", "label", F.coalesce(number | letter, F.lit(False)).alias("follows"))


def parts(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of their part: 0 is the main text, every annex header begins the next."""
    opens = F.when(F.col("kind") == "annex", 1).otherwise(0)
    numbered = running_sum(blocks, ["doc_id"], ["seq", "block_id"], opens, "_before")
    return numbered.withColumn("part", F.col("_before") + F.when(F.col("kind") == "annex", 1).otherwise(0)).drop("_before")


def document_text(blocks: DataFrame) -> DataFrame:
    """Texts of all blocks with their place in the document: doc_id, place (from 0), text. One row per block, an act of any size."""
    return running_sum(blocks, ["doc_id"], ["seq", "block_id"], F.lit(1), "place").select("doc_id", "place", "text")


def demote_quoted_annex(blocks: DataFrame) -> DataFrame:
    """An annex header of a scan that stands before the signature is quoted text."""
    signed = blocks.filter("kind = 'signature'").groupBy("doc_id").agg(F.max("seq").alias("_signed"))
    quoted = (F.col("kind") == "annex") & (F.col("seq") < F.col("_signed"))
    return blocks.join(signed, "doc_id", "left").withColumn("kind", F.when(quoted, "p").otherwise(F.col("kind"))).drop("_signed")


def starts_act(text: Column) -> Column:
    return text.rlike(ACT_TYPE)


def segment(lines: DataFrame, span: int = 8192) -> DataFrame:
    """Paragraphs of the lines of each act (see paragraphs.segment). Rows delivered twice count once."""
    return paragraphs.segment(lines, continuation_gaps(lines), span)


# ---- footnotes

#: A note's label: raised figures with a bracket, or a plain number or letter with one.
LABEL = r"^\s*([¹²³⁴⁵⁶⁷⁸⁹⁰]+⁾|\d+\)|[a-z]\)|\*+\))"


def note_labels(notes: DataFrame) -> DataFrame:
    """label of each note as a plain number or letter; NULL if it has none."""
    raw = F.translate(F.regexp_extract("text", LABEL, 1), "⁰¹²³⁴⁵⁶⁷⁸⁹⁾) ", "0123456789")
    return notes.withColumn("label", F.when(raw != "", raw))


def number_labels(notes: DataFrame) -> DataFrame:
    """Labels made unique: the k-th note of a label in a document gets _k from the second on."""
    k = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("seq", "footnote_id"))
    named = F.when(k > 1, F.concat_ws("_", "label", k.cast("string"))).otherwise(F.col("label"))
    return notes.filter("label is not null").withColumn("unique_label", named)


def note_pages(notes: DataFrame) -> DataFrame:
    """Pages of each label in order: doc_id, label, pages."""
    return notes.filter("label is not null").groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def references(blocks: DataFrame) -> DataFrame:
    """Note markers of the blocks: doc_id, block_id, page, label (one row per marker and block)."""
    return blocks.select("doc_id", "block_id", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))).alias("label"))


def resolve_pages(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Page of the note that each reference page leads to: the same or the next with notes, else the last: doc_id, page, note_page.

    A forward as-of join as one window over the distinct pages of both sides.
    """
    wanted = refs.select("doc_id", "page").distinct().withColumn("note_page", F.lit(None).cast("int"))
    there = notes.filter("page is not null").select("doc_id", "page").distinct().withColumn("note_page", F.col("page"))
    both = wanted.withColumn("_ref", F.lit(True)).unionByName(there.withColumn("_ref", F.lit(False)))
    ahead = Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("doc_id")
    found = F.coalesce(F.first("note_page", ignorenulls=True).over(ahead), F.max("note_page").over(whole))
    return both.withColumn("found", found).filter("_ref").select("doc_id", "page", F.col("found").alias("note_page"))


def plain_labels(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Notes in body type count only if a marker of their label occurs and no marked note has the label. notes: with label, marked."""
    used = refs.select("doc_id", "label").distinct()
    taken = notes.filter("marked").select("doc_id", "label").distinct()
    plain = notes.filter("not marked").join(used, ["doc_id", "label"], "left_semi").join(taken, ["doc_id", "label"], "left_anti")
    return notes.filter("marked").unionByName(plain)


def letter_references(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Texts in which a letter marker stays only if its note exists; others become the letter in brackets."""
    letters = notes.filter(F.col("label").rlike("^[a-z]$")).groupBy("doc_id").agg(F.collect_set("label").alias("_letters"))
    joined = blocks.join(letters, "doc_id", "left")
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\^([a-z])\]"), F.lit(1)))
    lost = F.array_except(marks, F.coalesce("_letters", F.array().cast("array<string>")))
    text = F.aggregate(lost, F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("[^"), x, F.lit("]")), F.concat(x, F.lit(")"))))
    return joined.withColumn("text", text).drop("_letters")


def printed_notes(blocks: DataFrame) -> DataFrame:
    """Markers that open a line are printed notes: they and their references in the same part become raised figures.

    blocks: with part (see parts)."""
    opening = F.regexp_extract("text", r"^\[\^(\d+)\]", 1)
    labels = blocks.withColumn("_l", opening).filter("_l <> ''").groupBy("doc_id", "part").agg(F.collect_set("_l").alias("_labels"))
    raised = lambda x: F.translate(x, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    text = F.aggregate("_labels", F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("[^"), x, F.lit("]")), F.concat(raised(x), F.lit("⁾"))))
    return blocks.join(labels, ["doc_id", "part"], "left").withColumn("text", F.when(F.col("_labels").isNull(), F.col("text")).otherwise(text)).drop("_labels")


