"""Lines to paragraphs and notes, as expressions over the lines before.

Each rule looks at a line, at the line before it and at the state that the lines before leave behind: whether a signature
or an annex header is still going on, and which label or heading opened what the line would go on with. Such states are
last values over the lines that set them, so no line is visited one after another, however long an act is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.common import Stretches, number_runs
from folioflow.functions.text import SMALL

#: Labels that open a unit or an item, also behind an opening quote.
UNIT_LABEL = r"^„?(§ ?\d|Art\. ?\d|\d+[a-z]?[.)] |[a-z]{1,2}\) |[–—-] )"
ITEM_LABEL = r"^„?(\d+[a-z]?\) |[a-z]{1,2}\) |[–—-] )"
POINT_LABEL = r"^„?(\d+|[a-z])\)\s"
ARTICLE_LABEL = r"^(Art\.|§) ?\d"
HEADING_LABEL = r"^(Dział|DZIAŁ|Rozdział|ROZDZIAŁ|Oddział|ODDZIAŁ|Tytuł|TYTUŁ|Księga|KSIĘGA|Część|CZĘŚĆ)\s+\S"
LEFT_OUT = r"\((uchylon|pominięt|pominięc|skreślon)[a-z]*\)$"
SIGNATURE_LABEL = r"^(Minister|Prezes|Marszałek|Przewodniczący|Prezydent|Wojewoda)[^:]{0,80}:"
ANNEX_LABEL = r"^(Załącznik|ZAŁĄCZNIK)( nr \d+)?(\W|$)"
#: Least gap over the font size that parts paragraphs, what it has to be beyond the page's usual gap, the gap below
#: which an annex header goes on, points beyond the usual lead, font sizes that a short line ends before the edge.
GAP, BEYOND, ANNEX_GAP, LEAD, SHORT = 0.45, 0.1, 0.8, 1.2, 2.0
#: Shares of the page's width from which a line is set on the right, or far from the left, and of its height that are its top.
RIGHT, ANNEX_RIGHT, INSET, TOP = 0.45, 0.4, 0.25, 0.2
#: Most words of an annex header and of a signature in text from an image.
ANNEX_WORDS, SIGNATURE_WORDS = 40, 14
_BEFORE = ["page", "band", "col", "x0", "x1", "y_bottom", "font_size", "right_edge", "line_lead", "text"]


def _kinds(after_signature: Column) -> Column:
    """Kind of a line, given whether the line before is a signature."""
    placed = F.coalesce("x0", F.lit(0.0)) > 0
    width = F.when(F.col("pw") > 0, F.col("pw")).otherwise(595.0)
    from_right = lambda share: ~placed | (F.col("x0") > share * width)
    edge = F.when(F.col("right_edge") > 0, F.col("right_edge")).otherwise(0.9 * width)
    flush = (F.col("x0") > INSET * width) & (F.col("x1") > edge - 0.01 * width)
    at_top = ~placed | (F.coalesce("y_top", F.lit(0.0)) < TOP * F.coalesce("ph", F.lit(842.0)))
    words = F.size(F.split("text", r"\s+"))
    image = F.col("mark") != ""
    annex, signature = F.col("text").rlike(ANNEX_LABEL), F.col("text").rlike(SIGNATURE_LABEL)
    return (
        F.when(image & annex & (words <= ANNEX_WORDS), "annex").when(image & signature & (words <= SIGNATURE_WORDS), "signature").when(image, F.col("mark"))
        .when(annex & from_right(ANNEX_RIGHT) & (at_top | after_signature), "annex").when(annex & after_signature & F.coalesce("old_issue", F.lit(False)), "annex")
        .when(signature & (from_right(RIGHT) | flush | after_signature), "signature").otherwise("p")
    )


def _opens(q1: Column) -> Column:
    """Whether a line opens a paragraph, by itself and the line before; headings aside."""
    b, text, size = F.col("_b"), F.col("text"), F.coalesce(F.col("font_size"), F.lit(10.0))
    same_page = F.col("page").eqNullSafe(b["page"])
    same_column = F.col("band").eqNullSafe(b["band"]) & F.col("col").eqNullSafe(b["col"])
    gap = F.when((F.col("y_bottom") > 0) & (b["y_bottom"] > 0), F.col("y_top") - b["y_bottom"])
    small_gap = lambda limit: F.coalesce(gap < limit * size, F.lit(True))
    limit = F.greatest(F.lit(GAP), F.coalesce(q1, F.lit(0.0)) + BEYOND)
    short = F.coalesce((b["x1"] > 0) & (b["x1"] < b["right_edge"] - SHORT * F.coalesce(b["font_size"], F.lit(10.0))), F.lit(False))
    ended, closed, left_out = b["text"].rlike(r"[.:;”]$"), b["text"].rlike(r"[.:;,”]$"), b["text"].rlike(LEFT_OUT)
    unit, item = text.rlike(UNIT_LABEL), text.rlike(ITEM_LABEL)
    number = lambda t: F.regexp_extract(t, POINT_LABEL, 1)
    mine, last = number(text), number(b["text"])
    rank = lambda x: F.coalesce(x.try_cast("int"), F.when(x != "", F.ascii(x) + 1000))
    follows = F.coalesce((rank(mine) == rank(last) + 1) & (F.abs(F.col("x0") - b["x0"]) < 1), F.lit(False))
    point = (mine != "") & (short | follows) & F.coalesce(gap >= 0, F.lit(False)) & F.coalesce(F.abs(F.col("font_size") - b["font_size"]) < 0.5, F.lit(False)) & ~b["text"].endswith("-")
    lead = F.coalesce((b["line_lead"] >= 0) & (gap > b["line_lead"] + LEAD), F.lit(False))
    wide_page = limit > GAP
    on_page = ~small_gap(limit) | (wide_page & short) | (unit & (lead | (short & closed) | point | left_out | (gap.isNull() & ended) | (wide_page & (item | closed))))
    # behind a dropped page number only a sentence goes on
    goes_on = b["text"].rlike(r"[\p{L}][,-]?$") & text.rlike(r"^\p{Ll}")
    over_page = unit | ended | left_out | (F.coalesce("after_number", F.lit(False)) & ~goes_on)
    in_annex = F.coalesce("_in_annex", F.lit(False))
    return (
        F.when(b.isNull(), True).when(F.col("kind") == "annex", ~(in_annex & same_page & small_gap(ANNEX_GAP))).when(F.col("kind") != "p", True)
        .when(in_annex, False).when(F.coalesce("_annexed", F.lit(False)) | (F.col("_last_kind") != "p"), True).when(same_page & same_column, on_page).otherwise(over_page)
    )


#: A signature or an annex header is followed over so many lines at most, and a line farther back than that isn't the one before.
REACH = 64
#: Places are spaced so that lines of one number have their own.
_SPACED = 1024


def line_places(lines: DataFrame) -> DataFrame:
    """Lines with _doc, a key that is never NULL, and _place in the act: by seq, lines without it first, by their ids."""
    ids = F.coalesce(F.col("line_id").cast("long"), F.lit(0))
    place = F.coalesce(F.col("seq").cast("long") * _SPACED + F.pmod(ids, F.lit(_SPACED)), ids * _SPACED - (1 << 62))
    return lines.withColumns({"_doc": F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "_place": place})


def paragraph_lines(lines: DataFrame, gaps: DataFrame, span: int = 8192) -> DataFrame:
    """Lines with text, each with its kind, the line before (_b) and the place of the line that opens its paragraph (_run), headings aside.

    lines may have a boolean after_number: the line follows a page number that was left out. gaps: doc_id, page, q1 (see
    blocks.continuation_gaps)."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    used = ["line_id", "doc_id", "seq", "_doc", "_place", *[c for c in _BEFORE if c != "text"], "pw", "ph", "y_top", "old_issue"]
    flag = F.col("after_number") if "after_number" in lines.columns else F.lit(False).alias("after_number")
    rows = line_places(lines).select(*used, flag, F.coalesce("mark", F.lit("")).alias("mark"), text.alias("text")).filter("text <> ''")
    pages = gaps.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "q1")
    rows = rows.join(pages, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    s = Stretches("_doc", "_place", span * _SPACED, REACH * _SPACED, 3, "line_id")
    # a line that is a signature only behind one leaves that open; all others settle it
    alone, behind = _kinds(F.lit(False)), _kinds(F.lit(True))
    rows = s.spread(rows.withColumns({"_alone": alone, "_behind": behind}))
    settled = F.when(~((F.col("_alone") != "signature") & (F.col("_behind") == "signature")), F.col("_alone") == "signature")
    rows = rows.withColumns({"_b": s.before(F.struct(*_BEFORE)), "_signed": s.before(settled)})
    rows = rows.withColumn("kind", F.when(F.col("_signed"), F.col("_behind")).otherwise(F.col("_alone")))
    # what stands below an annex header on the right belongs to it, as long as nothing else comes between
    below = (F.col("kind") == "p") & F.col("page").eqNullSafe(F.col("_b")["page"]) & (F.col("x0") > ANNEX_RIGHT * F.col("pw")) & (F.col("y_top") - F.col("_b")["y_bottom"] < ANNEX_GAP * F.col("font_size"))
    rows = rows.withColumn("_below", F.coalesce(below, F.lit(False)))
    rows = rows.withColumns({"_annexed": s.before(F.when(~F.col("_below"), F.col("kind") == "annex")), "_last_kind": s.before(F.col("kind"))})
    # a line of the annex header, or the header that an annex line may go on with
    rows = rows.withColumn("_in_annex", F.coalesce("_annexed", F.lit(False)) & (F.col("_below") | (F.col("kind") == "annex")))
    rows = rows.withColumn("_plain", _opens(F.col("q1")))
    # an article right below a heading opens as well: that is told in the paragraph that it would go on with
    article = (F.col("kind") == "p") & F.col("text").rlike(ARTICLE_LABEL) & ~F.col("_plain")
    glued = F.coalesce(F.col("_b")["text"].rlike(f"{SMALL}-$") & F.col("text").rlike(f"^{SMALL}"), F.lit(False))
    shown = rows.select("_doc", "_place", "_part", "_own", "_plain", "doc_id", "line_id", "kind", "page", "text", article.alias("_article"), F.col("text").rlike(HEADING_LABEL).alias("_heading"), glued.alias("_glued"))
    return number_runs(shown, s, F.col("_plain"))


def segment(lines: DataFrame, gaps: DataFrame, span: int = 8192) -> DataFrame:
    """Paragraphs of the lines of each act: doc_id, first_line, kind, page, text, lines.

    A new paragraph begins where the kind changes, at annex headers and signatures, at a gap beyond the page's usual one, and at a
    unit label behind an ended, short or left-out line; over the end of a page or column only at labels and ended lines. Lines
    without an act belong together; lines without seq come first, by their ids. NULL and blank lines are left out.
    """
    rows = paragraph_lines(lines, gaps, span)
    # a word cut at the line before is closed
    piece = F.concat(F.when(F.col("_glued"), "\u0001").otherwise(" "), F.col("text"))
    part = F.struct("_place", "line_id", piece.alias("piece"), "doc_id", "kind", "page", "_heading", "_article")
    grouped = rows.groupBy("_doc", "_run").agg(F.array_sort(F.collect_list(part)).alias("p"))
    # a paragraph that begins with a heading ends before its first article
    cut = F.when(F.element_at("p", 1)["_heading"], F.array_position(F.transform("p", lambda x: x["_article"]), True)).otherwise(0).cast("int")
    halves = F.when(cut > 1, F.array(F.slice("p", F.lit(1), cut - 1), F.slice("p", cut, F.size("p")))).otherwise(F.array("p"))
    whole = grouped.select(F.explode(halves).alias("p")).withColumn("h", F.element_at("p", 1))
    text = F.regexp_replace(F.replace(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit("-\u0001"), F.lit("")), "^[ \u0001]", "")
    return whole.select("h.doc_id", F.col("h.line_id").alias("first_line"), "h.kind", "h.page", text.alias("text"), F.size("p").alias("lines"))


#: A note's label: raised figures with a bracket, a marker, or a plain number, letter or stars with a bracket.
NOTE_LABEL = r"^(\[\^([^\]]+)\]|([¹²³⁴⁵⁶⁷⁸⁹⁰]+)⁾|(\d+)\)|([a-z]{1,2})\)|(\*+)\))"
_NOTE_POINT = r"^(\d+)\)\s"
_NOTE_LETTER = r"^([a-z]{1,2})\)\s"


#: A list of points, and the note that a letter follows, are followed over so many lines at most.
NOTE_REACH = 512


def group_notes(lines: DataFrame, span: int = 8192) -> DataFrame:
    """Notes of the lines below the rules of an act's pages, in order, also over the ends of pages: doc_id, first_seq, page, label, text.

    A marker, raised figure, star or number with a bracket opens a note. Numbered points stay in a note if a list is going on: it
    begins with 1 behind a colon and has no gap; each point begins a line of its own. A letter opens a note if it follows the letter of the note
    before, which has to have ended. Everything else goes on. lines: doc_id, page, seq (order in the act), text; NULL and blank
    lines are left out.
    """
    s = Stretches("_doc", "_place", span, NOTE_REACH, 4)
    rows = lines.select("doc_id", "page", F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("_place"), F.trim("text").alias("text")).filter("text <> ''")
    number = F.regexp_extract("text", _NOTE_POINT, 1).try_cast("int")
    letter = F.nullif(F.regexp_extract("text", _NOTE_LETTER, 1), F.lit(""))
    # letters as numbers, a to z and aa to zz
    own = F.coalesce(F.nullif(F.regexp_extract("text", r"^\[\^([a-z]{1,2})\]", 1), F.lit("")), letter)
    code = F.when(F.length(own) == 2, 26 * (F.ascii(own) - 96) + F.ascii(F.substring(own, 2, 1)) - 96).when(F.length(own) == 1, F.ascii(own) - 96).otherwise(0)
    rows = rows.withColumns({
        "_doc": F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "_number": number, "_letter": letter.isNotNull(),
        "_labelled": F.col("text").rlike(NOTE_LABEL) & letter.isNull(), "_code": code,
    })
    rows = s.spread(rows)
    # events are labelled lines; a list goes on as long as each event is the next number
    rows = rows.withColumns({"_text": s.before(F.right("text", F.lit(1))), "_last": s.before(F.when(F.col("_labelled"), F.coalesce("_number", F.lit(-1))))})
    begins = F.coalesce((F.col("_number") == 1) & (F.col("_text") == ":"), F.lit(False))
    rows = rows.withColumns({"_begins": begins, "_next": F.coalesce(F.col("_number") == F.col("_last") + 1, F.lit(False))})
    # the event that the run of numbers began with tells whether it is a list
    rows = rows.withColumn("_root", s.before(F.when(F.col("_labelled") & (F.col("_begins") | ~F.col("_next")), F.col("_begins"))))
    rows = rows.withColumn("_point", F.col("_labelled") & (F.col("_begins") | (F.col("_next") & F.coalesce("_root", F.lit(False)))))
    # letters behind an ended note; those that open one form a run as the points do
    opener, candidate = F.col("_labelled") & ~F.col("_point"), F.col("_letter") & F.coalesce(F.col("_text") == ".", F.lit(False))
    rows = rows.withColumns({"_opener": opener, "_candidate": candidate})
    rows = rows.withColumn("_code_before", s.before(F.when(F.col("_opener") | F.col("_candidate"), F.col("_code"))))
    rows = rows.withColumn("_follows", F.coalesce(F.col("_candidate") & (F.col("_code_before") > 0) & (F.col("_code") == F.col("_code_before") + 1), F.lit(False)))
    start = F.when(F.col("_opener") | (F.col("_candidate") & ~F.col("_follows")), F.col("_opener") | F.col("_text").isNull())
    rows = rows.withColumn("_open_run", s.before(start))
    opens = F.col("_text").isNull() | F.col("_opener") | (F.col("_follows") & F.coalesce("_open_run", F.lit(False)))
    placed = number_runs(rows.select("_doc", "_place", "_part", "_own", "doc_id", "page", "text", "_point", opens.alias("_opens")), s, F.col("_opens"))
    piece = F.concat(F.when(F.col("_opens"), "").when(F.col("_point"), "\n").otherwise(" "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("_place", piece.alias("piece"), "doc_id", "page", "text")))
    grouped = placed.groupBy("_doc", "_run").agg(parts.alias("p")).withColumn("h", F.element_at("p", 1))
    label = F.coalesce(*[F.nullif(F.regexp_extract("h.text", NOTE_LABEL, k), F.lit("")) for k in range(2, 7)])
    label = F.translate(label, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return grouped.select("h.doc_id", F.col("h._place").alias("first_seq"), "h.page", label.alias("label"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
