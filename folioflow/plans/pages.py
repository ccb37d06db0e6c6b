"""Queries of the glyph, layout, reading, note and slicing operators.

The tables hold lines, not glyphs, words with boxes or shapes; these are made from the lines by plain rules (a word of a line stands for a
glyph or a recognised word, its place in the line sets its font, matrix and size), the same in Spark and in SQL, over all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import escape_markup, evaluation_tokens, plain_form, roman_value, written_date
from folioflow.operators import alignment, glyphs, layout, markdown, paragraphs, reading, slicing, tree
from folioflow.operators import blocks as b
from folioflow.plans.gazette import _BLOCKS, _LINES, _NOTES, _PAGES, _blocks, _lines, _notes, _pages
from folioflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_WORDS = f"""(SELECT *, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM (SELECT doc_id, page, seq, line_id, x0 AS lx, y_top AS top, y_bottom AS bottom, font_size, pw, coalesce(ph, 842) AS ph, string_split(text, ' ') AS ws
FROM {_LINES} WHERE mark = '' AND y_bottom > 0 AND text <> '' AND seq IS NOT NULL))"""
#: What the place of a word in its line gives a glyph; read by both engines.
_GLYPH = {
    "seq": "CAST(seq AS BIGINT) * 10000 + k", "x0": "lx + 20 * k", "x1": "lx + 20 * k + 15", "size": "font_size + (k % 3) * 0.005", "baseline": "bottom - (k % 4) * 3",
    "fontname": "CASE k % 4 WHEN 0 THEN 'TimesPL' WHEN 1 THEN 'Times-BoldPL' WHEN 2 THEN 'CambriaMath' ELSE 'HiddenText' END", "tag": "CASE WHEN k % 7 = 0 THEN 'Artifact' END",
    "placed": "k % 6 = 0", "min_gray": "(k * 37) % 256",
}
_MATRIX = [[1.0, 0.0, 0.0, 1.0], [0.0, 1.0, -1.0, 0.0], [-1.0, 0.0, 0.0, -1.0], [0.0, -1.0, 1.0, 0.0], [0.8, 0.6, -0.6, 0.8]]
_G = "(SELECT doc_id, page, k, text, top, bottom, pw, ph, " + ", ".join(f"{v} AS {c}" for c, v in _GLYPH.items()) + ", CASE k % 5 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MATRIX)) + f" END AS matrix FROM {_WORDS})"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).filter("mark = '' and y_bottom > 0 and text <> '' and seq is not null")
    return rows.select("doc_id", "page", "seq", "line_id", F.col("x0").alias("lx"), F.col("y_top").alias("top"), F.col("y_bottom").alias("bottom"), "font_size", "pw", F.coalesce("ph", F.lit(842.0)).alias("ph"), F.posexplode(F.split("text", " ")).alias("k", "text"))


def _glyphs(spark: SparkSession, sf: str) -> DataFrame:
    matrix = F.element_at(F.array(*[F.array(*[F.lit(x) for x in m]) for m in _MATRIX]), F.col("k") % 5 + 1).alias("matrix")
    return _words(spark, sf).select("doc_id", "page", "k", "text", "top", "bottom", "pw", "ph", *[F.expr(v).alias(c) for c, v in _GLYPH.items()], matrix, F.lit(True).alias("upright"))


_ANGLE = "((round(degrees(atan2(matrix[2], matrix[1])) / 90)::INT + 4) % 4 * 90)"


@query(f"SELECT doc_id, page, {_ANGLE}::INT AS angle, count(*) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, {_ANGLE})::INT AS rank FROM {_G} GROUP BY doc_id, page, {_ANGLE}")
def glyph_frames(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.frames(_glyphs(spark, sf))


@query(f"SELECT doc_id, page, count(*) AS n FROM {_G} WHERE NOT (coalesce(tag = 'Artifact', false) AND k % 5 = 4) GROUP BY ALL")
def glyphs_without_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.drop_watermarks(_glyphs(spark, sf)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query(f"SELECT left(text, 1) AS text, count(*) AS n FROM {_G} WHERE fontname = 'CambriaMath' AND text <> '' GROUP BY 1")
def single_math(spark: SparkSession, sf: str) -> DataFrame:
    """Glyphs of mathematical fonts that are drawn twice, once."""
    twice = _glyphs(spark, sf).filter("fontname = 'CambriaMath' and text <> ''").withColumn("text", F.repeat(F.substring("text", 1, 1), F.lit(2)))
    return twice.groupBy(glyphs.single_math(F.col("text"), F.col("fontname")).alias("text")).agg(F.count("*").alias("n"))


@query(f"""
WITH b AS (SELECT doc_id, page, {_ANGLE} AS d, x0, x1, top, bottom, pw, ph FROM {_G})
SELECT doc_id, page, round(sum(CASE d WHEN 90 THEN ph - bottom WHEN 180 THEN pw - x1 WHEN 270 THEN top ELSE x0 END), 3) AS x0, round(sum(CASE d WHEN 90 THEN ph - top WHEN 180 THEN pw - x0 WHEN 270 THEN bottom ELSE x1 END), 3) AS x1,
round(sum(CASE d WHEN 90 THEN x0 WHEN 180 THEN ph - bottom WHEN 270 THEN pw - x1 ELSE top END), 3) AS top, round(sum(CASE d WHEN 90 THEN x1 WHEN 180 THEN ph - top WHEN 270 THEN pw - x0 ELSE bottom END), 3) AS bottom, round(sum(1.0::DOUBLE), 3) AS size FROM b GROUP BY ALL
""")
def upright_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the boxes of turned text as if it ran from left to right."""
    return glyphs.upright_box(_glyphs(spark, sf)).groupBy("doc_id", "page").agg(*[F.round(F.sum(c), 3).alias(c) for c in ("x0", "x1", "top", "bottom", "size")])


@query(f"""
WITH b AS (SELECT *, CASE WHEN bottom - baseline > 0.75 * (bottom - top) THEN bottom - baseline - 0.3 * (bottom - top) ELSE 0 END AS s FROM {_G})
SELECT doc_id, page, round(sum(top - s), 3) AS top, round(sum(bottom - s), 3) AS bottom FROM b GROUP BY ALL
""")
def repaired_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.repaired_box(_glyphs(spark, sf)).groupBy("doc_id", "page").agg(F.round(F.sum("top"), 3).alias("top"), F.round(F.sum("bottom"), 3).alias("bottom"))


@query(f"""
WITH g AS (SELECT * FROM {_G}), p AS (SELECT * FROM g WHERE placed), o AS (SELECT * FROM g WHERE NOT placed AND trim(text) <> '')
SELECT doc_id, page, seq FROM p WHERE top < 0.08 * ph OR min_gray > 180 UNION SELECT p.doc_id, p.page, p.seq FROM p JOIN o ON p.doc_id = o.doc_id AND p.page = o.page AND abs(p.x0 - o.x0) <= 3 AND abs(p.top - o.top) <= 3
""")
def hidden_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.hidden_glyphs(_glyphs(spark, sf))


@query(f"""
WITH g AS (SELECT * FROM {_G}), t AS (SELECT doc_id, page, text, fontname, size, x0, top, seq * 2 AS seq FROM g UNION ALL SELECT doc_id, page, text, fontname, size, x0 + 0.2, top, seq * 2 + 1 FROM g WHERE k % 3 = 0)
SELECT doc_id, page, count(*) AS n, sum(seq)::BIGINT AS seqs FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.text = a.text AND b.fontname = a.fontname AND round(b.size, 1) = round(a.size, 1) AND b.seq < a.seq AND abs(a.x0 - b.x0) <= 0.3 AND abs(a.top - b.top) <= 0.3)
GROUP BY ALL
""")
def glyphs_drawn_twice(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of glyphs of which a third are drawn again a little to the right."""
    g = _glyphs(spark, sf).select("doc_id", "page", "text", "fontname", "size", "x0", "top", "k", (F.col("seq") * 2).alias("seq"))
    again = g.filter("k % 3 = 0").withColumns({"x0": F.col("x0") + 0.2, "seq": F.col("seq") + 1})
    return glyphs.drop_drawn_twice(g.unionByName(again).drop("k")).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(f"""
WITH w AS (SELECT *, CASE WHEN coalesce(x0 - lag(x1) OVER x > CASE fontname WHEN 'TimesPL' THEN 1.0 WHEN 'Times-BoldPL' THEN 2.2 ELSE 0.3 * size END OR abs(top - lag(top) OVER x) > 0.5 * size OR trim(lag(text) OVER x) = '', true) THEN 1 ELSE 0 END AS n
FROM (SELECT * REPLACE (x0 - 14 * (k % 2) AS x0) FROM {_G}) WINDOW x AS (PARTITION BY doc_id, page ORDER BY seq))
SELECT doc_id, page, sum(n)::BIGINT AS words FROM w GROUP BY ALL
""")
def glyph_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each page when every other glyph stands close to the one before."""
    moved = _glyphs(spark, sf).withColumn("x0", F.col("x0") - 14 * (F.col("k") % 2))
    return glyphs.words_of(moved).groupBy("doc_id", "page").agg(F.max("word").alias("words"))


@query(f"""
WITH c AS (SELECT doc_id, page, size, count(*) AS n FROM {_G} GROUP BY ALL), g AS (SELECT *, CASE WHEN coalesce(size > lag(size) OVER (PARTITION BY doc_id, page ORDER BY size) * 1.001, true) THEN 1 ELSE 0 END AS new FROM c),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY size ROWS UNBOUNDED PRECEDING) AS grp FROM g), m AS (SELECT *, first_value(size) OVER (PARTITION BY doc_id, page, grp ORDER BY n DESC, size) AS modal FROM h)
SELECT doc_id, page, modal AS size, sum(n)::BIGINT AS n FROM m GROUP BY doc_id, page, modal
""")
def merged_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.merged_sizes(_glyphs(spark, sf)).groupBy("doc_id", "page", "size").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, page, round(avg(CASE WHEN k % 9 = 8 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN k % 9 = 8 THEN 1.0 ELSE 0.0 END), 6) > 0.1 AS unusable FROM {_G} GROUP BY ALL")
def unmapped_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.unmapped_share(_glyphs(spark, sf).withColumn("text", F.when(F.col("k") % 9 == 8, F.lit("(cid:5)")).otherwise(F.col("text"))))


#: A page's lines of a third of all seq as images that reach over the page's edge.
_SHAPES = f"(SELECT doc_id, page, 'image' AS kind, x0 - 100 AS x0, x1 + 300 AS x1, y_top AS top, y_bottom + 40 * (seq % 7) AS bottom, pw, coalesce(ph, 842) AS ph FROM {_LINES} WHERE y_bottom > 0 AND seq % 3 = 0 AND pw > 0)"


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).filter("y_bottom > 0 and seq % 3 = 0 and pw > 0")
    return rows.select("doc_id", "page", F.lit("image").alias("kind"), (F.col("x0") - 100).alias("x0"), (F.col("x1") + 300).alias("x1"), F.col("y_top").alias("top"), (F.col("y_bottom") + 40 * (F.col("seq") % 7)).alias("bottom"), "pw", F.coalesce("ph", F.lit(842.0)).alias("ph"))


_IMAGES = f"""(SELECT doc_id, page, round(sum((x1 - x0) * (bottom - top)) / max(pw * ph), 6) AS cover, arg_max(row(x0, top, x1, bottom), row((x1 - x0) * (bottom - top), -top)) AS l
FROM (SELECT doc_id, page, pw, ph, greatest(0, least(x0, pw)) AS x0, greatest(0, least(x1, pw)) AS x1, greatest(0, least(top, ph)) AS top, greatest(0, least(bottom, ph)) AS bottom FROM {_SHAPES}) GROUP BY doc_id, page)"""


@query(f"SELECT doc_id, page, round(cover, 4) AS cover, cover >= 0.1 AS large, l[2] AS top FROM {_IMAGES}")
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Image cover of each page and the top of the largest."""
    return glyphs.images(_shapes(spark, sf)).select("doc_id", "page", F.round("cover", 4).alias("cover"), "large", "top")


@query(f"""
WITH i AS (SELECT * FROM {_IMAGES} WHERE cover >= 0.1), o AS (SELECT i.doc_id, i.page, count(*) AS n FROM {_G} g JOIN i ON g.doc_id = i.doc_id AND g.page = i.page AND g.x0 >= l[1] AND g.x1 <= l[3] AND g.top >= l[2] AND g.bottom <= l[4] AND trim(text) <> '' GROUP BY ALL)
SELECT i.doc_id, i.page, coalesce(n, 0)::BIGINT AS glyphs, coalesce(n, 0) <= 30 AS read FROM i LEFT JOIN o ON i.doc_id = o.doc_id AND i.page = o.page
""")
def text_images(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.text_images(_glyphs(spark, sf), glyphs.images(_shapes(spark, sf)))


@query(f"""
WITH c AS (SELECT doc_id, page FROM {_G} WHERE fontname = 'HiddenText' GROUP BY ALL HAVING count(*) >= 10) SELECT doc_id, page FROM c JOIN {_IMAGES} USING (doc_id, page) WHERE cover >= 0.8
""")
def hidden_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are mostly image under a text layer in a hidden font."""
    return glyphs.hidden_scans(_glyphs(spark, sf), glyphs.images(_shapes(spark, sf)))


_MAC = glyphs._code_page_table()


@query(f"SELECT text, count(*) AS n FROM {_G} WHERE fontname LIKE '%PL' GROUP BY 1")
def mac_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the fonts of old issues, read with the wrong Mac encoding and restored; signs of that encoding restored as well."""
    rows = _glyphs(spark, sf).filter("fontname like '%PL'").filter(~F.col("text").rlike(f"[{_MAC[0]}]"))
    other = _glyphs(spark, sf).filter("fontname like '%PL'").filter(F.col("text").rlike(f"[{_MAC[0]}]")).select("text")
    read = rows.withColumn("text", F.translate("text", _MAC[1], _MAC[0]))
    return read.select(glyphs.mac_polish(F.col("text"), F.col("fontname")).alias("text")).unionByName(other).groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT upper(left(text, 1)) AS text, count(*) AS n FROM {_G} WHERE regexp_matches(text, '^[A-Za-z0-9]') GROUP BY 1")
def plain_math(spark: SparkSession, sf: str) -> DataFrame:
    """First letters and digits of words, set in mathematical bold and made plain."""
    first = F.upper(F.substring("text", 1, 1))
    code = F.when(first.rlike("[A-Z]"), F.ascii(first) - 65 + 0x1D400).otherwise(F.ascii(first) - 48 + 0x1D7CE)
    # as UTF-8 bytes, since chr() knows the first 256 only
    utf8 = F.unhex(F.concat(F.lit("F09D"), F.hex(F.lit(0x80) + F.floor(code / 64) % 64), F.hex(F.lit(0x80) + code % 64))).cast("string")
    return _glyphs(spark, sf).filter(F.col("text").rlike("^[A-Za-z0-9]")).select(glyphs.plain_math(utf8).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT fontname, text, count(DISTINCT (doc_id, page)) AS pages, count(*) AS n FROM {_G} WHERE length(text) > 1 GROUP BY ALL")
def glyph_survey(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.glyph_survey(_glyphs(spark, sf))


# ---- layout


@query(f"SELECT line_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY band NULLS FIRST, col NULLS FIRST, CASE WHEN y_bottom > 0 THEN y_top ELSE 0 END NULLS FIRST, seq NULLS FIRST, line_id)::INT AS place FROM {_LINES}")
def reading_places(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(_lines(spark, sf)).select("line_id", "place")


#: Halves of each line, in every fourth of which a narrow gap stands between them; others reach over both.
_PARTS = f"(SELECT doc_id, page, line_id AS row, x0 + 230 * h AS x0, x0 + 200 + 230 * h + (CASE WHEN seq % 4 = 0 THEN 18 WHEN seq % 5 = 1 THEN 240 ELSE 0 END) AS x1, y_top AS top FROM {_LINES}, (VALUES (0), (1)) v(h) WHERE mark = '' AND y_bottom > 0)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).filter("mark = '' and y_bottom > 0").withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    more = F.expr("CASE WHEN seq % 4 = 0 THEN 18 WHEN seq % 5 = 1 THEN 240 ELSE 0 END")
    return rows.select("doc_id", "page", F.col("line_id").alias("row"), (F.col("x0") + 230 * F.col("h")).alias("x0"), (F.col("x0") + 200 + 230 * F.col("h") + more).alias("x1"), F.col("y_top").alias("top"))


_GUTTERS = f"""(WITH p AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, page, row ORDER BY x0) AS nx FROM {_PARTS}), c AS (SELECT doc_id, page, round(nx) AS r, count(*) AS n, round(max(x1)) AS l FROM p WHERE nx - x1 >= 6 AND nx - x1 <= 20 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, page, arg_max(l, row(n, -r)) AS left, arg_max(r, row(n, -r)) AS right, max(n) AS rows FROM c GROUP BY ALL)"""


@query(f"SELECT * FROM {_GUTTERS}")
def page_gutters(spark: SparkSession, sf: str) -> DataFrame:
    return layout.gutters(_parts(spark, sf))


@query(f"SELECT doc_id, arg_max(\"right\", row(n, -\"right\")) AS right FROM (SELECT doc_id, \"right\", count(*) AS n FROM {_GUTTERS} GROUP BY ALL) GROUP BY 1")
def document_gutters(spark: SparkSession, sf: str) -> DataFrame:
    return layout.document_gutter(layout.gutters(_parts(spark, sf)))


@query(f"""
WITH j AS (SELECT p.*, g."left" AS gl, g."right" AS gr, coalesce(p.x0 < g."left" - 1 AND p.x1 > g."right" + 1, true) AS wide FROM {_PARTS} p LEFT JOIN {_GUTTERS} g ON p.doc_id = g.doc_id AND p.page = g.page),
f AS (SELECT *, coalesce(wide <> lag(wide) OVER w, false)::INT AS ch, first_value(wide) OVER w AS fw FROM j WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, x0)),
k AS (SELECT doc_id, page, sum(ch) OVER (PARTITION BY doc_id, page ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) + fw::INT AS band, CASE WHEN wide THEN 0 WHEN x0 >= gr - 1 THEN 1 ELSE 0 END AS col FROM f)
SELECT doc_id, page, col::INT AS col, count(*) AS n, max(band)::BIGINT AS bands FROM k GROUP BY doc_id, page, col
""")
def bands_and_columns(spark: SparkSession, sf: str) -> DataFrame:
    parts = _parts(spark, sf)
    placed = layout.columns_and_bands(parts, layout.gutters(parts))
    return placed.groupBy("doc_id", "page", "col").agg(F.count("*").alias("n"), F.max("band").alias("bands"))


@query(f"""
WITH w AS (SELECT doc_id, page, CAST(seq AS BIGINT) * 10000 + k AS word_id, top + (k % 3) * 0.4 AS top, bottom + (k % 3) * 0.4 AS bottom, font_size + CASE WHEN k % 11 = 10 THEN 3 ELSE 0 END AS size FROM {_WORDS}),
n AS (SELECT *, CASE WHEN coalesce((top + bottom) / 2 > max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, word_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) + 1 OR abs(size - lag(size) OVER (PARTITION BY doc_id, page ORDER BY top, word_id)) >= 2, true) THEN 1 ELSE 0 END AS new FROM w)
SELECT doc_id, page, sum(new)::BIGINT AS rows FROM n GROUP BY ALL
""")
def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of words that stand a little above and below each other."""
    words = _words(spark, sf).select("doc_id", "page", F.expr("CAST(seq AS BIGINT) * 10000 + k").alias("word_id"), F.expr("top + (k % 3) * 0.4").alias("top"), F.expr("bottom + (k % 3) * 0.4").alias("bottom"), F.expr("font_size + CASE WHEN k % 11 = 10 THEN 3 ELSE 0 END").alias("size"))
    return layout.rows_of_words(words).groupBy("doc_id", "page").agg(F.max("row").alias("rows"))


@query(f"""
WITH s AS (SELECT doc_id, page, line_id AS id, x0, x0 + 135 + (seq % 9) * 5 AS x1, y_top AS top, y_top + CASE WHEN seq % 5 = 0 THEN 4 ELSE 0.5 END AS bottom, pw FROM {_LINES} WHERE y_bottom > 0 AND seq IS NOT NULL),
c AS (SELECT doc_id, page, id, unnest([x0, x1]) AS ox, top, bottom FROM s), o AS (SELECT doc_id, page, id, ox, unnest([top, bottom]) AS oy FROM c),
r AS (SELECT * FROM s WHERE x1 - x0 BETWEEN 130 AND 160 AND bottom - top < 2 AND x0 < 0.2 * pw)
SELECT doc_id, page, top AS y FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = r.doc_id AND o.page = r.page AND o.id <> r.id AND (abs(ox - r.x0) <= 2 OR abs(ox - r.x1) <= 2) AND abs(oy - r.top) <= 2)
""")
def free_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the places of lines that touch no other."""
    rows = _lines(spark, sf).filter("y_bottom > 0 and seq is not null")
    shapes = rows.select("doc_id", "page", F.col("line_id").alias("shape_id"), "x0", F.expr("x0 + 135 + (seq % 9) * 5").alias("x1"), F.col("y_top").alias("top"), F.expr("y_top + CASE WHEN seq % 5 = 0 THEN 4 ELSE 0.5 END").alias("bottom"), "pw")
    return layout.free_rules(shapes)


@query(f"""
WITH l AS (SELECT *, CASE WHEN seq % 50 = 7 THEN 'Wydawca: Kancelaria' WHEN seq % 50 = 8 THEN 'ISSN 1234' ELSE text END AS t FROM {_LINES}), m AS (SELECT doc_id, max(page) AS page FROM l GROUP BY 1),
c AS (SELECT l.doc_id, min(CASE WHEN regexp_matches(t, '(?i)^\\s*(wydawca|redakcja|egzemplarze|nakład|druk)') THEN seq END) AS from_seq, bool_or(regexp_matches(t, 'ISSN')) AS serial FROM l JOIN m ON l.doc_id = m.doc_id AND l.page = m.page GROUP BY 1)
SELECT doc_id, from_seq FROM c WHERE serial AND from_seq IS NOT NULL
""")
def colophons(spark: SparkSession, sf: str) -> DataFrame:
    """Printer's notes put into the lines of each act, found on its last page."""
    text = F.expr("CASE WHEN seq % 50 = 7 THEN 'Wydawca: Kancelaria' WHEN seq % 50 = 8 THEN 'ISSN 1234' ELSE text END")
    return layout.colophon_start(_lines(spark, sf).withColumn("text", text))


@query(f"""
WITH l AS (SELECT *, CASE WHEN seq % 40 = 11 THEN 'Minister Zdrowia: J. Nowak' WHEN seq % 40 = 13 THEN 'Tłoczono w drukarni' ELSE text END AS t FROM {_LINES}), m AS (SELECT doc_id, max(page) AS page FROM l GROUP BY 1),
e AS (SELECT l.doc_id, seq, t FROM l JOIN m ON l.doc_id = m.doc_id AND l.page = m.page),
s AS (SELECT doc_id, max(CASE WHEN regexp_matches(t, '^\\s*(Minister|Prezes|Marszałek|Przewodniczący)[^:]*:') THEN seq END) AS signed, max(CASE WHEN regexp_matches(t, '^\\s*(§|Art\\.)\\s*[0-9]') THEN seq END) AS unit FROM e GROUP BY 1),
f AS (SELECT e.doc_id, min(seq) AS from_seq, max(unit) AS unit FROM e JOIN s ON e.doc_id = s.doc_id WHERE regexp_matches(t, '(?i)(wydawca|redakcja|tłoczono|drukarni|prenumerat|cena )') AND seq > signed GROUP BY 1)
SELECT doc_id, from_seq FROM f WHERE unit IS NULL OR unit < from_seq
""")
def scan_colophons(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE WHEN seq % 40 = 11 THEN 'Minister Zdrowia: J. Nowak' WHEN seq % 40 = 13 THEN 'Tłoczono w drukarni' ELSE text END")
    return layout.scan_colophon_start(_lines(spark, sf).withColumn("text", text))


@query(f"SELECT doc_id, list_filter(list_sort(list(DISTINCT page)), lambda p: p BETWEEN 2 AND 5) AS pages FROM {_LINES} WHERE page IS NOT NULL GROUP BY 1")
def trimmed_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _lines(spark, sf).filter("page is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias("p"))
    return pages.select("doc_id", layout.trim_pages(F.col("p"), F.lit(2), F.lit(5)).alias("pages"))


@query(f"SELECT line_id, replace(t, chr(1), '1') AS text FROM (SELECT line_id, text || ' art. ' || chr(1) || ', ' || chr(1) || ' i 2' AS t FROM {_LINES} WHERE text IS NOT NULL AND text NOT LIKE '%|%')")
def lone_ones(spark: SparkSession, sf: str) -> DataFrame:
    """A bar behind a unit word and before a number, put behind every line, is read as 1."""
    rows = _lines(spark, sf).filter("text is not null and text not like '%|%'")
    return rows.select("line_id", reading.lone_one(F.concat("text", F.lit(" art. |, | i 2"))).alias("text"))


# ---- readings

#: Words of the lines as rows of a recognition: the place in the page in tenths of points, a confidence by the place in the line.
_OCR = f"(SELECT doc_id, page, 5 AS level, CAST(seq // 8 AS INT) AS block_num, CAST(seq // 4 % 2 AS INT) AS par_num, CAST(seq % 4 AS INT) AS line_num, CAST(k AS INT) AS word_num, lx + 20 * k AS \"left\", top, 15.0 AS width, bottom - top AS height, (k * 13) % 100 AS conf, text FROM {_WORDS})"


def _ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select("doc_id", "page", F.lit(5).alias("level"), F.expr("CAST(floor(seq / 8) AS INT)").alias("block_num"), F.expr("CAST(floor(seq / 4) % 2 AS INT)").alias("par_num"), F.expr("CAST(seq % 4 AS INT)").alias("line_num"), F.col("k").alias("word_num"), F.expr("lx + 20 * k").alias("left"), "top", F.lit(15.0).alias("width"), F.expr("bottom - top").alias("height"), F.expr("(k * 13) % 100").alias("conf"), "text")


@query(f"SELECT doc_id, page, count(*) AS words, median(conf)::DOUBLE AS confidence FROM {_OCR} WHERE trim(text) <> '' GROUP BY ALL")
def reading_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return reading.page_summary(_ocr_words(spark, sf))


_OCR_LINES = f"(SELECT doc_id, page, block_num AS block, par_num AS par, line_num AS line, min(\"left\") AS x0, max(\"left\" + width) AS x1, min(top) AS top, max(top + height) AS bottom, count(*) AS n, median(conf)::DOUBLE AS conf, string_agg(text, ' ' ORDER BY word_num) AS text FROM {_OCR} WHERE trim(text) <> '' GROUP BY ALL)"


@query(f"SELECT * FROM {_OCR_LINES}")
def reading_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a recognition to lines."""
    return reading.word_lines(_ocr_words(spark, sf))


@query(f"""
WITH l AS (SELECT doc_id, page, top, bottom, text, 842.0 AS height, block * 100 + par * 10 + line AS seq FROM {_OCR_LINES}),
b AS (SELECT *, top - lag(bottom) OVER w AS gap, lag(top) OVER w AS above FROM l WHERE NOT (top < 0.08 * height AND regexp_matches(text, '(?i)^\\s*(dziennik urz|biuletyn|monitor)')) WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
u AS (SELECT doc_id, page, median(gap) AS usual FROM b WHERE gap > 0 GROUP BY ALL),
n AS (SELECT b.*, above IS NULL OR top <= above OR coalesce(gap > 1.5 * coalesce(usual, 0) + 0.2 * (bottom - top), false) OR regexp_matches(text, '^\\s*(§|Art\\.|[0-9]+[a-z]?[.)]|[a-z]\\))\\s*') AS new FROM b LEFT JOIN u ON b.doc_id = u.doc_id AND b.page = u.page),
p AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS para FROM n)
SELECT doc_id, page, para::BIGINT AS para, replace(regexp_replace(string_agg(text, chr(10) ORDER BY seq), '([a-ząćęłńóśźż])-\\n([a-ząćęłńóśźż])', '\\1\\2', 'g'), chr(10), ' ') AS text FROM p GROUP BY ALL
""")
def reading_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a recognition to paragraphs."""
    lines = reading.word_lines(_ocr_words(spark, sf))
    return reading.read_paragraphs(lines.select("doc_id", "page", "top", "bottom", "text", F.lit(842.0).alias("height"), F.expr("block * 100 + par * 10 + line").alias("seq")))


@query(f"""
WITH c AS (SELECT doc_id, page, x0, text, (y_top + y_bottom) / 2 AS c, y_bottom - y_top AS h, line_id FROM {_LINES} WHERE y_bottom > 0),
n AS (SELECT *, CASE WHEN coalesce(c - lag(c) OVER (PARTITION BY doc_id, page ORDER BY c, x0) > 0.5 * h, true) THEN 1 ELSE 0 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY c, x0 ROWS UNBOUNDED PRECEDING) AS row FROM n)
SELECT doc_id, page, max(row)::BIGINT AS rows FROM r GROUP BY ALL
""")
def reading_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the lines of each page by their centres: the last number of a page that row_order gives, as rows of one line."""
    rows = _lines(spark, sf).filter("y_bottom > 0").select("doc_id", "page", "x0", F.col("y_top").alias("top"), F.col("y_bottom").alias("bottom"), "line_id")
    order = reading.row_order(rows)
    # the first line of each row, told by the order that the operator gives
    w = F.lag(F.struct("top", "bottom")).over(F_window("doc_id", "page", order="seq"))
    centre = (F.col("top") + F.col("bottom")) / 2
    new = F.coalesce(centre - (w["top"] + w["bottom"]) / 2 > 0.5 * (F.col("bottom") - F.col("top")), F.lit(True))
    return order.withColumn("new", new.cast("int")).groupBy("doc_id", "page").agg(F.sum("new").alias("rows"))


def F_window(*keys: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


@query(f"""
WITH a AS (SELECT doc_id, page, t AS attempt, confidence - 7 * ((page_id + t) % 3) AS confidence FROM {_PAGES}, (VALUES (0), (1), (2), (3)) v(t) WHERE doc_id IS NOT NULL AND page IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(confidence, -1) DESC, CASE WHEN attempt = 3 THEN 1 ELSE -attempt END DESC) AS k FROM a)
SELECT doc_id, page, attempt::INT AS attempt, confidence FROM r WHERE k = 1
""")
def retried_readings(spark: SparkSession, sf: str) -> DataFrame:
    attempts = _pages(spark, sf).filter("doc_id is not null and page is not null").withColumn("attempt", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return reading.retry_readings(attempts.select("doc_id", "page", "attempt", F.expr("confidence - 7 * ((page_id + attempt) % 3)").alias("confidence")))


@query(f"SELECT page_id, regexp_matches(array_to_string(list_slice(string_split(coalesce(array_to_string(paragraphs, ' '), ''), ' '), 1, 80), ' '), '(?i)dziennik (ustaw|urzędowy)|monitor polski') AS old FROM {_PAGES}")
def old_gazettes(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", reading.old_gazette(F.split(F.coalesce(F.array_join("paragraphs", " "), F.lit("")), " ")).alias("old"))


@query(f"""
WITH i AS (SELECT page_id, doc_id || '|' || page AS content FROM {_PAGES} WHERE doc_id IS NOT NULL AND page IS NOT NULL), k AS (SELECT page_id, sha256(hex(content::BLOB) || chr(0) || 'read' || chr(0) || '5.3') AS cache_key FROM i)
SELECT page_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE page_id % 3 = 0)
""")
def images_to_read(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose reading is not cached yet, by content, command and version."""
    images = _pages(spark, sf).filter("doc_id is not null and page is not null").select("page_id", F.concat_ws("|", "doc_id", "page").alias("content"), F.lit("read").alias("command"), F.lit("5.3").alias("version"))
    cache = reading.to_read(images.filter("page_id % 3 = 0"), images.limit(0).withColumn("cache_key", F.lit("")))
    return reading.to_read(images, cache).select("page_id", "cache_key")


# ---- notes, markup and slices


@query(f"""
WITH n AS (SELECT *, nullif(translate(regexp_extract(text, '^\\s*([¹²³⁴⁵⁶⁷⁸⁹⁰]+⁾|[0-9]+\\)|[a-z]\\)|\\*+\\))', 1), '⁰¹²³⁴⁵⁶⁷⁸⁹⁾) ', '0123456789'), '') AS label FROM {_NOTES}), m AS (SELECT *, footnote_id % 2 = 0 AS marked FROM n WHERE label IS NOT NULL),
r AS (SELECT DISTINCT doc_id, label FROM m WHERE footnote_id % 3 = 0)
SELECT footnote_id FROM m WHERE marked OR ((doc_id, label) IN (SELECT doc_id, label FROM r) AND (doc_id, label) NOT IN (SELECT doc_id, label FROM m WHERE marked))
""")
def plain_note_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that count when every other one is marked and the labels of every third are referred to."""
    notes = b.note_labels(_notes(spark, sf)).filter("label is not null").withColumn("marked", F.col("footnote_id") % 2 == 0)
    return b.plain_labels(notes, notes.filter("footnote_id % 3 = 0").select("doc_id", "label")).select("footnote_id")


@query(f"""
WITH n AS (SELECT doc_id, list(DISTINCT CASE footnote_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS l FROM {_NOTES} WHERE doc_id IS NOT NULL GROUP BY 1),
b AS (SELECT block_id, b.text || ' [^a] [^d] [^5]' AS t, coalesce(n.l, []) AS l FROM {_BLOCKS} b LEFT JOIN n ON b.doc_id = n.doc_id WHERE b.text IS NOT NULL AND b.text NOT LIKE '%[^%')
SELECT block_id, replace(CASE WHEN list_contains(l, 'a') THEN t ELSE replace(t, '[^a]', 'a)') END, '[^d]', 'd)') AS text FROM b
""")
def letter_references(spark: SparkSession, sf: str) -> DataFrame:
    """Letter markers put behind every block: only those of notes of the act stay."""
    notes = _notes(spark, sf).filter("doc_id is not null").select("doc_id", F.expr("CASE footnote_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END").alias("label"))
    blocks = _blocks(spark, sf).filter("text is not null and text not like '%[^%'").withColumn("text", F.concat("text", F.lit(" [^a] [^d] [^5]")))
    return b.letter_references(blocks, notes).select("block_id", "text")


@query(f"""
WITH b AS (SELECT *, sum(CASE WHEN kind = 'annex' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS part FROM {_BLOCKS} WHERE doc_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL AND text NOT LIKE '%[^%'),
t AS (SELECT *, CASE WHEN seq % 9 = 4 THEN '[^' || (seq % 2 + 1) || '] ' || text WHEN seq % 9 = 5 THEN text || '[^1][^2]' ELSE text END AS x FROM b),
l AS (SELECT doc_id, part, bool_or(x LIKE '[^1]%') AS one, bool_or(x LIKE '[^2]%') AS two FROM t GROUP BY ALL)
SELECT block_id, CASE WHEN coalesce(two, false) THEN replace(CASE WHEN coalesce(one, false) THEN replace(x, '[^1]', '¹⁾') ELSE x END, '[^2]', '²⁾') WHEN coalesce(one, false) THEN replace(x, '[^1]', '¹⁾') ELSE x END AS text
FROM t LEFT JOIN l ON t.doc_id = l.doc_id AND t.part = l.part
""")
def printed_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Markers put into the blocks: those that open a block of a part are printed notes."""
    blocks = b.parts(_blocks(spark, sf).filter("doc_id is not null and seq is not null and text is not null and text not like '%[^%'"))
    text = F.expr("CASE WHEN seq % 9 = 4 THEN concat('[^', seq % 2 + 1, '] ', text) WHEN seq % 9 = 5 THEN concat(text, '[^1][^2]') ELSE text END")
    return b.printed_notes(blocks.withColumn("text", text)).select("block_id", "text")


_NOTE_LINES = f"(SELECT doc_id, page, CAST(seq AS BIGINT) AS seq, CASE WHEN seq % 4 = 0 THEN (seq // 4) % 30 + 1 || ') ' || text WHEN seq % 4 = 1 THEN text || ':' WHEN seq % 8 = 2 THEN '1) ' || text ELSE text END AS text FROM {_LINES} WHERE mark = '' AND seq IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(text, '^\\s*(\\[\\^|[¹²³⁴⁵⁶⁷⁸⁹⁰]+⁾|[0-9]+\\)|[a-z]{{1,2}}\\)|\\*+\\))'))"


@query(f"""
WITH l AS (SELECT doc_id, page, seq, trim(text) AS t FROM {_NOTE_LINES}), e AS (SELECT *, try_cast(nullif(regexp_extract(t, '^([0-9]+)\\)\\s', 1), '') AS INT) AS n, lag(t) OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
f AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, coalesce(n = 1 AND before LIKE '%:', false) AS begins FROM e),
g AS (SELECT *, coalesce(n = last + 1, false) AS nxt FROM f), h AS (SELECT *, last_value(CASE WHEN n IS NOT NULL AND (begins OR NOT nxt) THEN begins END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS root FROM g),
i AS (SELECT *, before IS NULL OR (n IS NOT NULL AND NOT (begins OR (nxt AND coalesce(root, false)))) AS opens, n IS NOT NULL AND (begins OR (nxt AND coalesce(root, false))) AS point FROM h), j AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS note FROM i)
SELECT doc_id, min(seq) AS first_seq, arg_min(page, seq) AS page, nullif(regexp_extract(arg_min(t, seq), '^([0-9]+)\\)', 1), '') AS label, string_agg(CASE WHEN opens THEN '' WHEN point THEN chr(10) ELSE ' ' END || t, '' ORDER BY seq) AS text FROM j GROUP BY doc_id, note
""")
def grouped_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with labels and lists put into them, as notes over the ends of pages."""
    rows = _lines(spark, sf).filter(r"mark = '' and seq is not null and trim(text) <> ''").filter(~F.col("text").rlike(r"^\s*(\[\^|[¹²³⁴⁵⁶⁷⁸⁹⁰]+⁾|[0-9]+\)|[a-z]{1,2}\)|\*+\))"))
    text = F.expr("CASE WHEN seq % 4 = 0 THEN concat(floor(seq / 4) % 30 + 1, ') ', text) WHEN seq % 4 = 1 THEN concat(text, ':') WHEN seq % 8 = 2 THEN concat('1) ', text) ELSE text END")
    return paragraphs.group_notes(rows.select("doc_id", "page", "seq", text.alias("text")))


@query(f"SELECT block_id, regexp_replace(regexp_replace(regexp_replace(text, '^([>#])', '\\\\\\1'), '([*_`\\[\\]])', '\\\\\\1', 'g'), '^([0-9]+)([.)]) ', '\\1\\\\\\2 ') AS text FROM {_BLOCKS} WHERE text IS NOT NULL")
def escaped_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).filter("text is not null").select("block_id", escape_markup(F.col("text"), read=True).alias("text"))


@query(f"""
WITH h AS (SELECT block_id, text, CASE WHEN block_id % 2 = 0 THEN regexp_extract(text, '^(Art\\. ?[0-9]+[0-9A-Za-z_]*[⁰¹²³⁴⁵⁶⁷⁸⁹]*\\.?)\\s*', 1) ELSE regexp_extract(text, '^(§ ?[0-9]+[0-9A-Za-z_]*[⁰¹²³⁴⁵⁶⁷⁸⁹]*\\.?)\\s*', 1) END AS head FROM {_BLOCKS} WHERE text IS NOT NULL)
SELECT block_id, CASE WHEN head = '' THEN [text] ELSE list_filter(['##### ' || head, ltrim(substr(text, length(head) + 1), ' ')], lambda x: x <> '') END AS parts FROM h
""")
def split_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Heading and rest of the blocks, with articles for heads in every other one."""
    unit = F.when(F.col("block_id") % 2 == 0, "Art.").otherwise("§")
    return _blocks(spark, sf).filter("text is not null").select("block_id", markdown.split_head(F.col("text"), unit).alias("parts"))


_RANKED = f"(SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN hash_ = 6 THEN NULL ELSE hash_ END AS rank FROM (SELECT doc_id, seq, (seq * 7 + length(coalesce(text, ''))) % 7 AS hash_ FROM {_BLOCKS} WHERE doc_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY block_id) = 1))"


@query(f"""
WITH u AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS part FROM {_RANKED})
SELECT a.doc_id, a.seq, max(p.seq) AS parent_seq FROM u a LEFT JOIN u p ON a.rank IS NOT NULL AND p.doc_id = a.doc_id AND p.part = a.part AND p.seq < a.seq AND p.rank < a.rank GROUP BY a.doc_id, a.seq
""")
def rank_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents by rank of blocks whose ranks come from their place and length."""
    rows = _blocks(spark, sf).filter("doc_id is not null and seq is not null").groupBy("doc_id", "seq").agg(F.min_by("text", "block_id").alias("text"))
    rank = (F.col("seq") * 7 + F.length(F.coalesce("text", F.lit("")))) % 7
    units = rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.when(rank != 6, rank).alias("rank"))
    return tree.parents_by_rank(units, ["doc_id"]).select("doc_id", "seq", "parent_seq")


@query("""
WITH m AS (SELECT DISTINCT eli, title FROM acts_meta WHERE title IS NOT NULL)
SELECT eli, title, trim(regexp_replace(regexp_replace(translate(upper(title), 'ĄĆĘŁŃÓŚŹŻÄÖÜÉÈÀÇ', 'ACELNOSZZAOUEEAC'), '[^\\p{L}\\p{N} ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
try_strptime(regexp_extract(lower(title), '([0-9]{1,2})\\s+(stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia)\\s+([0-9]{4})', 3) || '-' ||
list_position(['stycznia','lutego','marca','kwietnia','maja','czerwca','lipca','sierpnia','września','października','listopada','grudnia'], regexp_extract(lower(title), '([0-9]{1,2})\\s+(stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia)\\s+([0-9]{4})', 2)) || '-' ||
regexp_extract(lower(title), '([0-9]{1,2})\\s+(stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia)\\s+([0-9]{4})', 1), '%Y-%m-%d')::DATE AS day FROM m
""")
def plain_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Plain form of the titles and the date written in them."""
    titles = spark.read.parquet(f"{sf}/acts_meta.parquet").filter("title is not null").select("eli", "title").distinct()
    return titles.select("eli", "title", plain_form(F.col("title")).alias("plain"), written_date(F.col("title")).alias("day"))


@query(f"""
WITH l AS (SELECT doc_id, page, seq, CASE WHEN seq % 6 = 0 THEN 'USTAWA' WHEN seq % 6 = 1 AND seq % 4 = 1 THEN 'z dnia 5 maja 1990 r.' WHEN seq % 18 = 5 THEN 'Minister Zdrowia: J. Nowak' ELSE text END AS t FROM {_LINES} WHERE seq IS NOT NULL),
h AS (SELECT doc_id, seq, coalesce(regexp_matches(t, '^\\W{{0,3}}(USTAWA|ROZPORZĄDZENIE|OBWIESZCZENIE|UCHWAŁA|ZARZĄDZENIE|UMOWA|OŚWIADCZENIE|POSTANOWIENIE)\\b'), false) AND (coalesce(regexp_matches(lag(t) OVER w, '^\\s*(Minister|Prezes|Marszałek|Przewodniczący|Prezydent|Wojewoda)[^:]{{0,80}}:'), false) OR coalesce(regexp_matches(lead(t) OVER w, '^\\W{{0,3}}z dnia [0-9]{{1,2}}'), false)) AS head
FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)), s AS (SELECT doc_id, min(seq) AS seq FROM {_LINES} WHERE seq % 10 = 3 GROUP BY 1)
SELECT h.doc_id, min(h.seq) AS stop_seq FROM h JOIN s ON h.doc_id = s.doc_id AND h.seq > s.seq WHERE head GROUP BY 1
""")
def act_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of acts in lines with headers, dates and signatures put into them."""
    lines = _lines(spark, sf).filter("seq is not null")
    text = F.expr("CASE WHEN seq % 6 = 0 THEN 'USTAWA' WHEN seq % 6 = 1 AND seq % 4 = 1 THEN 'z dnia 5 maja 1990 r.' WHEN seq % 18 = 5 THEN 'Minister Zdrowia: J. Nowak' ELSE text END")
    starts = lines.filter("seq % 10 = 3").groupBy("doc_id").agg(F.min("seq").alias("seq"))
    return slicing.act_end(lines.withColumn("text", text), starts)


@query(f"""
WITH t AS (SELECT line_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT line_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM {_LINES} WHERE text IS NOT NULL)),
d AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9]+$') AND coalesce(regexp_matches(lag(token) OVER (PARTITION BY line_id ORDER BY pos), '^[0-9]+$'), false) THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY pos) AS g FROM d)
SELECT line_id, (min(pos) - 1)::INT AS pos, string_agg(token, '' ORDER BY pos) AS token FROM g GROUP BY line_id, g
""")
def joined_numbers(spark: SparkSession, sf: str) -> DataFrame:
    from folioflow.functions.text import tokens

    rows = _lines(spark, sf).filter("text is not null").select("line_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return alignment.join_numbers(rows, ["line_id"])


@query(f"SELECT footnote_id, regexp_extract_all(lower(translate(regexp_replace(regexp_replace(text, '\\[\\^[^\\]]*\\]', '', 'g'), '([⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]+)', ' \\1 ', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉', '01234567890123456789')), '[\\p{{L}}\\p{{N}}_]+') AS tokens FROM {_NOTES} WHERE text IS NOT NULL")
def evaluation_tokens_of_notes(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).filter("text is not null").select("footnote_id", evaluation_tokens(F.col("text")).alias("tokens"))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT act_year % 399 + 1 AS n FROM acts_meta WHERE act_year IS NOT NULL),
s AS (SELECT n, n AS rest, '' AS r FROM n UNION ALL SELECT n, rest - v, r || t FROM (SELECT s.n, s.rest, s.r, x.v, x.t, row_number() OVER (PARTITION BY s.n, s.rest, s.r ORDER BY x.v DESC) AS k
FROM s JOIN (VALUES (100, 'C'), (90, 'XC'), (50, 'L'), (40, 'XL'), (10, 'X'), (9, 'IX'), (5, 'V'), (4, 'IV'), (1, 'I')) x(v, t) ON x.v <= s.rest) WHERE k = 1)
SELECT r AS numeral, n::INT AS value FROM s WHERE rest = 0
""")
def roman_numerals(spark: SparkSession, sf: str) -> DataFrame:
    """Roman numerals of numbers, built digit by digit, and the values that are read from them."""
    n = spark.read.parquet(f"{sf}/acts_meta.parquet").filter("act_year is not null").select((F.col("act_year") % 399 + 1).alias("n")).distinct()
    digit = lambda d, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d + 1).cast("int"))
    numeral = F.concat(F.repeat(F.lit("C"), F.floor(F.col("n") / 100).cast("int")), digit(F.floor(F.col("n") / 10) % 10, "X", "L", "C"), digit(F.col("n") % 10, "I", "V", "X"))
    return n.select(numeral.alias("numeral")).select("numeral", roman_value(F.col("numeral")).alias("value"))


@query(f"""
WITH x AS (SELECT block_id, text AS a, CASE block_id % 7 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN upper(text) WHEN 3 THEN replace(text, '.', ',') WHEN 4 THEN replace(text, 'ż', 'z') WHEN 5 THEN replace(text, '1', '2') ELSE text || 'x' END AS b FROM {_BLOCKS} WHERE text IS NOT NULL),
p AS (SELECT *, regexp_replace(a, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS ba, regexp_replace(b, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS bb, trim(regexp_replace(regexp_replace(translate(upper(a), 'ĄĆĘŁŃÓŚŹŻÄÖÜÉÈÀÇ', 'ACELNOSZZAOUEEAC'), '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS pa,
trim(regexp_replace(regexp_replace(translate(upper(b), 'ĄĆĘŁŃÓŚŹŻÄÖÜÉÈÀÇ', 'ACELNOSZZAOUEEAC'), '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS pb FROM x)
SELECT block_id, CASE WHEN a = b THEN 'same' WHEN regexp_replace(a, '\\s+', '', 'g') = regexp_replace(b, '\\s+', '', 'g') THEN 'blank' WHEN lower(a) = lower(b) THEN 'case' WHEN regexp_replace(a, '[-­]\\s*', '', 'g') = regexp_replace(b, '[-­]\\s*', '', 'g') THEN 'hyphen' WHEN ba = bb THEN 'punctuation' WHEN pa = pb THEN 'accents'
WHEN regexp_replace(a, '[0-9]+', '#', 'g') = regexp_replace(b, '[0-9]+', '#', 'g') THEN 'number' WHEN length(a) <= 3 AND length(b) <= 3 THEN 'short' ELSE 'other' END AS class FROM p
""")
def difference_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of the differences between blocks and changed copies of them."""
    changed = F.expr("CASE block_id % 7 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN upper(text) WHEN 3 THEN replace(text, '.', ',') WHEN 4 THEN replace(text, 'ż', 'z') WHEN 5 THEN replace(text, '1', '2') ELSE concat(text, 'x') END")
    return _blocks(spark, sf).filter("text is not null").select("block_id", alignment.triage(F.col("text"), changed).alias("class"))
