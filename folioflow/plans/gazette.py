"""Queries over the gazette's tables: catalog, lines, blocks, notes, readings of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import previous, table
from folioflow.functions.text import SMALL, clean_title, masked
from folioflow.operators import blocks as b
from folioflow.operators import catalog, layout, measures, paragraphs, sampling
from folioflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_LINES = "(SELECT DISTINCT line_id, doc_id, seq, page, y_top, y_bottom, x0, x1, font_size, text, pw, ph, mark, band, col, act FROM act_lines)"
_BLOCKS = "(SELECT DISTINCT * FROM act_blocks)"
_NOTES = "(SELECT DISTINCT * FROM act_footnotes)"
_PAGES = "(SELECT DISTINCT page_id, doc_id, page, paragraphs, words, confidence, lang, width, line_widths, line_chars FROM ocr_pages)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.once(table(spark, sf, "act_lines"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return b.once(table(spark, sf, "act_blocks"))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "act_footnotes").dropDuplicates(["footnote_id"])


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ocr_pages").dropDuplicates(["page_id"])


# ---- catalog


@query("SELECT DISTINCT eli, rtrim(string_split(title, chr(9))[1]) AS title FROM acts_meta")
def title_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "acts_meta").select("eli", clean_title(F.col("title")).alias("title")).distinct()


@query("SELECT eli, log_id, status, converter FROM index_log QUALIFY row_number() OVER (PARTITION BY eli ORDER BY log_id DESC) = 1")
def catalog_read(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.last_rows(table(spark, sf, "index_log").select("eli", "log_id", "status", "converter"), "eli", "log_id")


_NEWEST = "(SELECT eli, act_year, pos, title, change_date, text_pdf, text_html FROM acts_meta QUALIFY row_number() OVER (PARTITION BY eli ORDER BY received_at DESC, change_date DESC NULLS LAST, title DESC NULLS LAST) = 1)"
_LAST = "(SELECT * FROM index_log QUALIFY row_number() OVER (PARTITION BY eli ORDER BY log_id DESC) = 1)"


def _newest(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "acts_meta").select("eli", "act_year", "pos", "title", "change_date", "text_pdf", "text_html", "received_at")
    order = F.struct("received_at", F.coalesce("change_date", F.lit("")), F.coalesce("title", F.lit("")))
    return meta.groupBy("eli").agg(F.max_by(F.struct("act_year", "pos", "title", "change_date", "text_pdf", "text_html"), order).alias("x")).select("eli", "x.*")


@query(f"""
SELECT m.eli, CASE WHEN c.eli IS NULL THEN 'new' WHEN m.change_date IS DISTINCT FROM c.change_date THEN 'changed' WHEN lower(trim(coalesce(c.status, ''))) <> 'ok' THEN 'failed'
WHEN (c.no_text_pages > 0 AND c.ocr_pages IS NULL) OR (c.image_pages > 0 AND c.image_ocr_pages IS NULL) THEN 'images' END AS reason
FROM {_NEWEST} m LEFT JOIN {_LAST} c ON m.eli = c.eli WHERE coalesce(m.text_pdf, false) AND NOT coalesce(m.text_html, false)
""")
def refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The reference rule: change dates compared as written, unlike in p2_found."""
    log = table(spark, sf, "index_log")
    last = catalog.last_rows(log.select("eli", "log_id", "change_date", "status", "no_text_pages", "ocr_pages", "image_pages", "image_ocr_pages"), "eli", "log_id")
    return catalog.refresh_reasons(_newest(spark, sf), last)


@query("""
WITH b AS (SELECT (min(log_id) + max(log_id)) // 2 AS mid FROM index_log),
o AS (SELECT eli, log_id, status FROM index_log, b WHERE log_id <= mid QUALIFY row_number() OVER (PARTITION BY eli ORDER BY log_id DESC) = 1),
n AS (SELECT eli, log_id, status FROM index_log, b WHERE log_id > mid QUALIFY row_number() OVER (PARTITION BY eli ORDER BY log_id DESC) = 1)
SELECT coalesce(n.eli, o.eli) AS eli, CASE WHEN n.eli IS NULL THEN o.log_id ELSE n.log_id END AS log_id, CASE WHEN n.eli IS NULL THEN o.status ELSE n.status END AS status FROM o FULL JOIN n ON o.eli = n.eli
""")
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "index_log").select("eli", "log_id", "status")
    middle = log.agg(F.floor((F.min("log_id") + F.max("log_id")) / 2).alias("mid")).first().mid or 0
    old, new = (catalog.last_rows(log.filter(c), "eli", "log_id") for c in (F.col("log_id") <= middle, F.col("log_id") > middle))
    return catalog.upsert(old, new)


@query("SELECT DISTINCT eli, change_date FROM acts_meta m WHERE NOT EXISTS (SELECT 1 FROM index_log l WHERE l.eli = m.eli AND l.change_date IS NOT DISTINCT FROM m.change_date)")
def to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.to_fetch(table(spark, sf, "acts_meta").select("eli", "change_date").distinct(), table(spark, sf, "index_log"))


_ACTS = "(SELECT eli, publisher, act_year, pos, min(title) AS title FROM acts_meta WHERE title IS NOT NULL AND pos IS NOT NULL GROUP BY ALL)"


@query(f"""
SELECT a.eli, coalesce(string_agg(n.title, ' | ' ORDER BY n.pos, n.eli), '') AS titles FROM {_ACTS} a
LEFT JOIN {_ACTS} n ON n.publisher = a.publisher AND n.act_year = a.act_year AND n.pos BETWEEN a.pos - 3 AND a.pos + 3 AND n.eli <> a.eli GROUP BY a.eli
""")
def neighbour_titles(spark: SparkSession, sf: str) -> DataFrame:
    acts = table(spark, sf, "acts_meta").filter("title is not null and pos is not null").groupBy("eli", "publisher", "act_year", "pos").agg(F.min("title").alias("title"))
    return catalog.neighbour_titles(acts).select("eli", F.array_join("titles", " | ").alias("titles"))


@query("""
WITH e AS (SELECT eli, received_at, min(title) AS title FROM acts_meta WHERE received_at < TIMESTAMP '2025-09-01' GROUP BY ALL)
SELECT eli, max(received_at) AS received_at, max_by(title, received_at) AS title FROM e GROUP BY eli
""")
def newest_before(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.lit("2025-09-01").cast("timestamp_ntz")
    return catalog.newest_before(table(spark, sf, "acts_meta"), "eli", "received_at", limit, "title")


@query("""
WITH o AS (SELECT eli, min_by(title, received_at) AS t FROM (SELECT eli, received_at, min(title) AS title FROM acts_meta GROUP BY ALL) GROUP BY 1),
n AS (SELECT eli, min_by(title, log_id) AS t FROM index_log GROUP BY 1)
SELECT coalesce(o.eli, n.eli) AS eli, CASE WHEN o.eli IS NULL THEN 'added' WHEN n.eli IS NULL THEN 'removed' WHEN o.t IS NOT DISTINCT FROM n.t THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.eli = n.eli
""")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the year lists against those of the index."""
    first = table(spark, sf, "acts_meta").groupBy("eli", "received_at").agg(F.min("title").alias("title"))
    old = first.groupBy("eli").agg(F.min_by("title", "received_at").alias("title"))
    new = table(spark, sf, "index_log").groupBy("eli").agg(F.min_by("title", "log_id").alias("title"))
    return catalog.version_diff(old, new, "eli", "title")


@query("""
WITH a AS (SELECT DISTINCT eli, act_year, coalesce(text_pdf, false) AS p, coalesce(text_html, false) AS h FROM acts_meta),
x AS (SELECT eli, act_year, bool_or(p) AS p, bool_or(h) AS h FROM a GROUP BY ALL)
SELECT act_year, count(*) AS total, count(*) FILTER (WHERE h) AS with_html, count(*) FILTER (WHERE p AND NOT h) AS pdf_only, count(*) FILTER (WHERE NOT p AND NOT h) AS neither FROM x GROUP BY ROLLUP (act_year)
""")
def coverage_survey(spark: SparkSession, sf: str) -> DataFrame:
    """Acts by year and in all, by the forms of text they have."""
    flags = table(spark, sf, "acts_meta").groupBy("eli", "act_year").agg(
        F.bool_or(F.coalesce("text_pdf", F.lit(False))).alias("p"), F.bool_or(F.coalesce("text_html", F.lit(False))).alias("h")
    )
    return flags.rollup("act_year").agg(
        F.count("*").alias("total"), F.count_if("h").alias("with_html"), F.count_if(F.expr("p and not h")).alias("pdf_only"), F.count_if(F.expr("not p and not h")).alias("neither")
    )


# ---- token bags of lines against blocks

_BAG = f"""
WITH r AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM {_LINES} WHERE mark = ''), h AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM {_BLOCKS}),
rc AS (SELECT doc_id, token, count(*) AS a FROM r GROUP BY ALL), hc AS (SELECT doc_id, token, count(*) AS b FROM h GROUP BY ALL),
j AS (SELECT coalesce(rc.doc_id, hc.doc_id) AS doc_id, coalesce(rc.token, hc.token) AS token, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM rc FULL JOIN hc ON rc.doc_id = hc.doc_id AND rc.token = hc.token),
s AS (SELECT doc_id, sum(a)::BIGINT AS ref, sum(b)::BIGINT AS hyp, sum(least(a, b))::BIGINT AS common FROM j GROUP BY 1),
o AS (SELECT doc_id, ref, hyp, common, round(common / greatest(ref, 1), 6) AS kept, round(common / greatest(hyp, 1), 6) AS grounded FROM s)
"""


def _bags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return measures.token_bag(_lines(spark, sf).filter("mark = ''"), "doc_id"), measures.token_bag(_blocks(spark, sf), "doc_id")


@query(_BAG + "SELECT * FROM o")
def bag_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return measures.bag_overlap(*_bags(spark, sf), "doc_id")


@query(f"WITH x AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM {_LINES} WHERE mark = '' EXCEPT ALL SELECT doc_id, unnest({_TOKENS}) FROM {_BLOCKS}) SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL")
def lost_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return measures.lost(*_bags(spark, sf), "doc_id")


@query(f"WITH x AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM {_LINES} WHERE mark = '' INTERSECT ALL SELECT doc_id, unnest({_TOKENS}) FROM {_BLOCKS}) SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL")
def common_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return measures.common(*_bags(spark, sf), "doc_id")


@query(_BAG + """
SELECT publisher, count(*) AS items, sum(ref)::BIGINT AS ref, sum(hyp)::BIGINT AS hyp, sum(common)::BIGINT AS common, round(avg(kept), 6) AS macro_kept, count(*) FILTER (WHERE kept < 0.95) AS below,
round(sum(common) / greatest(sum(ref), 1), 6) AS micro_kept, round(sum(common) / greatest(sum(hyp), 1), 6) AS micro_grounded FROM (SELECT *, substr(doc_id, 1, 2) AS publisher FROM o) GROUP BY GROUPING SETS ((publisher), ())
""")
def micro_macro(spark: SparkSession, sf: str) -> DataFrame:
    scores = measures.bag_overlap(*_bags(spark, sf), "doc_id").withColumn("publisher", F.substring("doc_id", 1, 2))
    return measures.totals(scores, ["publisher"])


# ---- lines


@query(f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM {_LINES})
SELECT line, count(DISTINCT doc_id) AS acts, count(*) AS n FROM t WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
""")
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    per_act = _lines(spark, sf).select("doc_id", masked(F.col("text")).alias("line")).filter("line <> ''").groupBy("line", "doc_id").agg(F.count("*").alias("k"))
    return per_act.groupBy("line").agg(F.count("*").alias("acts"), F.sum("k").alias("n")).filter("acts >= 3")


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq, line_id) AS k, lead(line_id) OVER (PARTITION BY doc_id, page ORDER BY seq, line_id) AS after FROM {_LINES})
SELECT line_id, doc_id, page, text, after FROM l WHERE k = 1 AND page > 1 AND regexp_matches(text, '^\\s*[–—-]\\s*[0-9]{{1,4}}\\s*[–—-]\\s*$') AND (coalesce(y_bottom, 0) = 0 OR ph IS NULL OR y_top < 0.08 * ph)
""")
def bare_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return layout.bare_numbers(_lines(spark, sf))


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq, line_id) AS k FROM {_LINES}),
m AS (SELECT *, min(CASE WHEN regexp_matches(text, '^\\s*Poz\\. ?[0-9]+\\s*$') THEN k END) OVER (PARTITION BY doc_id, page) AS p FROM l)
SELECT line_id, CASE WHEN page = 1 AND k <= p THEN 'masthead' ELSE 'header' END AS role FROM m
WHERE (page = 1 AND k <= p) OR (k = 1 AND regexp_matches(text, '(?i)^([0-9]+ )?(dziennik urz|biuletyn obw|monitor)|^nr\\.? [0-9]+ .*poz\\. ?[0-9]+'))
""")
def header_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.header_lines(_lines(spark, sf)).select("line_id", "role")


@query(f"""
SELECT doc_id, page, coalesce(bool_or((coalesce(y_bottom, 0) = 0 OR y_top < 0.2 * coalesce(ph, 842)) AND regexp_matches(text, '(?i)^([0-9]+ )?(dziennik urz|biuletyn obw|monitor)|^nr\\.? [0-9]+ .*poz\\. ?[0-9]+')), false) AS old FROM {_LINES} GROUP BY ALL
""")
def old_issue(spark: SparkSession, sf: str) -> DataFrame:
    return layout.old_issue(_lines(spark, sf))


_BODY = f"(SELECT doc_id, page, font_size AS body FROM (SELECT doc_id, page, font_size, sum(length(text)) AS w FROM {_LINES} WHERE font_size IS NOT NULL GROUP BY ALL) WHERE w >= 1 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY w DESC, font_size) = 1)"


@query(f"SELECT * FROM {_BODY}")
def body_size(spark: SparkSession, sf: str) -> DataFrame:
    return layout.body_size(_lines(spark, sf))


@query(f"SELECT line_id FROM {_LINES} l JOIN {_BODY} b USING (doc_id, page) WHERE font_size < body - 0.5 AND y_top > 0.6 * coalesce(ph, 842)")
def note_zone(spark: SparkSession, sf: str) -> DataFrame:
    return layout.note_zone(_lines(spark, sf)).select("line_id")


@query(f"SELECT line_id, text FROM {_LINES} WHERE regexp_matches(text, '^\\s*[0-9]{{1,4}}\\s*$') AND font_size >= 11.5 AND abs((x0 + x1) / 2 - pw / 2) <= 10")
def act_number_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.act_numbers(_lines(spark, sf)).select("line_id", "text")


@query(f"""
WITH l AS {_LINES}, e AS (SELECT doc_id, page, band, col, round(x1) AS v, count(*) AS n FROM l WHERE length(text) >= 40 AND x1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
e1 AS (SELECT doc_id, page, band, col, v AS right_edge FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, page, band, col ORDER BY n DESC, v) = 1),
g AS (SELECT doc_id, page, band, col, round(y_top - lag(y_bottom) OVER (PARTITION BY doc_id, page, band, col ORDER BY y_top, seq, line_id), 1) AS v FROM l WHERE y_bottom > 0),
g1 AS (SELECT doc_id, page, band, col, v, count(*) AS n FROM g WHERE v > 0 GROUP BY ALL HAVING count(*) >= 3),
g2 AS (SELECT doc_id, page, band, col, v AS line_lead FROM g1 QUALIFY row_number() OVER (PARTITION BY doc_id, page, band, col ORDER BY n DESC, v) = 1)
SELECT * FROM e1 FULL JOIN g2 USING (doc_id, page, band, col)
""")
def usual_edges(spark: SparkSession, sf: str) -> DataFrame:
    return layout.usual_edges(_lines(spark, sf))


@query(f"""
SELECT doc_id, page, CASE WHEN count(text) = 0 THEN 'empty' WHEN sum(CASE WHEN mark = '' THEN length(text) ELSE 0 END) >= 100 THEN 'text' WHEN bool_or(mark = 'scan') THEN 'scan' WHEN bool_or(mark = 'ocr') THEN 'ocr'
WHEN sum(CASE WHEN mark = '' THEN length(text) ELSE 0 END) < 20 THEN 'sparse' ELSE 'text' END AS kind FROM {_LINES} GROUP BY ALL
""")
def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_kinds(_lines(spark, sf))


_RANGES = """
WITH p AS (SELECT DISTINCT doc_id, page FROM act_lines WHERE mark <> '' AND page IS NOT NULL), g AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p),
r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, g)
"""


@query(_RANGES + "SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_ranges(table(spark, sf, "act_lines").filter("mark <> ''"))


@query("SELECT DISTINCT doc_id, page FROM act_lines WHERE mark <> '' AND page IS NOT NULL")
def expand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return layout.expand_ranges(page_ranges(spark, sf))


@query(f"""
WITH n AS (SELECT doc_id, seq, act, sum(CASE WHEN act > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, line_id ROWS UNBOUNDED PRECEDING) AS slice FROM {_LINES})
SELECT doc_id, slice::BIGINT AS slice, max(CASE WHEN act > 0 THEN act END) AS act, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS lines FROM n GROUP BY ALL
""")
def act_slices(spark: SparkSession, sf: str) -> DataFrame:
    return layout.act_slices(_lines(spark, sf))


@query(f"""
WITH l AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY seq, line_id) AS n FROM {_LINES})
SELECT line_id, CASE WHEN n IS NULL THEN text ELSE replace(regexp_replace(regexp_replace(text || chr(10) || n, '([a-ząćęłńóśźżäöüß])-\\n-([a-ząćęłńóśźżäöüß])', '\\1-\\2', 'g'), '([a-ząćęłńóśźżäöüß])-\\n([a-ząćęłńóśźżäöüß])', '\\1\\2', 'g'), chr(10), ' ') END AS joined FROM l
""")
def joined_lines(spark: SparkSession, sf: str) -> DataFrame:
    return b.joined_next(_lines(spark, sf))


@query(f"""
WITH l AS (SELECT *, round((y_top - lag(y_bottom) OVER (PARTITION BY doc_id, page ORDER BY seq, line_id)) / font_size, 4) AS gap FROM {_LINES} WHERE y_bottom > 0 AND font_size > 0),
v AS (SELECT doc_id, page, list_sort(list(gap)) AS v FROM l WHERE gap IS NOT NULL AND NOT regexp_matches(text, '^\\s*(§ ?[0-9]+|Art\\. ?[0-9]+|[0-9]+[a-z]?\\.|[0-9]+[a-z]?\\)|[a-z]{{1,2}}\\)|[–—-] )') GROUP BY ALL HAVING count(*) >= 5)
SELECT doc_id, page, v[len(v) // 4 + 1] AS q1 FROM v
""")
def continuation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return b.continuation_gaps(_lines(spark, sf))


def _segment_sql() -> str:
    """The rules of paragraphs.segment as SQL over whole acts."""
    p = paragraphs
    rx = lambda text, pattern: f"regexp_matches({text}, '{pattern}')"

    def kind(after: str) -> str:
        right = lambda share: f"(NOT (coalesce(x0, 0) > 0) OR coalesce(x0 > {share} * w, false))"
        annex, sign = rx("t", p.ANNEX_LABEL), rx("t", p.SIGNATURE_LABEL)
        top = f"(NOT (coalesce(x0, 0) > 0) OR coalesce(y_top, 0) < {p.TOP} * coalesce(ph, 842))"
        flush = f"(coalesce(x0 > {p.INSET} * w, false) AND coalesce(x1 > (CASE WHEN right_edge > 0 THEN right_edge ELSE 0.9 * w END) - 0.01 * w, false))"
        return f"""CASE WHEN mark <> '' AND {annex} AND nw <= {p.ANNEX_WORDS} THEN 'annex' WHEN mark <> '' AND {sign} AND nw <= {p.SIGNATURE_WORDS} THEN 'signature' WHEN mark <> '' THEN mark
WHEN {annex} AND {right(p.ANNEX_RIGHT)} AND ({top} OR {after}) THEN 'annex' WHEN {annex} AND {after} AND coalesce(old_issue, false) THEN 'annex'
WHEN {sign} AND ({right(p.RIGHT)} OR {flush} OR {after}) THEN 'signature' ELSE 'p' END"""

    reach = p.REACH * 1024
    past = "(PARTITION BY doc ORDER BY place, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = lambda v: f"(last_value(CASE WHEN ({v}) IS NOT NULL THEN {{'v': {v}, 'p': place}} END IGNORE NULLS) OVER {past})"
    near = lambda x: f"CASE WHEN place - {x}.p <= {reach} THEN {x}.v END"
    gap = "(CASE WHEN y_bottom > 0 AND b.y_bottom > 0 THEN y_top - b.y_bottom END)"
    size = "coalesce(font_size, 10)"
    rank = lambda x: f"coalesce(try_cast(nullif({x}, '') AS INT), CASE WHEN {x} <> '' THEN ascii({x}) + 1000 END)"
    mine, last = (f"regexp_extract({t}, '{p.POINT_LABEL}', 1)" for t in ("t", "b.t"))
    return f"""
WITH g0 AS (SELECT *, round((y_top - lag(y_bottom) OVER (PARTITION BY doc_id, page ORDER BY seq, line_id)) / font_size, 4) AS gap FROM {_LINES} WHERE y_bottom > 0 AND font_size > 0),
g1 AS (SELECT doc_id, page, list_sort(list(gap)) AS v FROM g0 WHERE gap IS NOT NULL AND NOT {rx("text", b.UNIT)} GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT doc_id, page, v[len(v) // 4 + 1] AS q1 FROM g1),
l AS (SELECT DISTINCT line_id, doc_id, seq, page, band, col, x0, x1, y_top, y_bottom, font_size, right_edge, line_lead, pw, ph, old_issue, coalesce(mark, '') AS mark, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM act_lines),
r AS (SELECT l.*, q1, coalesce('=' || l.doc_id, '') AS doc, CASE WHEN pw > 0 THEN pw ELSE 595 END AS w, len(regexp_split_to_array(t, '\\s+')) AS nw,
  CASE WHEN seq IS NULL THEN coalesce(line_id, 0)::HUGEINT * 1024 - 4611686018427387904 ELSE seq::HUGEINT * 1024 + coalesce(line_id, 0) % 1024 END AS place FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.page = l.page WHERE t <> ''),
k AS (SELECT *, {kind("false")} AS k0, {kind("true")} AS k1 FROM r),
s AS (SELECT *, {before("CASE WHEN NOT (k0 <> 'signature' AND k1 = 'signature') THEN k0 = 'signature' END")} AS s0,
  {before("{'page': page, 'band': band, 'col': col, 'x0': x0, 'x1': x1, 'y_bottom': y_bottom, 'font_size': font_size, 'right_edge': right_edge, 'line_lead': line_lead, 't': t}")} AS b0 FROM k),
n AS (SELECT *, {near("s0")} AS signed, {near("b0")} AS b FROM s),
m AS (SELECT *, CASE WHEN signed THEN k1 ELSE k0 END AS kind FROM n),
a AS (SELECT *, coalesce(kind = 'p' AND page IS NOT DISTINCT FROM b.page AND b IS NOT NULL AND x0 > {p.ANNEX_RIGHT} * pw AND y_top - b.y_bottom < {p.ANNEX_GAP} * font_size, false) AS below FROM m),
c AS (SELECT *, {before("CASE WHEN NOT below THEN kind = 'annex' END")} AS c0, {before("kind")} AS l0 FROM a),
d AS (SELECT *, coalesce({near("c0")}, false) AS annexed, {near("l0")} AS last_kind FROM c),
e AS (SELECT *, annexed AND (below OR kind = 'annex') AS in_annex, page IS NOT DISTINCT FROM b.page AS same_page, band IS NOT DISTINCT FROM b.band AND col IS NOT DISTINCT FROM b.col AS same_column, {gap} AS gap,
  greatest({p.GAP}, coalesce(q1, 0) + {p.BEYOND}) AS lim, coalesce(b.x1 > 0 AND b.x1 < b.right_edge - {p.SHORT} * coalesce(b.font_size, 10), false) AS short,
  {rx("b.t", "[.:;”]$")} AS ended, {rx("b.t", "[.:;,”]$")} AS closed, {rx("b.t", p.LEFT_OUT)} AS left_out, {rx("t", p.UNIT_LABEL)} AS unit, {rx("t", p.ITEM_LABEL)} AS item,
  {mine} AS mine, coalesce({rank(mine)} = {rank(last)} + 1 AND abs(x0 - b.x0) < 1, false) AS follows FROM d),
f AS (SELECT *, mine <> '' AND (short OR follows) AND coalesce(gap >= 0, false) AND coalesce(abs(font_size - b.font_size) < 0.5, false) AND right(b.t, 1) <> '-' AS point, coalesce(b.line_lead >= 0 AND gap > b.line_lead + {p.LEAD}, false) AS lead FROM e),
o AS (SELECT *, CASE WHEN b IS NULL THEN true WHEN kind = 'annex' THEN NOT (in_annex AND same_page AND coalesce(gap < {p.ANNEX_GAP} * {size}, true)) WHEN kind <> 'p' THEN true WHEN in_annex THEN false WHEN annexed OR last_kind <> 'p' THEN true
  WHEN same_page AND same_column THEN NOT coalesce(gap < lim * {size}, true) OR (lim > {p.GAP} AND short) OR (unit AND (lead OR (short AND closed) OR point OR left_out OR (gap IS NULL AND ended) OR (lim > {p.GAP} AND (item OR closed))))
  ELSE unit OR ended OR left_out END AS plain FROM f),
i AS (SELECT doc, place, line_id, doc_id, kind, page, t, kind = 'p' AND {rx("t", p.ARTICLE_LABEL)} AND NOT plain AS article, {rx("t", p.HEADING_LABEL)} AS heading,
  coalesce({rx("b.t", SMALL + "-$")} AND {rx("t", "^" + SMALL)}, false) AS glued, sum(plain::INT) OVER (PARTITION BY doc ORDER BY place, line_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
j AS (SELECT *, row_number() OVER x AS k, first_value(heading) OVER x AS headed FROM i WINDOW x AS (PARTITION BY doc, run ORDER BY place, line_id)),
q AS (SELECT *, min(CASE WHEN article THEN k END) OVER (PARTITION BY doc, run) AS cut FROM j)
SELECT min_by(doc_id, k) AS doc_id, min_by(line_id, k) AS first_line, min_by(kind, k) AS kind, min_by(page, k) AS page, count(*)::INT AS lines,
  regexp_replace(replace(string_agg(CASE WHEN glued THEN chr(1) ELSE ' ' END || t, '' ORDER BY k), '-' || chr(1), ''), '^[ \\x01]', '') AS text
FROM q GROUP BY doc, run, CASE WHEN headed AND cut > 1 AND k >= cut THEN 1 ELSE 0 END
"""


@query(_segment_sql())
def segment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of all lines."""
    return b.segment(table(spark, sf, "act_lines"))


# ---- blocks and notes


@query(f"""
WITH n AS (SELECT *, sum(CASE WHEN kind = 'annex' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS part FROM {_BLOCKS})
SELECT doc_id, part::BIGINT AS part, count(*) AS blocks, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM n GROUP BY ALL
""")
def block_parts(spark: SparkSession, sf: str) -> DataFrame:
    return b.parts(_blocks(spark, sf)).groupBy("doc_id", "part").agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query(f"""
WITH p AS (SELECT *, regexp_extract(text, '^\\s*([0-9]+|[a-z])\\)', 1) AS label FROM {_BLOCKS}),
l AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY seq, block_id) AS before FROM p WHERE label <> '')
SELECT doc_id, block_id, label, coalesce(try_cast(label AS INT) = try_cast(before AS INT) + 1 OR (length(label) = 1 AND length(before) = 1 AND NOT regexp_matches(label, '[0-9]') AND ord(label) = ord(before) + 1), false) AS follows FROM l
""")
def point_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return b.point_sequence(_blocks(spark, sf))


@query(f"""
WITH m AS (SELECT *, max(CASE WHEN kind = 'signature' THEN seq END) OVER (PARTITION BY doc_id) AS s FROM {_BLOCKS})
SELECT block_id, CASE WHEN kind = 'annex' AND seq < s THEN 'p' ELSE kind END AS kind FROM m
""")
def quoted_annexes(spark: SparkSession, sf: str) -> DataFrame:
    return b.demote_quoted_annex(_blocks(spark, sf)).select("block_id", "kind")


_LABELS = "(SELECT *, nullif(translate(regexp_extract(text, '^\\s*([¹²³⁴⁵⁶⁷⁸⁹⁰]+⁾|[0-9]+\\)|[a-z]\\)|\\*+\\))', 1), '⁰¹²³⁴⁵⁶⁷⁸⁹⁾) ', '0123456789'), '') AS label FROM " + _NOTES + ")"


@query(f"SELECT footnote_id, CASE WHEN k > 1 THEN label || '_' || k ELSE label END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY seq, footnote_id) AS k FROM {_LABELS} WHERE label IS NOT NULL)")
def note_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return b.number_labels(b.note_labels(_notes(spark, sf))).select("footnote_id", "unique_label")


@query(f"SELECT doc_id, label, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages FROM {_LABELS} WHERE label IS NOT NULL GROUP BY ALL")
def note_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = b.note_pages(b.note_labels(_notes(spark, sf)))
    return found.select("doc_id", "label", F.nullif(F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), ","), F.lit("")).alias("pages"))


@query(f"""
WITH r AS (SELECT DISTINCT doc_id, page FROM {_BLOCKS} WHERE regexp_matches(text, '\\[\\^[^\\]]+\\]')), n AS (SELECT DISTINCT doc_id, page FROM {_NOTES} WHERE page IS NOT NULL)
SELECT r.doc_id, r.page, coalesce((SELECT min(page) FROM n WHERE n.doc_id = r.doc_id AND n.page >= r.page), (SELECT max(page) FROM n WHERE n.doc_id = r.doc_id)) AS note_page FROM r
""")
def note_references(spark: SparkSession, sf: str) -> DataFrame:
    return b.resolve_pages(b.references(_blocks(spark, sf)), _notes(spark, sf))


@query(f"""
WITH u AS (SELECT doc_id, seq, line_id, CAST(regexp_extract(text, '^§ ?([0-9]+)', 1) AS INT) AS num FROM {_LINES} WHERE regexp_matches(text, '^§ ?[0-9]+')),
l AS (SELECT *, lag(num) OVER (PARTITION BY doc_id ORDER BY seq, line_id) AS before FROM u) SELECT doc_id, line_id, num, before FROM l WHERE num <= before
""")
def falling_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Sections whose number does not rise."""
    nums = _lines(spark, sf).filter(F.col("text").rlike(r"^§ ?[0-9]+")).withColumn("num", F.regexp_extract("text", r"^§ ?([0-9]+)", 1).cast("int"))
    return previous(nums, ["doc_id"], ["seq", "line_id"], "num", "before").filter("num <= before").select("doc_id", "line_id", "num", "before")


@query("SELECT kind, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, list_sort(list(length(text)))[count(*) // 4 + 1] AS q1, median(length(text)) AS median, list_sort(list(length(text)))[3 * count(*) // 4 + 1] AS q3 FROM " + _BLOCKS + " WHERE text IS NOT NULL GROUP BY 1")
def block_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return measures.quantiles(_blocks(spark, sf), "kind", F.length("text").cast("long"))


# ---- readings of pages


@query("SELECT floor(confidence / 10) * 10 AS decile, count(*) AS pages, sum(words)::BIGINT AS words FROM " + _PAGES + " WHERE confidence IS NOT NULL GROUP BY 1")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).filter("confidence is not null")
    return pages.groupBy((F.floor(F.col("confidence") / 10) * 10).cast("double").alias("decile")).agg(F.count("*").alias("pages"), F.sum("words").alias("words"))


@query("SELECT lang, round(sum(confidence * words) / nullif(sum(words), 0), 6) AS share, count(*) AS rows FROM " + _PAGES + " WHERE confidence IS NOT NULL AND words IS NOT NULL GROUP BY 1")
def weighted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return measures.weighted_share(_pages(spark, sf), "lang", F.col("confidence"), F.col("words"))


@query("SELECT page_id, coalesce(words >= 20 AND confidence >= 80, false) AS usable FROM " + _PAGES)
def usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    from folioflow.operators.reading import usable

    return _pages(spark, sf).select("page_id", usable().alias("usable"))


@query("""
SELECT page_id, coalesce(confidence >= 95 AND len(line_chars) >= 5 AND lang IS NOT NULL AND len(list_filter(line_chars, lambda x: x >= 45)) * 2 >= len(line_chars)
AND len(list_filter(line_widths, lambda x: x >= 0.6 * list_max(line_widths))) * 2 >= len(line_widths), false) AS running FROM """ + _PAGES)
def running_text(spark: SparkSession, sf: str) -> DataFrame:
    from folioflow.operators.reading import line_shape_gate

    return _pages(spark, sf).select("page_id", line_shape_gate().alias("running"))


@query("SELECT doc_id, page, page_id, confidence FROM " + _PAGES + " QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC NULLS LAST, page_id) = 1")
def best_readings(spark: SparkSession, sf: str) -> DataFrame:
    from folioflow.operators.reading import best_reading

    return best_reading(_pages(spark, sf).select("doc_id", "page", "page_id", "confidence"), ["doc_id", "page"], "page_id")


@query("""
WITH t AS (SELECT doc_id, page, words, md5('p|' || doc_id || '/' || page) AS d FROM (SELECT DISTINCT doc_id, page, words FROM ocr_pages) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('p|' || doc_id || '/' || page), page, words DESC NULLS LAST) <= 5)
SELECT doc_id, page, words FROM t WHERE words >= 50 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, page) = 1
""")
def picked_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pick_page(table(spark, sf, "ocr_pages").select("doc_id", "page", "words").distinct())


@query("""
WITH r AS (SELECT page_id, confidence / 100 AS accuracy, coalesce(words, 0) < 20 AS defect FROM """ + _PAGES + """)
SELECT count(*) AS items, round(median(accuracy), 6) AS median, count(*) FILTER (WHERE accuracy >= 0.9) AS good, count(*) FILTER (WHERE defect) AS defects,
coalesce(median(accuracy) >= 0.95 AND count(*) FILTER (WHERE accuracy >= 0.9) >= 58 / 64 * count(*) AND count(*) FILTER (WHERE defect) <= 8 / 64 * count(*), false) AS passed FROM r
""")
def acceptance_gate(spark: SparkSession, sf: str) -> DataFrame:
    rated = _pages(spark, sf).select((F.col("confidence") / 100).alias("accuracy"), (F.coalesce("words", F.lit(0)) < 20).alias("defect"))
    return sampling.acceptance(rated)
