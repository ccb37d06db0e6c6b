"""Queries over the structure of acts: units, trees, Markdown, alignment of lines with blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.functions import languages
from folioflow.functions.text import tokens
from folioflow.operators import alignment, layout, markdown, reading, sampling, tree
from folioflow.operators import blocks as b
from folioflow.plans.gazette import _BLOCKS, _LINES, _PAGES, _blocks, _lines, _notes, _pages
from folioflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

_TYPE = r"""CASE WHEN regexp_matches(l, '^Art\. ?[0-9]+[a-zł]{0,3}[⁰¹²³⁴⁵⁶⁷⁸⁹]*\.?(\s|$)') THEN 'art' WHEN regexp_matches(l, '^§ ?[0-9]+[a-zł]{0,3}[⁰¹²³⁴⁵⁶⁷⁸⁹]*\.?(\s|$)') THEN 'par'
WHEN regexp_matches(l, '^[0-9]+[a-zł]{0,3}[⁰¹²³⁴⁵⁶⁷⁸⁹]*\.(\s|$)') THEN 'ust' WHEN regexp_matches(l, '^[0-9]+[a-zł]{0,3}[⁰¹²³⁴⁵⁶⁷⁸⁹]*\)(\s|$)') THEN 'pkt' WHEN regexp_matches(l, '^[a-z]{1,3}\)(\s|$)') THEN 'lit' WHEN regexp_matches(l, '^[–-]\s') THEN 'tir' END"""


@query(f"WITH x AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) SELECT {_TYPE} AS type, count(*) AS n FROM x GROUP BY 1")
def unit_types(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy(tree.unit_type(F.col("l")).alias("type")).agg(F.count("*").alias("n"))


@query()
def unit_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Node rows of all documents read as Markdown."""
    return tree.tree_nodes(table(spark, sf, "documents").select("doc_id", "text"))


@query(f"""
WITH n AS (SELECT *, sum(CASE WHEN kind = 'annex' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS part FROM {_BLOCKS})
SELECT doc_id, part::BIGINT AS part, CASE WHEN bool_or(regexp_matches(text, '^Art\\. ?[0-9]')) THEN 'Art.' ELSE '§' END AS unit FROM n GROUP BY ALL
""")
def heading_units(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.heading_unit(b.parts(markdown.with_depth(_blocks(spark, sf))))


@query()
def act_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of all acts with blocks, with front matter of their newest listing."""
    blocks = b.parts(markdown.with_depth(_blocks(spark, sf)))
    notes = b.number_labels(b.note_labels(_notes(spark, sf)))
    meta = table(spark, sf, "acts_meta")
    columns = [c for c in meta.columns if c not in ("eli", "received_at")]
    # of listings received together the greatest by all their columns
    newest = meta.groupBy("eli").agg(F.max(F.struct("received_at", *columns)).alias("x")).select("eli", *[f"x.{c}" for c in columns])
    return markdown.to_markdown(blocks, notes, newest)


_FRONT_SQL = " || ".join(
    f"coalesce('{key}: ' || CASE WHEN {'len(' + c + ') > 0' if c == 'keywords' else f'CAST({c} AS VARCHAR) <> ' + chr(39) * 2} THEN CAST(to_json({c}) AS VARCHAR) END || chr(10), '')" for key, c in markdown.FRONT
)


@query(f"SELECT DISTINCT eli, '---' || chr(10) || {_FRONT_SQL} || '---' AS text FROM acts_meta")
def front_matters(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter of every listing; of listings that differ in nothing else than their receipt once."""
    meta = table(spark, sf, "acts_meta").select(*[c for _, c in markdown.FRONT]).distinct()
    return meta.select("eli", markdown.front_matter(meta).alias("text"))


@query("""
WITH m AS (SELECT DISTINCT eli, title, act_type, change_date, keywords FROM acts_meta WHERE eli IS NOT NULL),
k AS (SELECT eli, 'title' AS name, CAST(to_json(title) AS VARCHAR) AS value FROM m WHERE title <> '' UNION ALL SELECT eli, 'type', CAST(to_json(act_type) AS VARCHAR) FROM m WHERE act_type <> '' UNION ALL SELECT eli, 'changed', CAST(to_json(change_date) AS VARCHAR) FROM m WHERE change_date <> '' UNION ALL
SELECT eli, 'keywords', CAST(to_json(keywords) AS VARCHAR) FROM m WHERE len(keywords) > 0 UNION ALL SELECT eli, 'eli', CAST(to_json(eli) AS VARCHAR) FROM m)
SELECT eli, name, value, count(*) AS n FROM k GROUP BY ALL
""")
def front_matter_values(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter written and read again."""
    meta = table(spark, sf, "acts_meta").select("eli", "title", "act_type", "change_date", "keywords").filter("eli is not null").distinct()
    texts = meta.select("eli", F.concat(markdown.front_matter(meta), F.lit("\n\n# text\nkey: 1")).alias("text"))
    return markdown.read_front_matter(texts, "eli").groupBy("eli", "name", "value").agg(F.count("*").alias("n"))


def _page_tokens(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Tokens of each page in reading order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, tokens(F.coalesce("text", F.lit(""))).alias("t"))))
    return df.groupBy("doc_id", "page").agg(F.flatten(F.transform(parts, lambda x: x["t"])).alias(name))


@query()
def align_scores(spark: SparkSession, sf: str) -> DataFrame:
    """In-order recall and precision of the blocks of each page against its text-layer lines."""
    ref = _page_tokens(_lines(spark, sf).filter("mark = ''"), ["seq", "line_id"], "ref")
    hyp = _page_tokens(_blocks(spark, sf), ["seq", "block_id"], "hyp")
    return alignment.in_order_scores(ref.join(hyp, ["doc_id", "page"], "full_outer"), ["doc_id", "page"])


@query()
def mutation_noticed(spark: SparkSession, sf: str) -> DataFrame:
    texts = _blocks(spark, sf).filter("text <> ''").select("block_id", tokens(F.col("text")).alias("tokens"))
    return alignment.mutation_test(texts, "block_id")


_NUMS = r"SELECT DISTINCT doc_id, regexp_extract(text, '^\s*(?:Art\.|§) ?([0-9]+[a-z]?)', 1) AS num FROM {} WHERE regexp_matches(text, '^\s*(?:Art\.|§) ?[0-9]+')"


@query(f"""
WITH a AS ({_NUMS.format(_LINES)}), b AS ({_NUMS.format(_BLOCKS)})
SELECT doc_id, num, 'ours' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc_id, num, 'theirs' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def number_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Unit numbers that only the lines or only the blocks of an act have."""
    nums = lambda df: df.filter(F.col("text").rlike(r"^\s*(?:Art\.|§) ?[0-9]+")).select("doc_id", F.regexp_extract("text", r"^\s*(?:Art\.|§) ?([0-9]+[a-z]?)", 1).alias("num"))
    return alignment.number_coverage(nums(_lines(spark, sf)), nums(_blocks(spark, sf)), "doc_id")


_MARKS = r"SELECT doc_id, sum(len(regexp_extract_all(text, '§')))::BIGINT AS section, sum(len(regexp_extract_all(text, 'Art\.')))::BIGINT AS article FROM {} GROUP BY 1"


@query(f"""
WITH a AS ({_MARKS.format(_LINES)}), b AS ({_MARKS.format(_BLOCKS)}),
j AS (SELECT coalesce(a.section, 0) AS s1, coalesce(b.section, 0) AS s2, coalesce(a.article, 0) AS a1, coalesce(b.article, 0) AS a2 FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT 'section' AS kind, sum(s1)::BIGINT AS ours, sum(s2)::BIGINT AS theirs, sum(least(s1, s2))::BIGINT AS common FROM j
UNION ALL SELECT 'article', sum(a1)::BIGINT, sum(a2)::BIGINT, sum(least(a1, a2))::BIGINT FROM j
""")
def marker_counts(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda df: df.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("§"))).alias("section"), F.sum(F.regexp_count("text", F.lit(r"Art\."))).alias("article"))
    return alignment.marker_counts(count(_lines(spark, sf)), count(_blocks(spark, sf)), "doc_id", ["section", "article"])


@query(f"""
WITH u AS (SELECT doc_id, regexp_extract(text, '^§ ?([0-9]+[a-z]?)', 1) AS num FROM {_LINES} WHERE regexp_matches(text, '^§ ?[0-9]+'))
SELECT doc_id, num, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1
""")
def repeated_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Unit numbers that an act has more than once."""
    nums = _lines(spark, sf).filter(F.col("text").rlike("^§ ?[0-9]+")).withColumn("num", F.regexp_extract("text", "^§ ?([0-9]+[a-z]?)", 1))
    return nums.groupBy("doc_id", "num").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"SELECT doc_id, count(*) AS headers, min(seq) AS first_seq, max(seq) AS last_seq FROM {_LINES} WHERE regexp_matches(text, '^[^a-z]*[A-ZĄĆĘŁŃÓŚŹŻ]{{4,}} ') GROUP BY 1 HAVING count(*) >= 2")
def capital_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Acts with two lines or more that begin in capitals."""
    capitals = _lines(spark, sf).filter(F.col("text").rlike("^[^a-z]*[A-ZĄĆĘŁŃÓŚŹŻ]{4,} "))
    return capitals.groupBy("doc_id").agg(F.count("*").alias("headers"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).filter("headers >= 2")


@query(f"""
SELECT doc_id, page, count(*) AS lines, count(*) FILTER (WHERE x0 < pw / 2 - 5 AND x1 > pw / 2 + 5) AS across,
count(*) >= 60 AND count(*) FILTER (WHERE x0 < pw / 2 - 5 AND x1 > pw / 2 + 5) * 100 < 3 * count(*) AND count(*) FILTER (WHERE x1 <= pw / 2 + 5) * 4 >= count(*) AND count(*) FILTER (WHERE x0 >= pw / 2 - 5) * 4 >= count(*) AS two_columns
FROM {_LINES} WHERE y_bottom > 0 GROUP BY ALL
""")
def two_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column test of each page: hardly any line crosses the middle and a quarter stands on either side."""
    middle = F.col("pw") / 2
    across, left, right = (F.count_if(c) for c in ((F.col("x0") < middle - 5) & (F.col("x1") > middle + 5), F.col("x1") <= middle + 5, F.col("x0") >= middle - 5))
    n = F.count("*")
    return _lines(spark, sf).filter("y_bottom > 0").groupBy("doc_id", "page").agg(n.alias("lines"), across.alias("across"), ((n >= 60) & (across * 100 < 3 * n) & (left * 4 >= n) & (right * 4 >= n)).alias("two_columns"))


@query(f"""
WITH t AS (SELECT page_id, {_TOKENS.format("coalesce(array_to_string(paragraphs, ' '), '')")} AS k FROM {_PAGES}) SELECT {languages.guess_sql('k')} AS guess, count(*) AS pages FROM t GROUP BY 1
""")
def reading_languages(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.array_join("paragraphs", " "), F.lit(""))
    return _pages(spark, sf).select(tokens(text).alias("k")).select(languages.guess(F.col("k")).alias("guess")).groupBy("guess").agg(F.count("*").alias("pages"))


@query(f"""
WITH l AS (SELECT doc_id, max(page) AS page FROM {_LINES} GROUP BY 1) SELECT l.doc_id, l.page, count(*) AS lines, bool_or(coalesce(regexp_matches(x.text, 'ISSN'), false)) AS serial FROM l JOIN {_LINES} x ON x.doc_id = l.doc_id AND x.page = l.page GROUP BY ALL
""")
def last_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the last page of each act, and whether it names a serial number."""
    counts = _lines(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.bool_or(F.coalesce(F.col("text").rlike("ISSN"), F.lit(False))).alias("serial"))
    return counts.groupBy("doc_id").agg(F.max_by(F.struct("page", "lines", "serial"), "page").alias("x")).select("doc_id", "x.*")


@query("""
WITH t AS (SELECT DISTINCT doc_id FROM documents WHERE act_type = 'Umowa międzynarodowa'), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('treaty|' || doc_id), doc_id) AS k FROM t)
SELECT doc_id, CASE WHEN k <= 20 THEN 'dev' ELSE 'test' END AS part FROM r WHERE k <= 40
""")
def treaty_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One draw of treaties, split into development and test items."""
    treaties = table(spark, sf, "documents").filter("act_type = 'Umowa międzynarodowa'").select("doc_id").distinct()
    dev, test = sampling.split_sample(treaties, "doc_id", 20, "treaty")
    return dev.withColumn("part", F.lit("dev")).unionByName(test.withColumn("part", F.lit("test")))


_UNIT_SQL = r"regexp_matches(text, '^{}')"


@query(f"""
WITH n AS (SELECT *, sum(CASE WHEN kind = 'annex' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS part FROM {_BLOCKS} WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, part, bool_or({_UNIT_SQL.format(r"Art\. ?[0-9]")}) AS art FROM n GROUP BY ALL)
SELECT n.doc_id, sum(CASE WHEN kind NOT IN ('annex', 'signature', 'ocr', 'scan', 'notext', 'image') AND CASE WHEN art THEN {_UNIT_SQL.format(r"Art\. ?[0-9]+")} ELSE {_UNIT_SQL.format("§ ?[0-9]+")} END THEN 1 ELSE 0 END)::BIGINT AS headings,
count(*) FILTER (kind = 'annex') AS annexes, count(*) FILTER (kind = 'signature') AS signatures FROM n JOIN u ON n.doc_id = u.doc_id AND n.part = u.part WHERE text <> '' GROUP BY 1
""")
def markdown_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, annexes and signatures in the Markdown of each act. No block of the test tables opens with a quote, so the SQL counts all units."""
    text = act_markdown(spark, sf).filter("doc_id is not null")
    count = lambda pattern: F.sum(F.regexp_count("text", F.lit(pattern))).cast("long")
    acts = table(spark, sf, "act_blocks").filter("text <> ''").select("doc_id").distinct()
    return text.join(acts, "doc_id", "left_semi").groupBy("doc_id").agg(count(r"(?m)^##### (Art\.|§)").alias("headings"), count(r"(?m)^## ").alias("annexes"), count(r"(?m)^\*[^*\n]+\*$").alias("signatures"))


@query(f"""
WITH l AS (SELECT doc_id, page, x0, y_top AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY y_top, x0, line_id) AS k FROM {_LINES} WHERE y_bottom > 0),
s AS (SELECT a.doc_id, a.page, median((b.x0 - a.x0) / (b.t - a.t)) AS m, count(*) AS n FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page = b.page AND a.k < b.k AND b.t - a.t > 200 GROUP BY ALL)
SELECT p.doc_id, p.page, CASE WHEN n >= 10 AND abs(m) <= 0.05 THEN m ELSE 0 END AS slope FROM (SELECT DISTINCT doc_id, page FROM l) p LEFT JOIN s ON p.doc_id = s.doc_id AND p.page = s.page
""")
def page_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of the left margin of each page with positions."""
    return reading.deskew_slope(_lines(spark, sf).filter("y_bottom > 0").select("doc_id", "page", "x0", F.col("y_top").alias("top")))


_BARE = "translate({}, 'ąćęłńóśżź', 'acelnoszz')"


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_TOKENS.format("p")}) AS word FROM (SELECT unnest(paragraphs) AS p FROM ocr_pages)), k AS (SELECT t AS word FROM (SELECT unnest({_TOKENS.format("text")}) AS t FROM act_lines WHERE mark = '') GROUP BY 1 HAVING count(*) >= 3),
u AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM k)),
j AS (SELECT u.word, k.word AS t, list_filter(range(1, length(u.word) + 1), lambda i: substr(u.word, i, 1) <> substr(k.word, i, 1)) AS d FROM u JOIN k ON {_BARE.format("u.word")} = {_BARE.format("k.word")} AND length(u.word) = length(k.word)),
c AS (SELECT word, min(t) AS repaired FROM j WHERE len(d) BETWEEN 1 AND 2 AND len(list_filter(d, lambda i: substr(word, i, 1) <> {_BARE.format("substr(t, i, 1)")})) = 0 GROUP BY word HAVING count(*) = 1)
SELECT * FROM c UNION ALL SELECT word, left(word, 1) || ' ' || substr(word, 2) FROM u WHERE length(word) >= 5 AND left(word, 1) IN ('a', 'i', 'o', 'u', 'w', 'z') AND substr(word, 2) IN (SELECT word FROM k) AND word NOT IN (SELECT word FROM c)
""")
def word_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown words of read pages with their lost marks; the dictionary is that of the text-layer lines."""
    words = table(spark, sf, "ocr_pages").select(F.explode("paragraphs").alias("p")).select(F.explode(tokens(F.col("p"))).alias("word"))
    known = table(spark, sf, "act_lines").filter("mark = ''").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    return reading.repair_words(words, known.select("word"))


@query(f"""
WITH p AS (SELECT doc_id, page, page_id, unnest(paragraphs) AS text, generate_subscripts(paragraphs, 1) - 1 AS seq FROM {_PAGES}),
q AS (SELECT *, try_cast(nullif(regexp_extract(text, '^\\s*([0-9]+)\\.?\\s', 1), '') AS INT) AS n, regexp_extract(text, '^\\s*([8$S5])\\s?([0-9]{{1,3}}[a-z]?)\\.\\s', 1) AS st FROM p WHERE text <> ''),
r AS (SELECT *, lag(n) OVER (PARTITION BY doc_id, page ORDER BY seq, page_id) AS before FROM q), i AS (SELECT *, regexp_replace(text, '(?i)\\b(w|z|do|od|o|według|rozumieniu|podstawie|określonych w|przepisów) [$S8] ([0-9])', '\\1 § \\2', 'g') AS t FROM r)
SELECT page_id, seq::INT AS seq, CASE WHEN st <> '' AND NOT (st IN ('8', '5') AND coalesce(before, -1) = try_cast(st AS INT) - 1) THEN regexp_replace(t, '^(\\s*)[8$S5]\\s?([0-9]{{1,3}}[a-z]?\\.\\s)', '\\1§ \\2') ELSE t END AS text FROM i
""")
def section_sign_repairs(spark: SparkSession, sf: str) -> DataFrame:
    paras = _pages(spark, sf).select("doc_id", "page", "page_id", F.posexplode("paragraphs").alias("seq", "text")).filter("text <> ''")
    return reading.section_signs(paras).select("page_id", "seq", "text")


@query(f"""
WITH k AS (SELECT doc_id, page, CASE WHEN count(text) = 0 THEN 'empty' WHEN sum(CASE WHEN mark = '' THEN length(text) ELSE 0 END) >= 100 THEN 'text' WHEN bool_or(mark = 'scan') THEN 'scan' WHEN bool_or(mark = 'ocr') THEN 'ocr'
WHEN sum(CASE WHEN mark = '' THEN length(text) ELSE 0 END) < 20 THEN 'sparse' ELSE 'text' END AS kind FROM {_LINES} GROUP BY ALL),
g AS (SELECT doc_id, kind, page, page - row_number() OVER (PARTITION BY doc_id, kind ORDER BY page) AS g FROM k WHERE kind IN ('empty', 'scan', 'ocr')),
r AS (SELECT doc_id, kind, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, kind, g)
SELECT doc_id, '[Pages ' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) || ': ' || CASE kind WHEN 'empty' THEN 'no text' WHEN 'scan' THEN 'text read from a scan' ELSE 'text read from an image' END || ']' AS note FROM r GROUP BY doc_id, kind
""")
def page_notes(spark: SparkSession, sf: str) -> DataFrame:
    kinds = layout.page_kinds(_lines(spark, sf)).withColumn("key", F.concat_ws("|", "doc_id", "kind"))
    ranges = layout.page_ranges(kinds.filter(F.col("kind") != "text"), "key")
    split = ranges.select(F.substring_index("key", "|", 1).alias("doc_id"), F.substring_index("key", "|", -1).alias("kind"), "pages")
    return markdown.page_notes(split)


@query(f"SELECT block_id, CASE WHEN regexp_matches(text, '\\[\\^[^\\]]+\\]') THEN len(list_distinct(regexp_extract_all(text, '\\[\\^([^\\]]+)\\]', 1))) ELSE 0 END AS markers, regexp_matches(text, '^\\W{{0,3}}(USTAWA|ROZPORZĄDZENIE|OBWIESZCZENIE|UCHWAŁA|ZARZĄDZENIE|UMOWA|OŚWIADCZENIE|POSTANOWIENIE)\\b') AS opens_act FROM {_BLOCKS} WHERE text IS NOT NULL")
def block_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Note markers of each block and whether it begins with an act type in capitals."""
    markers = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))).cast("long")
    return _blocks(spark, sf).filter("text is not null").select("block_id", markers.alias("markers"), b.starts_act(F.col("text")).alias("opens_act"))

