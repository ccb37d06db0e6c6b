"""Queries of the checks of one rendering against others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.operators import checks, nested
from folioflow.operators.measures import token_bag
from folioflow.plans.core import _TABLES_SQL, _WORD
from folioflow.plans.gazette import _BLOCKS, _LINES, _NOTES, _PAGES, _blocks, _lines, _notes, _pages
from folioflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle
_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _bag_sql(source: str, key: str = "doc_id") -> str:
    return f"(SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({_T}) AS token FROM {source}) GROUP BY ALL)"


_READ = f"(SELECT doc_id || '|' || page AS k, array_to_string(paragraphs, ' ') AS text FROM {_PAGES} WHERE paragraphs IS NOT NULL)"
_LAYER = f"(SELECT doc_id || '|' || page AS k, text FROM {_LINES} WHERE mark = '')"


def _kind_sql(source: str) -> str:
    t = f"(SELECT k, unnest({_T}) AS token FROM {source})"
    bare = f"translate(token, '{checks.MARKED}', '{checks.PLAIN}')"
    return f"(SELECT k, kind, token, count(*) AS n FROM (SELECT k, 'whole' AS kind, token FROM {t} UNION ALL SELECT k, 'plain', {bare} FROM {t} UNION ALL SELECT k, 'number', token FROM {t} WHERE regexp_matches(token, '^[0-9]+$')) GROUP BY ALL)"


@query(f"""
WITH r AS {_kind_sql(_LAYER)}, h AS {_kind_sql(_READ)}, ks AS (SELECT k FROM {_LAYER} INTERSECT SELECT k FROM {_READ}),
j AS (SELECT coalesce(r.k, h.k) AS k, coalesce(r.kind, h.kind) AS kind, coalesce(r.n, 0) AS a, coalesce(h.n, 0) AS b FROM r FULL JOIN h ON r.k = h.k AND r.kind = h.kind AND r.token = h.token WHERE coalesce(r.k, h.k) IN (SELECT k FROM ks))
SELECT k, kind, sum(a)::BIGINT AS ref, sum(b)::BIGINT AS hyp, sum(least(a, b))::BIGINT AS common, round(sum(least(a, b)) / greatest(sum(a), 1), 6) AS kept, round(sum(least(a, b)) / greatest(sum(b), 1), 6) AS grounded FROM j GROUP BY k, kind
""")
def reading_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Read pages against the text layer of the same page, with and without marks, and numbers alone."""
    page = F.concat_ws("|", "doc_id", "page").alias("k")
    ref = _lines(spark, sf).filter("mark = '' and doc_id is not null and page is not null").select(page, "text")
    hyp = _pages(spark, sf).filter("paragraphs is not null and doc_id is not null and page is not null").select(page, F.array_join("paragraphs", " ").alias("text"))
    return checks.reading_quality(ref, hyp, "k")


def _tool_sql(tool: str, source: str) -> str:
    return f"""SELECT '{tool}' AS tool, k, sum(a) AS ref, sum(b) AS hyp, sum(least(a, b)) AS common FROM (SELECT coalesce(r.doc_id, h.doc_id) AS k, coalesce(r.n, 0) AS a, coalesce(h.n, 0) AS b
FROM (SELECT * FROM ref WHERE doc_id IN (SELECT doc_id FROM {source})) r FULL JOIN (SELECT * FROM {source} WHERE doc_id IN (SELECT doc_id FROM ref)) h ON r.doc_id = h.doc_id AND r.token = h.token) GROUP BY k"""


@query(f"""
WITH ref AS {_bag_sql(_BLOCKS)}, lines AS {_bag_sql(f"(SELECT doc_id, text FROM {_LINES} WHERE mark = '')")}, notes AS {_bag_sql(_NOTES)}, pages AS {_bag_sql(f"(SELECT doc_id, array_to_string(paragraphs, ' ') AS text FROM {_PAGES})")},
s AS ({" UNION ALL ".join(_tool_sql(t, t) for t in ("lines", "notes", "pages"))})
SELECT tool, count(*) AS items, sum(ref)::BIGINT AS ref, sum(hyp)::BIGINT AS hyp, sum(common)::BIGINT AS common, round(avg(round(common / greatest(ref, 1), 6)), 6) AS macro_kept, round(sum(common) / greatest(sum(ref), 1), 6) AS micro_kept, round(sum(common) / greatest(sum(hyp), 1), 6) AS micro_grounded FROM s GROUP BY tool
""")
def tool_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, notes and read pages as three renderings against the blocks."""
    pages = _pages(spark, sf).select("doc_id", F.array_join("paragraphs", " ").alias("text"))
    tools = {"lines": _lines(spark, sf).filter("mark = ''"), "notes": _notes(spark, sf), "pages": pages}
    return checks.tool_comparison(token_bag(_blocks(spark, sf), "doc_id"), {t: token_bag(df.filter("doc_id is not null"), "doc_id") for t, df in tools.items()}, "doc_id")


@query(f"""
WITH n AS {_bag_sql(_NOTES)}, l AS {_bag_sql(_LINES)}, b AS {_bag_sql(_BLOCKS)}, m AS (SELECT n.doc_id, n.token, n.n - coalesce(l.n, 0) AS n FROM n LEFT JOIN l ON n.doc_id = l.doc_id AND n.token = l.token WHERE n.n > coalesce(l.n, 0))
SELECT doc_id, token, n, CASE WHEN (doc_id, token) IN (SELECT doc_id, token FROM b) THEN 'block' WHEN token IN (SELECT token FROM l) THEN 'other' ELSE 'nowhere' END AS place FROM m
""")
def note_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    bags = [token_bag(df(spark, sf).filter("doc_id is not null"), "doc_id") for df in (_notes, _lines, _blocks)]
    return checks.note_diagnosis(*bags, "doc_id")


_ART = r"SELECT DISTINCT doc_id AS eli, regexp_extract(text, '^\s*(?:Art\.|§) ?([0-9]+[a-z]?)', 1) AS num FROM {} WHERE regexp_matches(text, '^\s*(?:Art\.|§) ?[0-9]+')"


@query(f"""
{_TABLES_SQL}
, t AS (SELECT DISTINCT a.eli, {_WORD("num")} AS num FROM m JOIN (SELECT DISTINCT tree_id, eli FROM act_trees) a ON a.tree_id = m.tree_id WHERE {_WORD("type")} IN ('art', 'par') AND a.eli IS NOT NULL), r AS ({_ART.format(_BLOCKS)}), l AS ({_ART.format(_LINES)}),
u AS (SELECT eli, num, 1 AS t, 0 AS r, 0 AS l FROM t WHERE num IS NOT NULL UNION ALL SELECT eli, num, 0, 1, 0 FROM r UNION ALL SELECT eli, num, 0, 0, 1 FROM l), g AS (SELECT eli, num, max(t) || '' || max(r) || max(l) AS c FROM u GROUP BY ALL)
SELECT eli, num, CASE c WHEN '111' THEN 'agreed' WHEN '011' THEN 'tree_error' WHEN '001' THEN 'layer_only' WHEN '100' THEN 'tree_only' WHEN '010' THEN 'reference_only' WHEN '101' THEN 'confirmed_by_layer' ELSE 'confirmed_by_reference' END AS class FROM g
""")
def article_check(spark: SparkSession, sf: str) -> DataFrame:
    """Unit numbers of the trees against those of the blocks (reference) and the lines (text layer)."""
    trees = table(spark, sf, "act_trees")
    nodes = nested.node_rows(trees).filter("type in ('art', 'par') and num is not null").select("tree_id", "num")
    tree = nodes.join(trees.select("tree_id", "eli").filter("eli is not null").distinct(), "tree_id").select("eli", "num")
    pattern = r"^\s*(?:Art\.|§) ?([0-9]+[a-z]?)"
    nums = lambda df: df.filter("doc_id is not null").filter(F.col("text").rlike(pattern)).select(F.col("doc_id").alias("eli"), F.regexp_extract("text", pattern, 1).alias("num"))
    return checks.article_check(tree, nums(_blocks(spark, sf)), nums(_lines(spark, sf)), "eli")


_PATTERNS = {"raised": "[⁰¹²³⁴⁵⁶⁷⁸⁹]", "section": "§", "quote": "[„”]", "dash": "[–—]", "number": r"\d+"}


def _index_sql(name: str, source: str) -> str:
    cells = ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {k}" for k, p in _PATTERNS.items())
    parts = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{name}' AS a, coalesce({k}, 0) AS n FROM (SELECT doc_id, {cells} FROM {source} WHERE doc_id IS NOT NULL GROUP BY 1)" for k in _PATTERNS)
    return f"({parts})"


@query(f"""
WITH x AS (SELECT * FROM {_index_sql("lines", _LINES)} UNION ALL SELECT * FROM {_index_sql("blocks", _BLOCKS)} UNION ALL SELECT * FROM {_index_sql("notes", _NOTES)}),
d AS (SELECT doc_id, kind, sum(n) FILTER (a = 'lines') AS l, sum(n) FILTER (a = 'blocks') AS b, sum(n) FILTER (a = 'notes') AS t FROM x GROUP BY ALL), e AS (SELECT kind, coalesce(l, 0) AS l, coalesce(b, 0) AS b, coalesce(t, 0) AS t FROM d)
SELECT kind, sum(l)::BIGINT AS lines, sum(b)::BIGINT AS blocks, sum(t)::BIGINT AS notes, count(*) FILTER (l = b AND b = t) AS agreeing, count(*) FILTER (NOT (l = b AND b = t)) AS differing FROM e GROUP BY kind
""")
def index_check(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of expressions in lines, blocks and notes of each act."""
    tables = {"lines": _lines(spark, sf), "blocks": _blocks(spark, sf), "notes": _notes(spark, sf)}
    return checks.index_check({n: df.filter("doc_id is not null").select("doc_id", "text") for n, df in tables.items()}, _PATTERNS, "doc_id")


@query(f"""
WITH b AS (SELECT doc_id, seq, block_id, {_T} AS ts FROM {_BLOCKS} WHERE doc_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL),
f AS (SELECT doc_id, flatten(list(ts ORDER BY seq, block_id)) AS ts FROM b GROUP BY 1) SELECT doc_id, list_slice(ts, 1, 100) AS tokens FROM f
""")
def rating_material(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred tokens of every act."""
    blocks = _blocks(spark, sf).filter("doc_id is not null and seq is not null and text is not null")
    return checks.first_tokens(blocks.select("doc_id", "seq", "block_id", "text"), "doc_id", ["seq", "block_id"])


@query("""
WITH l AS (SELECT DISTINCT log_id, eli, pages FROM index_log), s AS (SELECT *, coalesce(sum(coalesce(pages, 0)) OVER (ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, row_number() OVER (ORDER BY log_id) AS k FROM l)
SELECT log_id, eli, pages FROM s WHERE spent < 1500 AND k <= 400
""")
def budgeted_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts that a run with a budget of pages and a limit of acts would take, in their order."""
    plan = table(spark, sf, "index_log").select("log_id", "eli", "pages").distinct()
    return checks.within_budget(plan, ["log_id"], F.col("pages"), 1500, 400)


@query(f"""
{_TABLES_SQL}
, f AS (SELECT tree_id, unnest(['type', 'num', 'label', 'text']) AS field, unnest([{_WORD("type")}, {_WORD("num")}, {_WORD("label")}, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.text' ELSE v ->> '$' END]) AS text FROM m)
SELECT tree_id, field, count(*) AS strings, sum(len({_T}))::BIGINT AS words FROM f WHERE text <> '' GROUP BY ALL
""")
def tree_strings(spark: SparkSession, sf: str) -> DataFrame:
    return checks.tree_strings(nested.node_rows(table(spark, sf, "act_trees")), "tree_id", ["type", "num", "label", "text"])
