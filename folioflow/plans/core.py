"""Queries of the core problems: nested records and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import fresh_path, materialize, table
from folioflow.operators import incremental as inc
from folioflow.operators import nested


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.label_nodes(table(spark, sf, "act_trees")).select("tree_id", "act_part", "node_id", "parent_id", "ord")


def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole node table."""
    return nested.node_rows(table(spark, sf, "act_trees"))


def p1_node_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Interval labels, types and numbers of all nodes."""
    return p1_nodes(spark, sf).select("tree_id", "act_part", "node_id", "last_id", "depth", "type", "num", "path")


def p1_annexes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.annex_rows(table(spark, sf, "act_trees"))


def p1_point_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Innermost enclosing article of every point, by interval containment of the two tables."""
    nodes = materialize(nested.node_rows(table(spark, sf, "act_trees")).select("tree_id", "act_part", "node_id", "last_id", "depth", "type"), "p1")
    return nested.nearest_outer(nested.node_table(nodes, "art"), nested.node_table(nodes, "pkt"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    log = inc.CommitLog(spark, fresh_path(spark, "p2"))
    plan = inc.refresh_plan(log, *(table(spark, sf, t) for t in ("acts_meta", "index_log", "converters")))
    return plan.select("eli")


def p2_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The plan after two runs, the first bounded in the middle of either sequence: equal to one run."""
    meta, attempts, releases = (table(spark, sf, t) for t in ("acts_meta", "index_log", "converters"))
    log = inc.CommitLog(spark, fresh_path(spark, "p2"))
    us = F.unix_micros(F.col("received_at").cast("timestamp"))
    a, b = meta.agg(F.min(us), F.max(us)).first()
    c, d = attempts.agg(F.min("log_id"), F.max("log_id")).first()
    middle = {"listings": None if a is None else (a + b) // 2, "attempts": None if c is None else (c + d) // 2}
    inc.refresh_plan(log, meta, attempts, releases, middle)
    return inc.refresh_plan(log, meta, attempts, releases).select("eli")


QUERIES = {
    "p1_found": p1_found, "p1_nodes": p1_nodes, "p1_node_labels": p1_node_labels, "p1_annexes": p1_annexes, "p1_point_articles": p1_point_articles,
    "p2_found": p2_found, "p2_increments": p2_increments,
}

_CLOCK = r"(?:[T ]+(\d{2}):?(\d{2}):?(\d{2})(?:[.,](\d{1,6})\d*)?)?"
_ZONE = r"\s*(Z|z|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})?"


def _instant_sql(col: str) -> str:
    names = "['y','m','d','h','n','s','f','z']"
    first = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})" + _CLOCK + _ZONE + "$"
    day = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _CLOCK + _ZONE + "$"
    day_names = "['d','m','y','h','n','s','f','z']"

    def one(pattern: str, fields: str) -> str:
        x = f"regexp_extract(trim({col}), '{pattern}', {fields})"
        g = lambda k: f"({x}).{k}"
        zero = lambda k: f"CASE WHEN {g(k)} = '' THEN '00' ELSE {g(k)} END"
        zone = f"CASE WHEN {g('z')} LIKE '+%' OR {g('z')} LIKE '-%' THEN substr({g('z')}, 1, 3) || ':' || CASE WHEN length({g('z')}) = 3 THEN '00' ELSE right({g('z')}, 2) END ELSE '+00:00' END"
        text = f"{g('y')} || '-' || lpad({g('m')}, 2, '0') || '-' || lpad({g('d')}, 2, '0') || ' ' || {zero('h')} || ':' || {zero('n')} || ':' || {zero('s')} || '.' || rpad({g('f')}, 6, '0') || {zone}"
        return f"CASE WHEN regexp_matches(trim({col}), '{pattern}') THEN epoch_us(try_cast({text} AS TIMESTAMPTZ)) END"

    return f"coalesce({one(first, names)}, {one(day, day_names)})"


_PLAN_SQL = f"""
WITH l AS (SELECT eli, {_instant_sql('change_date')} AS changed_us, epoch_us(received_at) AS received_us, text_pdf, text_html FROM acts_meta),
newest AS (SELECT * FROM l WHERE changed_us IS NOT NULL AND eli IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY eli ORDER BY changed_us DESC, received_us DESC NULLS LAST, coalesce(text_html, false) DESC, coalesce(text_pdf, false)) = 1),
best AS (SELECT converter_version FROM converters WHERE output_level = (SELECT max(output_level) FROM converters)),
done AS (SELECT DISTINCT eli, {_instant_sql('change_date')} AS changed_us FROM index_log
  WHERE lower(trim(status)) = 'ok'
  AND regexp_replace(regexp_replace(regexp_replace(lower(trim(converter)), '^[a-z0-9]*[a-z][a-z0-9]*[ /-]+', ''), ' *\\(batch\\)$', ''), '^v', '') IN (SELECT converter_version FROM best))
SELECT eli FROM newest WHERE text_pdf AND NOT coalesce(text_html, false)
AND NOT EXISTS (SELECT 1 FROM done WHERE done.eli = newest.eli AND done.changed_us = newest.changed_us)
"""

_NODES_SQL = """
WITH RECURSIVE raw AS (SELECT DISTINCT tree_id, tree FROM act_trees WHERE tree IS NOT NULL),
s1 AS (SELECT tree_id, tree, try_cast(tree AS JSON) AS j FROM raw),
s2 AS (SELECT tree_id, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM s1 WHERE json_valid(tree)),
d AS (SELECT tree_id, j FROM s2 WHERE json_type(j) = 'OBJECT'),
x AS (SELECT tree_id, j -> '$.annexes' AS a FROM d),
al AS (SELECT tree_id, CASE json_type(a) WHEN 'ARRAY' THEN CAST(a AS JSON[]) WHEN 'OBJECT' THEN [a] WHEN 'VARCHAR' THEN [a] ELSE [] END AS items FROM x),
an AS (SELECT tree_id, unnest(f) AS a, generate_subscripts(f, 1) AS k FROM (SELECT tree_id, list_filter(items, lambda i: json_type(i) IN ('OBJECT', 'VARCHAR')) AS f FROM al)),
parts AS (SELECT tree_id, 0 AS p, 'body' AS act_part, j -> '$.body' AS v FROM d UNION ALL SELECT tree_id, k, 'annex_' || k, a -> '$.body' FROM an WHERE json_type(a) = 'OBJECT'),
top AS (SELECT tree_id, p, act_part, list_filter(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] WHEN 'VARCHAR' THEN [v] ELSE [] END, lambda i: json_type(i) IN ('OBJECT', 'VARCHAR')) AS f FROM parts),
n AS (SELECT tree_id, act_part, [p, o] AS path, i AS v, o AS ord FROM (SELECT tree_id, p, act_part, unnest(f) AS i, generate_subscripts(f, 1) AS o FROM top)
UNION ALL SELECT tree_id, act_part, list_append(path, o), i, o FROM (SELECT tree_id, act_part, path, unnest(f) AS i, generate_subscripts(f, 1) AS o FROM (
SELECT tree_id, act_part, path, list_filter(CASE json_type(v -> '$.children') WHEN 'ARRAY' THEN CAST(v -> '$.children' AS JSON[]) WHEN 'OBJECT' THEN [v -> '$.children'] WHEN 'VARCHAR' THEN [v -> '$.children'] ELSE [] END, lambda i: json_type(i) IN ('OBJECT', 'VARCHAR')) AS f FROM n WHERE json_type(v) = 'OBJECT'))),
m AS (SELECT tree_id, act_part, path, ord, v, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path) AS INT) AS node_id FROM n)
SELECT m.tree_id, m.act_part, m.node_id, coalesce(u.node_id, 0) AS parent_id, CAST(m.ord AS INT) AS ord FROM m LEFT JOIN m u ON u.tree_id = m.tree_id AND u.path = m.path[1:len(m.path) - 1] AND len(m.path) > 2
"""

_TABLES_SQL = _NODES_SQL[: _NODES_SQL.rindex("SELECT m.tree_id")]
_WORD = lambda k: f"CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.{k}' END"
#: The article of a point by its path: the longest path of an article that its own begins with.
_POINTS_SQL = _TABLES_SQL + f"""
, t AS (SELECT tree_id, path, node_id, {_WORD("type")} AS type FROM m), a AS (SELECT * FROM t WHERE type = 'art'), p AS (SELECT * FROM t WHERE type = 'pkt')
SELECT p.tree_id, p.node_id AS inner_id, max(a.node_id) AS outer_id FROM p JOIN a ON a.tree_id = p.tree_id AND len(a.path) < len(p.path) AND p.path[1:len(a.path)] = a.path GROUP BY ALL
"""
_NODE_ROWS_SQL = _TABLES_SQL + f"""
, s AS (SELECT u.tree_id, u.node_id, max(d.node_id) AS last_id, any_value(len(u.path)) - 1 AS depth FROM m u JOIN m d ON d.tree_id = u.tree_id AND d.path[1:len(u.path)] = u.path GROUP BY ALL)
SELECT m.tree_id, m.act_part, m.node_id, s.last_id, s.depth::INT AS depth, {_WORD("type")} AS type, {_WORD("num")} AS num, {_WORD("path").replace("v ->>", "m.v ->>").replace("json_type(v)", "json_type(m.v)")} AS path
FROM m JOIN s ON s.tree_id = m.tree_id AND s.node_id = m.node_id
"""
_ANNEXES_SQL = _NODES_SQL[: _NODES_SQL.index("parts AS (")].rstrip().rstrip(",") + """
SELECT tree_id, CAST(k AS INT) AS annex_no, CASE WHEN json_type(a) = 'OBJECT' THEN a ->> '$.heading' ELSE a ->> '$' END AS heading FROM an
"""

ORACLE = {"p1_annexes": _ANNEXES_SQL, "p1_point_articles": _POINTS_SQL, "p1_node_labels": _NODE_ROWS_SQL, "p1_found": _NODES_SQL, "p2_found": _PLAN_SQL, "p2_increments": _PLAN_SQL}
