"""Nested unit trees (JSON text) to flat node rows with interval labels.

Every node of a record gets its pre-order number (node_id), its post-order number and the last
pre-order number of its subtree, from one depth-first walk. A node d lies inside a node a exactly if
a.node_id < d.node_id <= a.last_id, so the tables of the different unit types can be joined
to each other without walking parent links.

Defined results: NULL, empty or incomplete JSON gives no rows; a document kept as a JSON string is
read again; null entries are left out and not counted; numbers and booleans in a list are no nodes;
a lone item stands for a list of one; a list in a list is read as if its items stood in the outer one.
Records delivered twice (same id, same text) give their rows once. Any nesting depth is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NODE = "act_part string, node_id int, post_id int, last_id int, parent_id int, ord int, depth int"
_TEXT = "type string, num string, path string, label string, text string, quoted boolean"


class _Reader:
    """JSON reader without recursion, for records nested deeper than the built-in one allows."""

    def __init__(self) -> None:
        self.scan = json.JSONDecoder()

    def read(self, s: str):
        ws = " \t\n\r"
        i, n = 0, len(s)
        stack: list = []
        done = object()
        top = done
        key: list = []
        expect = "value"
        while True:
            while i < n and s[i] in ws:
                i += 1
            if i >= n:
                if top is not done and not stack:
                    return top
                raise ValueError("incomplete JSON")
            if top is not done and not stack:
                raise ValueError("text behind the document")
            c = s[i]
            closed = False
            if expect in ("value", "first"):
                if c in "[{" :
                    stack.append([] if c == "[" else {})
                    key.append(None)
                    i += 1
                    expect = "first" if c == "[" else "firstkey"
                    continue
                if c == "]" and expect == "first":
                    value, closed = stack.pop(), True
                    key.pop()
                    i += 1
                else:
                    value, i = self.scan.raw_decode(s, i)
            elif expect in ("key", "firstkey"):
                if c == "}" and expect == "firstkey":
                    value, closed = stack.pop(), True
                    key.pop()
                    i += 1
                else:
                    if c != '"':
                        raise ValueError("key expected")
                    key[-1], i = self.scan.raw_decode(s, i)
                    while i < n and s[i] in ws:
                        i += 1
                    if s[i : i + 1] != ":":
                        raise ValueError("colon expected")
                    i += 1
                    expect = "value"
                    continue
            else:
                if c == ",":
                    expect = "value" if isinstance(stack[-1], list) else "key"
                    i += 1
                    continue
                if c != ("]" if isinstance(stack[-1], list) else "}"):
                    raise ValueError("comma or end expected")
                value, closed = stack.pop(), True
                key.pop()
                i += 1
            del closed
            if not stack:
                top = value
            elif isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                stack[-1][key[-1]] = value
            expect = "next"


def read_json(text: str | None):
    """The JSON object in text, read through any number of string layers, else None."""
    for _ in range(8):
        if not isinstance(text, str):
            break
        source = text.lstrip("﻿")
        try:
            text = json.loads(source)
        except RecursionError:
            try:
                text = _Reader().read(source)
            except (ValueError, RecursionError):
                return None
        except ValueError:
            return None
    return text if isinstance(text, dict) else None


def items_of(value) -> list:
    """Objects and strings of a value that may be a list, a lone item or nothing."""
    if isinstance(value, (dict, str)):
        return [value]
    if not isinstance(value, list):
        return []
    if all(isinstance(x, (dict, str)) for x in value):
        return value
    out, stack = [], [iter(value)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, (dict, str)):
                out.append(x)
            elif isinstance(x, list):
                stack.append(iter(x))
                break
        else:
            stack.pop()
    return out


def parts_of(doc: dict) -> list[tuple[str, object]]:
    parts: list[tuple[str, object]] = [("body", doc.get("body"))]
    for k, annex in enumerate(items_of(doc.get("annexes")), 1):
        parts.append((f"annex_{k}", annex.get("body") if isinstance(annex, dict) else None))
    return parts


def number_nodes(doc: dict) -> list[list]:
    """[part, node_id, post_id, last_id, parent_id, ord, depth, node] in pre-order, for one document."""
    rows: list[list] = []
    post = 0
    for part, body in parts_of(doc):
        top = items_of(body)
        # a frame: items, next index, parent's row
        stack: list[list] = [[top, 0, None]]
        while stack:
            frame = stack[-1]
            items, at, parent = frame
            if at == len(items):
                stack.pop()
                if parent is not None:
                    post += 1
                    parent[2], parent[3] = post, len(rows)
                continue
            frame[1] = at + 1
            node = items[at]
            row = [part, len(rows) + 1, 0, 0, parent[1] if parent else 0, at + 1, len(stack), node]
            rows.append(row)
            stack.append([items_of(node.get("children")) if isinstance(node, dict) else [], 0, row])
    return rows


def _word(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _map(df: DataFrame, key: str, text: bool) -> DataFrame:
    source = df.select(F.col(key).alias("_id"), F.col("tree").alias("_tree")).filter("_tree is not null")
    # records delivered twice go before they are parsed, or afterwards where labels are less than the text; the hash tells apart records
    # whose id is NULL
    source = source.withColumn("_hash", F.xxhash64("_tree"))
    if text:
        source = source.dropDuplicates(["_id", "_hash"])
    kind = dict(source.dtypes)["_id"]
    schema = f"_id {kind}, _hash bigint, {_NODE}" + (f", {_TEXT}" if text else "")
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, trees, hashes = (batch.column(i).to_pylist() for i in range(3))
            cols: list[list] = [[] for _ in range(15 if text else 9)]
            for record, tree, h in zip(ids, trees, hashes):
                doc = read_json(tree)
                if doc is None:
                    continue
                for row in number_nodes(doc):
                    node = row.pop()
                    values = [record, h, *row]
                    if text:
                        if isinstance(node, dict):
                            quoted = node.get("quoted")
                            values += [_word(node.get(k)) for k in ("type", "num", "path", "label", "text")]
                            values.append(quoted if isinstance(quoted, bool) else None)
                        else:
                            values += [None, None, None, None, node, None]
                    for c, v in zip(cols, values):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield _batch(cols, id_type, text)
                    cols = [[] for _ in cols]
            yield _batch(cols, id_type, text)

    out = source.mapInArrow(run, schema)
    return (out if text else out.dropDuplicates(["_id", "_hash", "node_id"])).drop("_hash").withColumnRenamed("_id", key)


def _batch(cols: list[list], id_type: pa.DataType, text: bool) -> pa.RecordBatch:
    names = ["_id", "_hash", "act_part", "node_id", "post_id", "last_id", "parent_id", "ord", "depth"]
    types = [id_type, pa.int64(), pa.string()] + [pa.int32()] * 6
    if text:
        names += ["type", "num", "path", "label", "text", "quoted"]
        types += [pa.string()] * 5 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def label_nodes(trees: DataFrame, key: str = "tree_id") -> DataFrame:
    """Interval labels of every node, without texts: key, act_part, node_id, post_id, last_id, parent_id, ord, depth."""
    return _map(trees, key, text=False)


def node_rows(trees: DataFrame, key: str = "tree_id") -> DataFrame:
    """label_nodes with type, num, path, label, text and quoted of every node; a bare string is text without a type."""
    return _map(trees, key, text=True)


def node_table(nodes: DataFrame, kind: str | None) -> DataFrame:
    """The table of one unit type (None: nodes without a type)."""
    return nodes.filter(F.col("type").eqNullSafe(F.lit(kind)))


def _levels(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Beginnings of outer nodes and the inner nodes between them, with the number of outer nodes open there (level).

    Intervals of nodes are disjoint or one in the other, so a running sum of beginnings and ends along a record counts the open ones.
    A record was one row, so its nodes fit into a window.
    """
    event = lambda df, place, order, change, depth: df.select(
        key, place.alias("place"), F.lit(order).alias("order"), F.lit(change).alias("change"), F.col("node_id").alias("id"), depth.alias("depth"))
    spans = outer.select(key, "node_id", "last_id", "depth").distinct()
    events = (
        event(spans, F.col("last_id") + 1, 0, -1, F.col("depth")).unionByName(event(inner.select(key, "node_id", "depth").distinct(), F.col("node_id"), 1, 0, F.col("depth")))
        .unionByName(event(spans, F.col("node_id"), 2, 1, F.col("depth")))
    )
    so_far = Window.partitionBy(key).orderBy("place", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("level", F.sum("change").over(so_far)).filter("change >= 0 and level > 0")


def _holding(rows: DataFrame, key: str) -> DataFrame:
    """Inner nodes with the outer node that is open at their level: the last one that began there."""
    before = Window.partitionBy(key, "level").orderBy("place", "order").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("change") == 1, F.struct("id", "depth")), ignorenulls=True).over(before)
    return rows.withColumn("_outer", last).filter("change = 0")


def contained(outer: DataFrame, inner: DataFrame, key: str = "tree_id") -> DataFrame:
    """Pairs of an outer and an inner node by interval containment, within one record: key, outer_id, inner_id, outer_depth, inner_depth.

    An inner node is looked up once for each outer node that is open there, so no more rows are made than pairs come out.
    """
    rows = _levels(outer, inner, key)
    each = rows.withColumn("level", F.explode(F.when(F.col("change") == 0, F.sequence(F.lit(1).cast("long"), F.col("level"))).otherwise(F.array("level"))))
    return _holding(each, key).select(key, F.col("_outer.id").alias("outer_id"), F.col("id").alias("inner_id"), F.col("_outer.depth").alias("outer_depth"), F.col("depth").alias("inner_depth"))


def nearest_outer(outer: DataFrame, inner: DataFrame, key: str = "tree_id") -> DataFrame:
    """For every inner node its innermost enclosing outer node: key, inner_id, outer_id."""
    return _holding(_levels(outer, inner, key), key).select(key, F.col("id").alias("inner_id"), F.col("_outer.id").alias("outer_id"))


def annex_rows(trees: DataFrame, key: str = "tree_id") -> DataFrame:
    """One row per annex of a record: key, annex_no, heading."""
    source = trees.select(F.col(key).alias("_id"), F.col("tree").alias("_tree")).filter("_tree is not null")
    kind = dict(source.dtypes)["_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for record, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, annex in enumerate(items_of((read_json(tree) or {}).get("annexes")), 1):
                    heading = annex.get("heading") if isinstance(annex, dict) else annex
                    for c, v in zip(out, (record, k, _word(heading))):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(out, (id_type, pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "annex_no", "heading"])

    found = source.mapInArrow(run, f"_id {kind}, annex_no int, heading string")
    return found.distinct().withColumnRenamed("_id", key)
