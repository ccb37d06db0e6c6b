import json
import random

from pyspark.sql import functions as F

from folioflow.operators import nested

SCHEMA = "tree_id long, tree string, eli string, node_id string"


def rows(spark, *trees):
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in trees], SCHEMA)
    found = nested.label_nodes(df).orderBy("tree_id", "node_id").collect()
    return [(r.tree_id, r.act_part, r.node_id, r.parent_id, r.ord) for r in found]


def test_shapes(spark):
    doc = {
        "body": [{"type": "art", "children": ["a", None, {"type": "par", "children": {"type": "pkt"}}]}, None, "b", 7],
        "annexes": [None, {"heading": "h", "body": {"children": "lone"}}, "bare", {"body": None}, {"body": "s"}],
    }
    expected = [
        (1, "body", 1, 0, 1), (1, "body", 2, 1, 1), (1, "body", 3, 1, 2), (1, "body", 4, 3, 1), (1, "body", 5, 0, 2),
        (1, "annex_1", 6, 0, 1), (1, "annex_1", 7, 6, 1), (1, "annex_4", 8, 0, 1),
    ]
    assert rows(spark, (1, json.dumps(doc)), (1, json.dumps(doc))) == expected
    assert rows(spark, (1, json.dumps(json.dumps(doc)))) == expected


def test_nothing_from_unreadable(spark):
    assert rows(spark, (1, None), (2, ""), (3, '{"body": [{"type"'), (4, "null"), (5, "[]"), (6, '{"body": null}'), (7, '"text"')) == []
    assert rows(spark) == []


def test_null_ids_stay_apart(spark):
    found = rows(spark, (None, '{"body":["a"]}'), (None, '{"body":["b"]}'), (None, '{"body":["b"]}'))
    assert len(found) == 2


def test_any_depth(spark):
    depth = 30_000
    tree = '{"body":' + '{"children":[' * depth + '"x"' + "]}" * depth + "}"
    found = rows(spark, (1, tree))
    assert len(found) == depth + 1 and found[-1] == (1, "body", depth + 1, depth, 1)
    assert rows(spark, (1, tree[:-1])) == []


def test_intervals_are_containment(spark):
    doc = {"body": [{"type": "art", "children": [{"type": "pkt", "children": [{"type": "lit"}, {"type": "pkt"}]}]}, {"type": "art", "children": [{"type": "pkt"}]}]}
    nodes = nested.node_rows(spark.createDataFrame([(1, json.dumps(doc))], "tree_id long, tree string"))
    got = {(r.inner_id, r.outer_id) for r in nested.nearest_outer(nested.node_table(nodes, "art"), nested.node_table(nodes, "pkt")).collect()}
    assert got == {(2, 1), (4, 1), (6, 5)}
    assert nested.contained(nodes, nodes).count() == 3 + 2 + 1
    posts = [r.post_id for r in nodes.orderBy("node_id").collect()]
    assert posts == [4, 3, 1, 2, 6, 5]
    assert nodes.filter(F.col("last_id") < F.col("node_id")).count() == 0


def test_text_fields(spark):
    doc = {"body": ["s", {"num": 5, "text": None, "quoted": True, "type": "art", "extra": [1]}], "annexes": {"heading": "H", "body": []}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "tree_id long, tree string")
    a, b = nested.node_rows(df).orderBy("node_id").collect()
    assert (a.type, a.text) == (None, "s") and (b.type, b.num, b.text, b.quoted) == ("art", "5", None, True)
    assert [tuple(r) for r in nested.annex_rows(df).collect()] == [(1, 1, "H")]


def test_intervals_equal_all_pairs(spark):
    rng = random.Random(3)

    def node(depth):
        return {"type": rng.choice(["art", "pkt", "lit", None]), "children": [node(depth + 1) for _ in range(rng.choice([0, 0, 1, 3]) if depth < 7 else 0)]}

    trees = [(k, json.dumps({"body": [node(0) for _ in range(4)], "annexes": [{"body": [node(0)]}]})) for k in range(25)] + [(None, json.dumps({"body": [node(0)]}))]
    nodes = nested.node_rows(spark.createDataFrame(trees, "tree_id long, tree string")).cache()
    outer, inner = nested.node_table(nodes, "art"), nested.node_table(nodes, "pkt").unionByName(nested.node_table(nodes, "art"))
    rows = [r for r in nodes.collect() if r.tree_id is not None]
    pairs = {(a.tree_id, a.node_id, b.node_id, a.depth, b.depth) for a in rows for b in rows if a.type == "art" and b.type in ("art", "pkt") and a.tree_id == b.tree_id and a.node_id < b.node_id <= a.last_id}
    assert {tuple(r) for r in nested.contained(outer, inner).filter("tree_id is not null").collect()} == pairs
    innermost = {}
    for t, a, b, *_ in pairs:
        innermost[t, b] = max(a, innermost.get((t, b), 0))
    assert {(r.tree_id, r.inner_id): r.outer_id for r in nested.nearest_outer(outer, inner).filter("tree_id is not null").collect()} == innermost
