from pyspark.sql import functions as F

from folioflow.operators import checks

BAG = "k string, token string, n long"


def test_reading_quality(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, text string, kind string")
    ref = df([("a", "Zażółć 12 i 12", "x"), ("b", "tylko tu", "x"), ("c", None, "x"), (None, "bez klucza", "x")])
    hyp = df([("a", "zazolc 12 I 13", "x"), ("c", "", "x")])
    got = {(r.k, r.kind): (r.ref, r.hyp, r.common) for r in checks.reading_quality(ref, hyp, "k").collect()}
    assert got == {("a", "whole"): (4, 4, 2), ("a", "plain"): (4, 4, 3), ("a", "number"): (2, 2, 1)}
    assert checks.reading_quality(ref.limit(0), hyp, "k").count() == 0


def test_tools_and_notes(spark):
    ref = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], BAG)
    one, two = spark.createDataFrame([("a", "x", 1)], BAG), spark.createDataFrame([("b", "x", 3), ("z", "q", 9)], BAG)
    got = {r.tool: (r.items, r.ref, r.hyp, r.common) for r in checks.tool_comparison(ref, {"one": one, "two": two, "none": one.limit(0)}, "k").collect()}
    assert got == {"one": (1, 3, 1, 1), "two": (1, 1, 3, 1)}
    notes = spark.createDataFrame([("a", "x", 3), ("a", "p", 1), ("a", "q", 1), ("a", "r", 1)], BAG)
    blocks = spark.createDataFrame([("a", "p", 1)], BAG)
    assert {(r.token, r.n, r.place) for r in checks.note_diagnosis(notes, ref.unionByName(two), blocks, "k").collect()} == {("x", 1, "other"), ("p", 1, "block"), ("q", 1, "other"), ("r", 1, "nowhere")}


def test_articles_and_indices(spark):
    nums = lambda *n: spark.createDataFrame([("a", x) for x in n] * 2, "k string, num string")
    got = {r.num: r["class"] for r in checks.article_check(nums("1", "2", "5", "6"), nums("1", "3", "4", "6"), nums("1", "3", "7", "5"), "k").collect()}
    assert got == {"1": "agreed", "2": "tree_only", "3": "tree_error", "4": "reference_only", "5": "confirmed_by_layer", "6": "confirmed_by_reference", "7": "layer_only"}
    texts = lambda *t: spark.createDataFrame([("a", x) for x in t], "k string, text string")
    row = checks.index_check({"one": texts("§ §", None), "two": texts("§", "§")}, {"s": "§"}, "k").first()
    assert (row.kind, row.one, row.two, row.agreeing, row.differing) == ("s", 2, 2, 1, 0)


def test_first_tokens_and_budget(spark):
    texts = spark.createDataFrame([("a", i, f"t{i} u{i}") for i in range(200)] + [("b", 1, None), ("c", None, "x " * 300)], "k string, seq int, text string")
    got = {r.k: r.tokens for r in checks.first_tokens(texts, "k", ["seq"]).collect()}
    assert got["a"] == [f"{c}{i}" for i in range(50) for c in "tu"] and len(got["c"]) == 100 and got["b"] == []
    plan = spark.createDataFrame([(i, None if i == 3 else 5) for i in range(10)], "id long, pages int")
    assert sorted(r.id for r in checks.within_budget(plan, ["id"], F.col("pages"), 12).collect()) == [0, 1, 2]
    assert sorted(r.id for r in checks.within_budget(plan, ["id"], F.col("pages"), 1000, 4).collect()) == [0, 1, 2, 3]
    assert checks.within_budget(plan.limit(0), ["id"], F.col("pages"), 9).count() == 0


def test_tree_strings(spark):
    nodes = spark.createDataFrame([(1, "art", None, "dwa słowa"), (1, None, "", "raz"), (None, "pkt", "1", None)], "tree_id long, type string, num string, text string")
    assert {(r.tree_id, r.field, r.strings, r.words) for r in checks.tree_strings(nodes, "tree_id", ["type", "num", "text"]).collect()} == {(1, "type", 1, 1), (1, "text", 2, 3), (None, "type", 1, 1), (None, "num", 1, 1)}
