import random

from pyspark.sql import functions as F

from folioflow.operators import alignment as a
from folioflow.operators import slicing


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        assert a.longest_common(x, y) == lcs(x, y) >= a.matched_in_order(x, y)


def test_scores(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "c", "d"]), (2, None, ["x"]), (3, [], [])], "id int, ref array<string>, hyp array<string>")
    rows = {r.id: r for r in a.in_order_scores(df, ["id"]).collect()}
    assert (rows[1].matched, rows[1].recall, rows[1].precision) == (2, 0.666667, 0.666667) and (rows[2].ref, rows[2].hyp, rows[3].recall) == (0, 1, 0.0)
    assert sorted((r.ref_pos, r.hyp_pos) for r in a.aligned_pairs(df.filter("id = 1"), ["id"]).collect()) == [(-1, 2), (0, 0), (1, -1), (2, 1)]
    assert [(r.kind, r.ref_text, r.hyp_text) for r in a.differences(df.filter("id = 1"), ["id"]).collect()] == [("delete", "b", ""), ("insert", "", "d")]
    other = df.filter("id = 1").withColumn("other", F.array(F.lit("d")))
    assert a.lenient_precision(other, ["id"]).first().precision == 1.0
    noticed = a.mutation_test(df.withColumn("tokens", F.col("ref")), "id").collect()
    assert all(r["items"] == r.noticed for r in noticed)


def test_structure_and_trees(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["c"]], [["a"], ["b"], ["c"]])], "id int, ref array<array<string>>, hyp array<array<string>>")
    r = a.structure_score(df, ["id"]).first()
    assert (r.ref_breaks, r.hyp_breaks, r.common_breaks, r.recall) == (2, 3, 2, 1.0)
    nodes = spark.createDataFrame([(1, 1, "art_1", "raz dwa"), (1, 2, "art_1/ust_1", None), (1, 3, "art_2", "trzy")], "id int, node_id int, path string, text string")
    rows = a.linear_nodes(nodes, F.split("text", " "), ["id"]).orderBy("pos").collect()
    assert [(r.pos, r.token, r.path) for r in rows] == [(0, "raz", "art_1"), (1, "dwa", "art_1"), (2, "trzy", "art_2")]
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, -1)], "id int, ref_pos int, hyp_pos int")
    ref = spark.createDataFrame([(1, "art_1", 0), (1, "art_1/ust_1", 1), (1, "art_2", 2)], "id int, path string, pos int")
    hyp = spark.createDataFrame([(1, "art_1", 0), (1, "art_1/pkt_1", 1)], "id int, path string, pos int")
    r = a.tree_score(ref, hyp, pairs, ["id"]).first()
    assert (r.units, r.same, r.moved, r.missing) == (3, 1, 1, 1)


def test_articles_and_markers(spark):
    cols = "id int, num string, seq int, text string"
    ref = spark.createDataFrame([(1, "1", 1, "a"), (1, "1", 2, "b" * 300), (1, "2", 3, "c"), (1, "3", 4, "d")], cols)
    hyp = spark.createDataFrame([(1, "1", 1, "a"), (1, "1", 2, "b" * 299), (1, "2", 3, "x"), (1, "4", 4, "d")], cols)
    got = {(r.num, r.i): r.state for r in a.article_compare(ref, hyp, ["id"]).collect()}
    assert got == {("1", 1): "identical", ("1", 2): "close", ("2", 1): "differs", ("3", 1): "missing", ("4", 1): "extra"}
    assert {(r.num, r.side) for r in a.number_coverage(ref, hyp, "id").collect()} == {("3", "ours"), ("4", "theirs")}
    x, y = spark.createDataFrame([(1, 3, 1)], "id int, up int, down int"), spark.createDataFrame([(1, 2, 5), (2, 1, 0)], "id int, up int, down int")
    assert {(r.kind, r.ours, r.theirs, r.common) for r in a.marker_counts(x, y, "id", ["up", "down"]).collect()} == {("up", 3, 3, 2), ("down", 1, 5, 1)}
    pairs = [("a b", "ab", "blank"), ("Ab", "ab", "case"), ("zażółć", "zazółc", "accents"), ("a,b", "a.b", "punctuation"), ("art 5", "art 6", "number"), ("a", "b", "short"), ("x", "x", "same"), ("doku-menty", "dokumenty", "hyphen"), ("cztery", "pięć osób", "other")]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("a", "want", a.triage(F.col("a"), F.col("b")).alias("got")).collect())
    tokens = spark.createDataFrame([(1, 0, "art"), (1, 1, "1"), (1, 2, "2"), (1, 3, "x"), (1, 4, "3")], "id int, pos int, token string")
    assert [r.token for r in a.join_numbers(tokens, ["id"]).orderBy("pos").collect()] == ["art", "12", "x", "3"]


def test_title_match(spark):
    lines = [("d", 1, 1, "reszta poprzedniego aktu"), ("d", 1, 2, "ROZPORZĄDZENIE MINISTRA ZDROWIA"), ("d", 1, 3, "z dnia 5 maja 1990 r."), ("d", 1, 4, "w sprawie szczepień"), ("d", 1, 5, "Minister: X"), ("d", 2, 6, "USTAWA"), ("d", 2, 7, "z dnia 7 maja 1990 r."), ("d", 2, 8, "o lasach")]
    df = spark.createDataFrame(lines, "doc_id string, page int, seq int, text string")
    titles = spark.createDataFrame([("d", "Rozporządzenie Ministra Zdrowia z dnia 5 maja 1990 r. w sprawie szczepień")], "doc_id string, title string")
    scores = slicing.title_scores(slicing.header_candidates(df), titles)
    start = slicing.own_start(scores).first()
    assert start.seq == 2
    assert slicing.act_end(df, slicing.own_start(scores)).first().stop_seq == 6
    near = spark.createDataFrame([("d", "Ustawa z dnia 7 maja 1990 r. o lasach")], "doc_id string, title string")
    assert slicing.neighbour_cut(slicing.header_candidates(df), titles, near).first().stop_seq == 6
    same = spark.createDataFrame([("Ustawa z dnia 7 maja 1990 r. o lasach", "USTAWA z dnia 7 maja 1990 r. o lasach", "Ustawa z dnia 8 maja 1990 r. o lasach")], "a string, b string, c string")
    r = same.select(slicing.same_header(F.col("a"), F.col("b")).alias("x"), slicing.same_header(F.col("a"), F.col("c")).alias("y")).first()
    assert r.x and not r.y
