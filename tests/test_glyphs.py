from pyspark.sql import functions as F

from folioflow.operators import glyphs as g

SCHEMA = "doc_id string, page int, seq int, text string, fontname string, size double, x0 double, x1 double, top double, bottom double, matrix array<double>, tag string, upright boolean"


def chars(spark, rows):
    """rows: text, x0, x1, and optional changes."""
    out = []
    for i, (text, x0, x1, *more) in enumerate(rows):
        r = {"doc_id": "d", "page": 1, "seq": i, "text": text, "fontname": "F", "size": 10.0, "x0": x0, "x1": x1, "top": 5.0, "bottom": 15.0, "matrix": [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], "tag": None, "upright": True}
        r.update(more[0] if more else {})
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, SCHEMA)


def texts(df):
    return [r.text for r in df.orderBy("seq").collect()]


def test_direction_and_watermark(spark):
    df = chars(spark, [("a", 0.0, 5.0), ("b", 0.0, 5.0, {"matrix": [0.0, 1.0, -1.0, 0.0, 0.0, 0.0]}), ("c", 0.0, 5.0, {"matrix": [-1.0, 0.0, 0.0, -1.0, 0.0, 0.0]}), ("w", 0.0, 5.0, {"matrix": [0.7, 0.7, -0.7, 0.7, 0.0, 0.0], "tag": "Artifact"})])
    assert [r.d for r in df.orderBy("seq").select(g.direction(F.col("matrix")).alias("d")).collect()][:3] == [0, 90, 180]
    assert texts(g.drop_watermarks(df)) == ["a", "b", "c"]
    assert [(r.angle, r["rank"]) for r in g.frames(g.drop_watermarks(df)).orderBy("rank").collect()] == [(0, 1), (90, 2), (180, 3)]


def test_soft_blanks(spark):
    df = chars(spark, [("a", 0.0, 5.0), ("­", 5.0, 8.0), ("b", 5.0, 10.0), (" ", 10.0, 12.5), ("c", 12.6, 17.0)])
    assert texts(g.drop_soft_blanks(df)) == ["a", "b", " ", "c"]


def test_drawn_twice(spark):
    df = chars(spark, [("a", 0.0, 5.0), ("a", 0.2, 5.2), ("a", 0.45, 5.4), ("a", 6.0, 11.0), ("a", 0.1, 5.1, {"size": 7.0}), ("b", 0.0, 5.0)])
    assert [r.seq for r in g.drop_drawn_twice(df).orderBy("seq").collect()] == [0, 2, 3, 4, 5]


def test_text_repairs(spark):
    df = chars(spark, [("xx", 0.0, 1.0, {"fontname": "CambriaMath"}), ("xx", 0.0, 1.0), ("∏", 0.0, 1.0, {"fontname": "TimesPL"}), ("∏", 0.0, 1.0), ("𝐀", 0.0, 1.0), ("(cid:3)", 0.0, 1.0), ("ﬁx", 0.0, 1.0)])
    got = df.orderBy("seq").select(g.plain_math(g.mac_polish(g.single_math(F.col("text"), F.col("fontname")), F.col("fontname"))).alias("t")).collect()
    assert [r.t for r in got] == ["x", "xx", "ł", "∏", "A", "(cid:3)", "ﬁx"]
    assert g.unmapped_share(df).first().unusable and g.glyph_survey(df).count() == 3


def test_words_and_sizes(spark):
    df = chars(spark, [("a", 0.0, 5.0), ("b", 5.1, 10.0), ("c", 15.0, 20.0), ("d", 21.1, 25.0, {"fontname": "XPL"}), ("e", 0.0, 5.0, {"top": 30.0})])
    assert [r.word for r in g.words_of(df).orderBy("seq").collect()] == [1, 1, 2, 3, 4]
    sized = chars(spark, [("a", 0.0, 1.0), ("b", 0.0, 1.0, {"size": 10.005}), ("c", 0.0, 1.0), ("d", 0.0, 1.0, {"size": 12.0})])
    assert [r.size for r in g.merged_sizes(sized).orderBy("seq").collect()] == [10.0, 10.0, 10.0, 12.0]
    assert g.clean(sized).count() >= 1 and g.clean(sized.limit(0)).count() == 0


def test_boxes_and_images(spark):
    turned = chars(spark, [("a", 10.0, 20.0, {"matrix": [0.0, 1.0, -12.0, 0.0, 0.0, 0.0]})]).withColumns({"pw": F.lit(100.0), "ph": F.lit(200.0), "baseline": F.lit(0.0)})
    r = g.upright_box(turned).first()
    assert (r.x0, r.x1, r.top, r.bottom, r["size"]) == (185.0, 195.0, 10.0, 20.0, 12.0)
    low = chars(spark, [("a", 0.0, 1.0)]).withColumn("baseline", F.lit(6.0))
    assert abs(g.repaired_box(low).first().bottom - 9.0) < 1e-9
    shapes = spark.createDataFrame([("d", 1, "image", -5.0, 60.0, 0.0, 100.0, 100.0, 100.0), ("d", 1, "rect", 0.0, 9.0, 0.0, 9.0, 100.0, 100.0)], "doc_id string, page int, kind string, x0 double, x1 double, top double, bottom double, pw double, ph double")
    cover = g.images(shapes)
    assert cover.first().cover == 0.6 and cover.first().large
    assert g.text_images(low, cover).first().read and g.hidden_scans(low, cover).count() == 0
    placed = low.withColumns({"placed": F.lit(True), "ph": F.lit(842.0), "min_gray": F.lit(200)})
    assert g.hidden_glyphs(placed).count() == 1


def test_raised_and_lowered_words(spark):
    rows = [("d", 1, 1, 1, "30", 0.0, 12.0, 10.0, 20.0, 10.0), ("d", 1, 1, 2, "f", 12.5, 15.0, 9.0, 15.0, 6.0), ("d", 1, 1, 3, "dalej", 20.0, 40.0, 10.0, 20.0, 10.0), ("d", 1, 2, 4, "CO", 0.0, 12.0, 30.0, 40.0, 10.0), ("d", 1, 2, 5, "2", 12.2, 15.0, 36.0, 42.0, 6.0), ("d", 1, 2, 6, "1", 15.1, 17.0, 36.0, 42.0, 6.0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, row int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [r.text for r in g.index_words(df.filter("row = 1")).orderBy("word_id").collect()] == ["30[f]", "dalej"]
    assert [r.text for r in g.lowered_words(df.filter("row = 2")).orderBy("word_id").collect()] == ["CO₂₁"]
