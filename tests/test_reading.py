from pyspark.sql import functions as F

from folioflow.functions.text import tokens
from folioflow.operators import reading as o


def test_repairs_in_text(spark):
    df = spark.createDataFrame([("art. | ust. 2",), ("Poz. |, |",), ("a | b",), ("| i 2",)], "t string").select(o.lone_one(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["art. 1 ust. 2", "Poz. 1, |", "a | b", "| i 2"]
    paras = [("d", 1, 1, "8 5. Rada"), ("d", 1, 2, "7. lista"), ("d", 1, 3, "8 9. dalej"), ("d", 1, 4, "w rozumieniu $ 5 ustawy")]
    p = spark.createDataFrame(paras, "doc_id string, page int, seq int, text string")
    assert [r.text for r in o.section_signs(p).orderBy("seq").collect()] == ["§ 5. Rada", "7. lista", "8 9. dalej", "w rozumieniu § 5 ustawy"]


def words(spark, rows):
    out = [(5, "d", 1, 1, 1, line, k, x, y, 30, 10, c, t) for k, (line, x, y, c, t) in enumerate(rows)]
    return spark.createDataFrame(out, "level int, doc_id string, page int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string")


def test_paragraphs(spark):
    w = words(spark, [(1, 0, 5, 90.0, "Dziennik Urzędowy"), (2, 0, 200, 96.0, "Rada"), (2, 40, 200, 80.0, "doku-"), (3, 0, 215, 95.0, "menty"), (4, 0, 230, 95.0, "dalej."), (5, 0, 300, 95.0, "Nowy"), (6, 0, 315, 95.0, "§ 2. Unit")])
    assert (o.page_summary(w).first().words, o.page_summary(w).first().confidence) == (7, 95.0)
    lines = o.word_lines(w).withColumn("height", F.lit(1000)).withColumn("seq", F.col("line"))
    assert [r.text for r in o.read_paragraphs(lines).orderBy("para").collect()] == ["Rada dokumenty dalej.", "Nowy", "§ 2. Unit"]


def test_choice(spark):
    df = spark.createDataFrame([("d", 1, 0, 80.0), ("d", 1, 1, 80.0), ("d", 2, 0, 80.0), ("d", 2, 3, 80.0), ("d", 3, 0, None), ("d", 3, 2, 50.0)], "doc_id string, page int, attempt int, confidence double")
    assert {(r.page, r.attempt) for r in o.retry_readings(df).collect()} == {(1, 0), (2, 3), (3, 2)}
    assert {(r.page, r.attempt) for r in o.best_reading(df, ["doc_id", "page"], "attempt").collect()} == {(1, 0), (2, 0), (3, 2)}
    assert df.withColumn("words", F.lit(25)).filter(o.usable()).count() == 4
    images = spark.createDataFrame([(bytearray(b"x"), "c", "1"), (bytearray(b"y"), "c", "1")], "content binary, command string, version string")
    cache = o.to_read(images, spark.createDataFrame([], "cache_key string")).filter(F.col("content") == F.lit(b"x")).select("cache_key")
    assert [bytes(r.content) for r in o.to_read(images, cache).collect()] == [b"y"]


def test_gates(spark):
    good = "Rada Ministrów określa przepisy o podatkach oraz opłatach"
    df = spark.createDataFrame([(good,), ("Rys. 5 Rada Ministrów określa",), ("@ # x1 ~ ^ & y2",)], "t string")
    assert [r.g for r in df.select(o.word_gate(tokens(F.col("t")), F.col("t")).alias("g")).collect()] == [True, False, False]
    w = spark.createDataFrame([(["x"] * 79 + ["Dziennik", "Ustaw"],), (["x"] * 78 + ["Dziennik", "Ustaw"],)], "w array<string>")
    assert [r.g for r in w.select(o.old_gazette(F.col("w")).alias("g")).collect()] == [False, True]


def test_columns(spark):
    rows = [("d", 1, x, x + 380.0, 20.0 * k, 20.0 * k + 10, 1000.0, f"{s}{k}") for k in range(8) for s, x in (("l", 100.0), ("r", 505.0))] + [("d", 1, 100.0, 885.0, -20.0, -10.0, 1000.0, "top")]
    df = spark.createDataFrame(rows, "doc_id string, page int, x0 double, x1 double, top double, bottom double, width double, text string")
    split = o.column_split(df)
    assert 480 <= split.first().x <= 505
    assert [r.text for r in o.column_order(df, split).orderBy("seq").collect()] == ["top"] + [f"l{k}" for k in range(8)] + [f"r{k}" for k in range(8)]
    assert o.column_split(df.limit(5)).count() == 0
    assert [r.text for r in o.row_order(df.filter("top < 40 and top >= 0")).orderBy("seq").collect()] == ["l0", "r0", "l1", "r1"]
    pieces = [("d", 1, 0.0, 10.0, 0.0, 10.0, "a"), ("d", 1, 11.0, 20.0, 0.0, 10.0, "b"), ("d", 1, 80.0, 90.0, 0.0, 10.0, "c"), ("d", 1, 0.0, 10.0, 20.0, 30.0, "d"), ("d", 1, 60.0, 70.0, 20.0, 30.0, "e")]
    assert o.join_split_rows(spark.createDataFrame(pieces, "doc_id string, page int, x0 double, x1 double, top double, bottom double, text string")).count() == 5
    pieces += [("d", 1, x, x + 10, 20.0 * k, 20.0 * k + 10, f"{s}{k}") for k in range(2, 6) for s, x in (("l", 0.0), ("r", 60.0))]
    pieces = spark.createDataFrame(pieces, "doc_id string, page int, x0 double, x1 double, top double, bottom double, text string")
    assert {r.text for r in o.join_split_rows(pieces).collect()} == {"a b", "c", "d", "e", *[f"{s}{k}" for k in range(2, 6) for s in "lr"]}


def test_slope(spark):
    rows = [("d", 1, 10.0 + 0.01 * t, float(t)) for t in range(0, 1000, 60)] + [("e", 1, 10.0 + 0.2 * t, float(t)) for t in range(0, 1000, 60)] + [("f", 1, 1.0, 1.0)]
    got = {r.doc_id: round(r.slope, 6) for r in o.deskew_slope(spark.createDataFrame(rows, "doc_id string, page int, x0 double, top double")).collect()}
    assert got == {"d": 0.01, "e": 0.0, "f": 0.0}


def test_word_repair(spark):
    t = spark.createDataFrame([(x,) for x in ("ksiega", "ksiega", "zrodlo", "wdomu", "rada", "ab", "nieznane", "laka")], "word string")
    d = spark.createDataFrame([(x,) for x in ("księga", "źródło", "domu", "rada", "łąka", "laką")], "word string")
    assert {(r.word, r.repaired) for r in o.repair_words(t, d).collect()} == {("ksiega", "księga"), ("wdomu", "w domu")}


def test_act_lines(spark):
    rows = [("d", 1, 1, "koniec. Minister: X 12", 10), ("d", 1, 2, "USTAWA", 10), ("d", 1, 3, "13", 10), ("d", 1, 4, "UCHWAŁA", 10), ("d", 1, 5, "99", 10), ("d", 1, 6, "tekst", 10)]
    got = o.act_lines_of_reading(spark.createDataFrame(rows, "doc_id string, page int, seq int, text string, pos int")).orderBy("seq", "part").collect()
    assert [(r.act, r.text) for r in got] == [(0, "koniec. Minister: X"), (12, "12"), (0, "USTAWA"), (13, "13"), (0, "UCHWAŁA"), (0, "99"), (0, "tekst")]
