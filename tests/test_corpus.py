import random
import statistics

from pyspark.sql import functions as F

from folioflow.common import previous, running_sum
from folioflow.functions import text as t
from folioflow.functions.languages import guess
from folioflow.operators import catalog, markdown, measures, sampling
from folioflow.plans import corpus


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_text(spark):
    assert column(spark, ["Żółw é5_x", None, ""], t.tokens) == [["żółw", "é5_x"], None, []]
    assert column(spark, ["art. 5² a[^1]"], t.evaluation_tokens) == [["art", "5", "2", "a"]]
    assert column(spark, ["tytuł\tzob. x", "a  "], t.clean_title) == ["tytuł", "a"]
    got = column(spark, ["DU/2020/5", "https://x/MP/1999/12/", "XX/1/2", "DU/2020/99999999999"], t.act_id)
    assert [tuple(x) if x else None for x in got] == [("DU", 2020, 5), ("MP", 1999, 12), None, ("DU", 2020, None)]
    assert column(spark, ["kot", "tok"], t.letters_key) == ["kot", "kot"]
    assert column(spark, ["Łódź,  2-go"], t.plain_form) == ["LODZ 2 GO"]
    assert column(spark, ["# A\n> b[^1] *c*"], t.strip_markup) == ["A\nb c"]
    assert column(spark, ["# a", "> b", "c"], t.escape_markup) == ["\\# a", "\\> b", "c"]
    assert column(spark, ["XIV", "IIII", "", "mcmxc"], t.roman_value) == [14, None, None, 1990]
    assert [str(x) for x in column(spark, ["z dnia 9 stycznia 1992 r.", "31 lutego 2000", "brak"], t.written_date)] == ["1992-01-09", "None", "None"]
    pairs = spark.createDataFrame([("doku-", "menty"), ("biało-", "-czerwony"), ("a", "b"), ("A-", "b")], "l string, r string")
    assert [r.x for r in pairs.select(t.join_lines(F.col("l"), F.col("r")).alias("x")).collect()] == ["dokumenty", "biało-czerwony", "a b", "A- b"]


def test_language(spark):
    texts = ["nie jest to dla nas oraz przez to się", "the law of the land is to be for all", "der und die das ist", "x y z", "się nie oraz"]
    assert column(spark, texts, lambda v: guess(t.tokens(v))) == ["pl", "en", "de", "?", "?"]


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *range(60)]), i, rng.randint(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, seq int, id int, v int")
    want, prev, state = {}, {}, {}
    for k, s, i, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want[i], prev[i] = state.get(k, (0, None))
        state[k] = (want[i] + v, v)
    got = running_sum(df, ["k"], ["seq", "id"], F.col("v"), "at", {"total": F.col("v")}, span=7).collect()
    assert {r.id: r["at"] for r in got} == want and all(r.total == sum(x[3] for x in rows if x[0] == r.k) for r in got)
    assert {r.id: r.p for r in previous(df, ["k"], ["seq", "id"], "v", "p", span=7).collect()} == prev
    assert running_sum(df.limit(0), ["k"], ["seq", "id"], F.col("v"), "at").count() == 0


def test_quantiles(spark):
    rng = random.Random(3)
    groups = {g: [rng.randint(0, 40) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 17), ("d", 100))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v int")
    for r in measures.quantiles(df, "g", F.col("v")).collect():
        v = sorted(groups[r.g])
        assert (r.n, r.least, r.most, r.q1, r.q3) == (len(v), v[0], v[-1], v[len(v) // 4], v[3 * len(v) // 4]) and r["median"] == statistics.median(v)
    r = measures.bootstrap_median(df, "v").first()
    assert r.low <= r["median"] <= r.high and r.replicates == 200


def test_bootstrap(spark, tmp_path):
    """The query takes 10,000 resamples; the interval is that of plain resampling."""
    rng = random.Random(7)
    for n in (40, 41):
        v = [rng.choice([rng.randint(0, 30), rng.randint(100, 900)]) for _ in range(n)]
        medians = sorted(statistics.median(rng.choices(v, k=n)) for _ in range(10_000))
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "n_chars int")
        df.write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        r = corpus.bootstrap_length(spark, str(tmp_path / f"{n}")).first()
        assert r.replicates == 10_000
        for got, share in ((r.low, 0.025), (r["median"], 0.5), (r.high, 0.975)):
            assert medians[int((share - 0.01) * 10_000)] <= got <= medians[int((share + 0.01) * 10_000)]
    assert measures.bootstrap_median(df.limit(0), "n_chars").first().replicates == 0


def test_bags(spark):
    a = spark.createDataFrame([(1, "x x y"), (2, "z")], "id int, text string")
    b = spark.createDataFrame([(1, "x y y q"), (3, "w")], "id int, text string")
    bags = measures.token_bag(a, "id"), measures.token_bag(b, "id")
    got = {r.id: (r.ref, r.hyp, r.common, r.kept, r.grounded) for r in measures.bag_overlap(*bags, "id").collect()}
    assert got == {1: (3, 4, 2, 0.666667, 0.5), 2: (1, 0, 0, 0.0, 0.0), 3: (0, 1, 0, 0.0, 0.0)}
    assert {(r.id, r.token, r.n) for r in measures.lost(*bags, "id").collect()} == {(1, "x", 1), (2, "z", 1)}
    total = measures.totals(measures.bag_overlap(*bags, "id").withColumn("g", F.lit("k")), ["g"]).filter("g is null").first()
    assert (total["items"], total.micro_kept) == (3, 0.5)


def test_samples(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one = {r.k for r in sampling.sample(df, "k", 20, "s").collect()}
    taken = sampling.sample(df, "k", 20, "s")
    assert one == {r.k for r in sampling.sample(df.repartition(7), "k", 20, "s").collect()}
    assert not one & {r.k for r in sampling.sample(df, "k", 20, "s", taken).collect()}
    dev, test = sampling.split_sample(df, "k", 30, "s")
    assert dev.count() == test.count() == 30 and dev.join(test, "k").count() == 0
    strata = sampling.stratified(df, "k", F.col("k") % 3, 4, "s").collect()
    assert len(strata) == 12 and {r.stratum for r in strata} == {0, 1, 2}
    rated = spark.createDataFrame([(0.97, False)] * 60 + [(0.5, True)] * 4, "accuracy double, defect boolean")
    assert sampling.acceptance(rated).first().passed and not sampling.acceptance(rated.limit(0)).first().passed


def test_catalog(spark):
    schema = "eli string, change_date string, status string, no_text_pages int, ocr_pages int, image_pages int, image_ocr_pages int"
    known = spark.createDataFrame([("a", "1", "ok", 0, None, 0, None), ("b", "1", "ok", 0, 0, 0, 0), ("c", "1", "error", 0, 0, 0, 0), ("d", "1", "ok", 2, None, 0, 0), ("e", "1", "ok", 2, 0, 0, 0)], schema)
    lists = spark.createDataFrame([(x, d, True, None) for x, d in (("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("e", "1"), ("n", "1"))] + [("h", "1", True, True), ("p", "1", False, None)], "eli string, change_date string, text_pdf boolean, text_html boolean")
    got = {r.eli: r.reason for r in catalog.refresh_reasons(lists, known).collect()}
    assert got == {"a": None, "b": "changed", "c": "failed", "d": "images", "e": None, "n": "new"}
    assert {r.eli: r.reason for r in catalog.refresh_reasons(lists, known, read_images=False, everything=True).collect()}["d"] == "forced"
    merged = catalog.upsert(known.select("eli", "status"), spark.createDataFrame([("a", None), ("z", "ok")], "eli string, status string"))
    assert {(r.eli, r.status) for r in merged.collect()} == {("a", None), ("b", "ok"), ("c", "error"), ("d", "ok"), ("e", "ok"), ("z", "ok")}
    assert {(r.k, r.state) for r in catalog.version_diff(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, v string"), "k", "v").collect()} == {(1, "same"), (2, "changed"), (3, "same"), (4, "added")}

    def convert(text):
        return {"words": len(text.split())}

    rows = catalog.convert_safely(spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string"), "id", "text", convert, "words int").orderBy("id").collect()
    assert (rows[0].words, rows[0].status) == (2, "ok") and rows[1].status == "error" and "AttributeError" in rows[1].error


def test_front_matter(spark):
    df = spark.createDataFrame([("DU/2020/1", 'a "b"', 2020, ["x"], None)], "eli string, title string, act_year int, keywords array<string>, act_type string")
    text = df.select("eli", markdown.front_matter(df).alias("text"))
    assert text.first().text == '---\neli: "DU/2020/1"\ntitle: "a \\"b\\""\nyear: 2020\nkeywords: ["x"]\n---'
    assert {(r.name, r.value) for r in markdown.read_front_matter(text, "eli").collect()} == {("eli", '"DU/2020/1"'), ("title", '"a \\"b\\""'), ("year", "2020"), ("keywords", '["x"]')}


def test_markdown(spark):
    blocks = spark.createDataFrame([("DU/2020/1", 1, "p", "Art. 1. Treść", 0, 0), ("DU/2020/1", 2, "p", "„Art. 2. cytat", 0, 1), ("DU/2020/1", 3, "signature", "Minister: X", 0, 0), ("DU/2020/1", 4, "annex", "Załącznik nr 1", 1, 0), ("DU/2020/1", 5, "scan", "* x", 1, 0), ("DU/2020/1", 6, "p", "", 1, 0)], "doc_id string, seq int, kind string, text string, part int, depth int")
    notes = spark.createDataFrame([("DU/2020/1", 1, "1", "przypis")], "doc_id string, seq int, unique_label string, text string")
    meta = spark.createDataFrame([("DU/2020/1", "Ustawa"), ("DU/2020/9", "bez tekstu")], "eli string, title string")
    got = markdown.to_markdown(blocks, notes, meta).collect()
    assert len(got) == 1
    assert got[0].piece_no == 0 and got[0].text == '---\neli: "DU/2020/1"\ntitle: "Ustawa"\n---\n\n# Ustawa\n\n##### Art. 1.\n\nTreść\n\n„Art. 2. cytat\n\n*Minister: X*\n\n## Załącznik nr 1\n\n> \\* x\n\n[^1]: przypis'
    cut = markdown.to_markdown(blocks, notes, meta, piece=40).orderBy("piece_no").collect()
    assert len(cut) > 2 and "\n\n".join(r.text for r in cut) == got[0].text
