import json

from pyspark.sql import functions as F

from folioflow.operators.incremental import CommitLog
from folioflow.sources import files, html
from folioflow.streaming import refresh


def test_year_lists(spark, tmp_path):
    (tmp_path / "y.json").write_text(json.dumps({"count": 2, "items": [{"ELI": "DU/2020/1", "type": "Ustawa", "year": 2020, "pos": 1, "textPDF": True, "unknown": 5}, {"ELI": "DU/2020/2"}]}))
    rows = files.year_lists(spark, f"{tmp_path}/y.json").orderBy("eli").collect()
    assert [(r.eli, r.act_type, r.act_year, r.text_pdf) for r in rows] == [("DU/2020/1", "Ustawa", 2020, True), ("DU/2020/2", None, None, None)]


def test_catalog_round_trip(spark, tmp_path):
    values = {c: None for c in files.CATALOG} | {"eli": "DU/2020/2", "act_year": 2020, "pos": 10, "title": 'a "b", c', "ocr_pages": 0, "status": "ok"}
    other = values | {"eli": "DU/2020/1", "pos": 9, "ocr_pages": None}
    schema = ", ".join(f"{c} {'int' if c in files.NUMBERS else 'string'}" for c in files.CATALOG)
    df = spark.createDataFrame([tuple(values.values()), tuple(other.values())], schema)
    path = f"{tmp_path}/index.csv"
    for _ in range(2):
        files.write_catalog(df, path)
        got = {r.eli: r for r in files.read_catalog(spark, path).collect()}
        assert got["DU/2020/2"].ocr_pages == 0 and got["DU/2020/1"].ocr_pages is None and got["DU/2020/2"].title == 'a "b", c'
    assert [p.name for p in tmp_path.iterdir()] == ["index.csv"]
    lines = [x for p in sorted((tmp_path / "index.csv").glob("part*")) for x in p.read_text().splitlines()[1:]]
    assert [x.split(",")[0] for x in lines] == ["DU/2020/1", "DU/2020/2"]


def test_recognised_words(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "w.tsv").write_text("\n".join([head, "1\t1\t0\t0\t0\t0\t0\t0\t800\t1000\t-1\t", '5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t96.5\t"Rada', "5\t1\t1\t1\t1\t2\t50\t20\t30\t12\t90\t "]))
    rows = files.recognised_words(spark, f"{tmp_path}/w.tsv").collect()
    assert [(r.text, r.page_width, r.page_height, r.conf) for r in rows] == [('"Rada', 800, 1000, 96.5)]


def test_markdown_files(spark, tmp_path):
    df = spark.createDataFrame([("DU/2020/1", "# A\n\nb"), ("MP/2021/2", "# C")], "doc_id string, text string")
    files.write_markdown(df, f"{tmp_path}/md")
    assert (tmp_path / "md" / "publisher=DU" / "year=2020").is_dir()
    assert {tuple(r) for r in files.read_markdown(spark, f"{tmp_path}/md").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "DU-2020-1.md").write_text("x\ny")
    assert [tuple(r) for r in files.read_markdown(spark, f"{tmp_path}/DU-2020-1.md").collect()] == [("DU/2020/1", "x\ny")]
    files.write_rows(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    assert files.pdf_files(spark, f"{tmp_path}/DU-2020-1.md").first().length == 3
    nodes = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc_id string, node_id int, text string")
    assert json.loads(files.node_json(nodes).first().json) == [{"node_id": 1, "text": "a"}, {"node_id": 2, "text": "b"}]


def test_html(spark):
    page = """<div id="part_1"><p>Jeden<p>Dwa <b>gruby</b><div class="unit" id="part_1-art_2"><h3>Art. 2.</h3><div class="unit quoted" id="part_1-art_9">x</div></div><script>var p = "</p>";</script>
    <span class="footnote">przypis</span></div><div id="part_2"><ul><li>a<li>b</ul></div>"""
    df = spark.createDataFrame([("d", page), ("e", None), ("f", "")], "doc_id string, html string")
    nodes = html.html_nodes(df)
    assert [r.text for r in nodes.filter("tag = 'p'").orderBy("node_id").collect()] == ["Jeden", "Dwa"]
    assert [r.text for r in nodes.filter("tag = 'li'").orderBy("node_id").collect()] == ["a", "b"]
    parts = {r.part: r.text for r in html.reference_texts(nodes).collect()}
    assert parts == {"main": "Jeden Dwa gruby Art. 2. x", "notes": "przypis", "annexes": "a b"}
    assert [(r.path, r.type, r.num) for r in html.html_units(nodes).collect()] == [("art_2", "art", "2")]


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    row = lambda eli, change, day: json.dumps({"eli": eli, "change_date": change, "text_pdf": True, "text_html": False, "received_at": f"2025-01-{day:02d}T00:00:00"})
    (src / "1.json").write_text("\n".join([row("A", "2025-01-01", 1), row("B", "2025-01-01", 1)]))
    state = f"file://{tmp_path}/state"
    run = lambda: refresh.start_refresh(spark, f"file://{src}", state, f"file://{tmp_path}/cp").awaitTermination()
    run()
    (src / "2.json").write_text("\n".join([row("A", "2025-02-01", 3), row("B", "2024-12-01", 4), row("C", "brak", 4)]))
    run()
    log = CommitLog(spark, state)
    got = {r.eli: r.day for r in refresh.committed_listings(log).select("eli", F.date_format(F.timestamp_micros("changed_us"), "yyyy-MM-dd").alias("day")).collect()}
    assert got == {"A": "2025-02-01", "B": "2025-01-01"} and log.latest().version == 2
    # a batch delivered again changes nothing
    again = spark.read.schema(refresh.SCHEMA).json(f"file://{src}/2.json")
    assert refresh.apply_batch(log, again, 1) is None and log.latest().version == 2
    stream = spark.readStream.schema(refresh.SCHEMA).json(f"file://{src}")
    q = refresh.listing_changes(stream).writeStream.outputMode("complete").format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.day)[:10], r.changes) for r in spark.sql("select * from changes").collect()} == {("2025-01-01", 2), ("2025-01-03", 1), ("2025-01-04", 2)}
