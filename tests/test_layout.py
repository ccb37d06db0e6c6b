import random

from pyspark.sql import functions as F

from folioflow.operators import blocks as b
from folioflow.operators import layout, paragraphs

LINES = "line_id long, doc_id string, seq int, page int, y_top double, y_bottom double, x0 double, x1 double, font_size double, text string, pw double, ph double, mark string, right_edge double, line_lead double, band int, col int, act int, old_issue boolean"


def lines(spark, rows, **common):
    """rows: (text, changes)."""
    out = []
    for i, (text, more) in enumerate(rows, 1):
        r = {"line_id": i, "doc_id": "d", "seq": i, "page": 1, "y_top": 20.0 * i, "y_bottom": 20.0 * i + 10, "x0": 70.0, "x1": 400.0, "font_size": 10.0, "text": text, "pw": 595.0, "ph": 842.0, "mark": "", "right_edge": 400.0, "line_lead": 10.0, "band": 0, "col": 0, "act": 0, "old_issue": False}
        r.update(common)
        r.update(more)
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, LINES)


def test_reading_order_and_edges(spark):
    df = lines(spark, [("b", {"col": 1, "y_top": 5.0}), ("a", {"y_top": 9.0}), ("c", {"band": 1, "y_top": 1.0})])
    assert [r.text for r in layout.reading_order(df).orderBy("place").collect()] == ["a", "b", "c"]
    read = lines(spark, [("x", {"y_top": 0.0, "y_bottom": 0.0}), ("y", {"y_top": 0.0, "y_bottom": 0.0})])
    assert [r.text for r in layout.reading_order(read).orderBy("place").collect()] == ["x", "y"]


def test_headers_and_numbers(spark):
    df = lines(spark, [("Dziennik Urzędowy", {}), ("Poz. 5", {}), ("tekst", {}), ("– 2 –", {"page": 2, "y_top": 10.0}), ("dalej", {"page": 2}), ("– 3 –", {"page": 3, "y_top": 400.0}), ("3 Dziennik Urzędowy Nr 4", {"page": 4})])
    assert {(r.line_id, r.role) for r in layout.header_lines(df).collect()} == {(1, "masthead"), (2, "masthead"), (7, "header")}
    assert [(r.line_id, r.after) for r in layout.bare_numbers(df).collect()] == [(4, 5)]
    assert {r.page for r in layout.old_issue(df).filter("old").collect()} == {1, 4}


def test_slices(spark):
    df = lines(spark, [("koniec", {}), ("12", {"act": 12}), ("a", {}), ("b", {}), ("13", {"act": 13}), ("c", {})])
    assert [(r.slice, r.act, r.first_seq, r.last_seq) for r in layout.act_slices(df).orderBy("slice").collect()] == [(0, None, 1, 1), (1, 12, 2, 4), (2, 13, 5, 6)]
    assert [r.seq for r in layout.own_slice(df, F.lit(12)).orderBy("seq").collect()] == [2, 3, 4]
    assert layout.own_slice(df, F.lit(99)).count() == 0


def test_colophon(spark):
    df = lines(spark, [("§ 1. tekst", {}), ("Minister: X", {"page": 2}), ("Wydawca: Kancelaria", {"page": 2}), ("ISSN 1234", {"page": 2})])
    assert layout.colophon_start(df).first().from_seq == 3
    scan = lines(spark, [("§ 1. tekst", {}), ("Minister: X", {}), ("Tłoczono w drukarni", {}), ("cena 5", {})], mark="scan")
    assert layout.scan_colophon_start(scan).first().from_seq == 3
    after = lines(spark, [("Minister: X", {}), ("prenumerata", {}), ("§ 2. tekst", {})], mark="scan")
    assert layout.scan_colophon_start(after).count() == 0 and layout.colophon_start(scan).count() == 0


def test_rows_gutters_bands(spark):
    words = [("d", 1, i, t, t + 10.0, s) for i, (t, s) in enumerate([(10.0, 9.0), (10.4, 9.0), (30.0, 9.0), (30.2, 12.0), (50.0, 9.0)])]
    df = spark.createDataFrame(words, "doc_id string, page int, word_id int, top double, bottom double, size double")
    assert [r.row for r in layout.rows_of_words(df).orderBy("word_id").collect()] == [1, 1, 2, 3, 4]
    parts = [("d", 1, r, x0, x1, 20.0 * r) for r in range(4) for x0, x1 in ((50.0, 290.0), (300.0, 540.0))] + [("d", 1, 9, 50.0, 540.0, 5.0 - 10)]
    rows = spark.createDataFrame(parts, "doc_id string, page int, row int, x0 double, x1 double, top double")
    found = layout.gutters(rows)
    assert (found.first().left, found.first().right, found.first().rows) == (290.0, 300.0, 4)
    assert layout.document_gutter(found).first().right == 300.0
    placed = layout.columns_and_bands(rows, found).orderBy("band", "col", "top").collect()
    assert [(r.band, r.col) for r in placed] == [(1, 0)] + [(2, 0)] * 4 + [(2, 1)] * 4


def test_free_rules_and_notes(spark):
    shapes = [("d", 1, 1, 50.0, 190.0, 600.0, 600.5, 595.0), ("d", 1, 2, 50.0, 190.0, 300.0, 300.5, 595.0), ("d", 1, 3, 190.5, 300.0, 299.0, 301.0, 595.0)]
    df = spark.createDataFrame(shapes, "doc_id string, page int, shape_id int, x0 double, x1 double, top double, bottom double, pw double")
    assert [r.y for r in layout.free_rules(df).collect()] == [600.0]
    body = lines(spark, [("tekst " * 9, {}), ("mały", {"font_size": 8.0, "y_top": 700.0}), ("pod kreską", {"y_top": 610.0})])
    assert {r.text for r in layout.note_zone(body).collect()} == {"mały"}
    assert {r.text for r in layout.note_zone(body, layout.free_rules(df)).collect()} == {"mały", "pod kreską"}


def test_ranges(spark):
    df = spark.createDataFrame([("a", p) for p in (2, 3, 4, 7, 7)] + [("b", 1), ("c", None)], "doc_id string, page int")
    got = layout.page_ranges(df)
    assert {(r.doc_id, r.pages) for r in got.collect()} == {("a", "2-4, 7"), ("b", "1")}
    assert sorted((r.doc_id, r.page) for r in layout.expand_ranges(got).collect()) == [("a", 2), ("a", 3), ("a", 4), ("a", 7), ("b", 1)]
    lists = df.select(layout.trim_pages(F.array(*[F.lit(x) for x in (1, 2, 3)]), F.lit(2), F.lit(2)).alias("p"))
    assert lists.first().p == [2]


def segment(spark, rows, **common):
    return [(r.kind, r.text, r.lines) for r in b.segment(lines(spark, rows, **common)).orderBy("first_line").collect()]


def test_segment(spark):
    tight = lambda i: {"y_top": 14.0 * i, "y_bottom": 14.0 * i + 10}
    got = segment(spark, [("Rada zgłasza doku-", tight(1)), ("menty oraz", tight(2)), ("§ 2. Minister", {"y_top": 60.0, "y_bottom": 70.0}), ("wydaje.", {"y_top": 74.0, "y_bottom": 84.0, "x1": 120.0})])
    assert got == [("p", "Rada zgłasza dokumenty oraz", 2), ("p", "§ 2. Minister wydaje.", 2)]
    pages = segment(spark, [("tekst i", {}), ("dalszy ciąg.", {"page": 2}), ("Nowy", {"page": 3}), ("§ 3. Raz", {"page": 4})])
    assert [t for _, t, _ in pages] == ["tekst i dalszy ciąg.", "Nowy", "§ 3. Raz"]
    kinds = segment(spark, [("tekst.", {}), ("Minister: X", {"x0": 400.0}), ("Załącznik nr 1", {"x0": 400.0}), ("treść", {"mark": "scan"})])
    assert [k for k, _, _ in kinds] == ["p", "signature", "annex", "scan"]
    assert segment(spark, [(None, {}), ("", {})]) == []


def test_segment_stretches(spark, monkeypatch):
    """Any length of the stretches gives the same paragraphs."""
    rng = random.Random(3)
    kinds = [
        ("ciąg dalszy doku-", {}), ("menty i dalej", {}), ("zdanie kończy się.", {"x1": 120.0}), ("§ 4. Jednostka", {}), ("1) punkt", {}), ("Załącznik nr 2", {"x0": 400.0}),
        ("Załącznik nr 3", {}), ("Minister: A", {"x0": 400.0}), ("Prezes: B", {"x0": 100.0}), ("Prezes: C", {"x0": 100.0}), ("  ", {}), (None, {}), ("skan", {"mark": "scan"}),
    ]
    tight = lambda i: {"y_top": 14.0 * i, "y_bottom": 14.0 * i + 10}
    rows = [(t, m | tight(i) | {"page": 1 + i // 25, "seq": None if i < 8 else i - 7}) for i, (t, m) in enumerate(rng.choices(kinds, weights=[9, 9, 2, 2, 2, 1, 2, 2, 3, 3, 1, 1, 2], k=150), 1)]
    # a signature is told by the signature several lines before; a paragraph is longer than a stretch
    rows += [("Minister: X", {"x0": 400.0, "page": 9})] + [("Prezes: Y", {"x0": 100.0, "page": 9})] * 7 + [("Załącznik nr 9", {"x0": 400.0, "page": 9})]
    rows += [(f"wiersz {i} bez końca", tight(i) | {"page": 20}) for i in range(9)]
    df = lines(spark, rows).unionByName(lines(spark, rows[:40], doc_id=None)).repartition(3)
    monkeypatch.setattr(paragraphs, "REACH", 9)
    got = {chunk: sorted(map(tuple, b.segment(df, chunk).collect()), key=repr) for chunk in (1, 50, 2000)}
    assert got[1] == got[2000] and got[50] == got[2000]
    assert {k: sum(r[2] == k for r in got[2000] if r[0] == "d" and r[3] == 9) for k in ("signature", "annex")} == {"signature": 8, "annex": 1}
    assert [r[5] for r in got[2000] if r[3] == 20] == [9]
    assert sum(r[5] for r in got[1]) == sum(bool(t and t.strip()) for t, _ in rows + rows[:40])


def test_parts_and_points(spark):
    rows = [(1, "d", 1, "p", "1) a", 1), (2, "d", 2, "p", "2) b", 1), (3, "d", 3, "annex", "Z", 1), (4, "d", 4, "p", "a) c", 1), (5, "d", 5, "p", "c) d", 1), (6, "d", 6, "signature", "M:", 1)]
    df = spark.createDataFrame(rows + rows[:2], "block_id long, doc_id string, seq int, kind string, text string, page int")
    once = b.once(df)
    assert [r.part for r in b.parts(once).orderBy("seq").collect()] == [0, 0, 1, 1, 1, 1]
    assert {(r.block_id, r.follows) for r in b.point_sequence(once).collect()} == {(1, False), (2, True), (4, False), (5, False)}
    assert {r.kind for r in b.demote_quoted_annex(once).filter("block_id = 3").collect()} == {"p"}
    assert [r.text for r in b.document_text(once).orderBy("place").collect()][:3] == ["1) a", "2) b", "Z"]
    assert spark.createDataFrame([("USTAWA",), ("· UCHWAŁA Nr 5",), ("Ustawa",)], "t string").filter(b.starts_act(F.col("t"))).count() == 2


def test_notes(spark):
    notes = spark.createDataFrame([(1, "d", 1, "¹⁾ a", 1), (2, "d", 2, "1) b", 2), (3, "d", 3, "bez", 2), (4, "d", 4, "a) c", 3)], "footnote_id long, doc_id string, seq int, text string, page int")
    labelled = b.note_labels(notes)
    assert [r.label for r in labelled.orderBy("seq").collect()] == ["1", "1", None, "a"]
    assert {r.unique_label for r in b.number_labels(labelled).collect()} == {"1", "1_2", "a"}
    assert {(r.label, tuple(r.pages)) for r in b.note_pages(labelled).collect()} == {("1", (1, 2)), ("a", (3,))}
    blocks = spark.createDataFrame([(1, "d", "x[^1] y[^a][^b]", 2, 0), (2, "d", "z[^1]", 9, 0), (3, "d", "[^7] w[^7]", 1, 1)], "block_id long, doc_id string, text string, page int, part int")
    refs = b.references(blocks)
    assert {(r.page, r.note_page) for r in b.resolve_pages(refs, notes).collect()} == {(2, 2), (9, 3), (1, 1)}
    assert b.letter_references(blocks, labelled).orderBy("block_id").first().text == "x[^1] y[^a]b)"
    assert b.printed_notes(blocks).filter("block_id = 3").first().text == "⁷⁾ w⁷⁾"
    marked = labelled.withColumn("marked", F.col("footnote_id") == 1)
    assert {r.footnote_id for r in b.plain_labels(marked.filter("label is not null"), refs).collect()} == {1, 4}


def test_group_notes(spark):
    def grouped(*rows, span=8192):
        df = spark.createDataFrame([("d", page, k, t) for k, (page, t) in enumerate(rows)], "doc_id string, page int, seq int, text string")
        return [(r.page, r.label, r.text) for r in paragraphs.group_notes(df, span).orderBy("first_seq").collect()]

    listed = [(1, "1) lista:"), (1, "1) raz"), (1, "2) dwa"), (2, "i dalej"), (2, "2) nowy"), (2, None), (2, " "), (3, "¹²⁾ z figurą"), (3, "*) gwiazdka"), (4, "[^7] znak")]
    want = [(1, "1", "1) lista:\n1) raz\n2) dwa i dalej"), (2, "2", "2) nowy"), (3, "12", "¹²⁾ z figurą"), (3, "*", "*) gwiazdka"), (4, "7", "[^7] znak")]
    assert grouped(*listed) == want and grouped(*listed, span=1) == want
    # a second list after another colon begins anew; a number that doesn't follow opens a note
    again = [(1, "4) ustawa:"), (1, "1) a"), (1, "2) b:"), (1, "1) c"), (1, "2) d"), (1, "5) e")]
    assert [t for *_, t in grouped(*again)] == ["4) ustawa:\n1) a\n2) b:\n1) c\n2) d", "5) e"]
    # letters open notes in sequence, behind an ended note; others are points
    letters = [(1, "[^a] pierwsza."), (1, "b) druga."), (1, "c) trzecia;"), (1, "d) punkt"), (1, "dalej.")]
    assert [t for *_, t in grouped(*letters)] == ["[^a] pierwsza.", "b) druga.", "c) trzecia; d) punkt dalej."]
    assert paragraphs.group_notes(spark.createDataFrame([], "doc_id string, page int, seq int, text string")).count() == 0


def test_segment_rules(spark):
    tight = lambda i, **more: {"y_top": 11.0 * i, "y_bottom": 11.0 * i + 10, "line_lead": 1.0} | more
    # an article right below a heading; a line behind one that was left out; points of a table cell
    assert [t for _, t, _ in segment(spark, [("Rozdział 1 Zmiany", tight(1)), ("w przepisach", tight(2)), ("Art. 5. (pominięty)", tight(3)), ("Art. 6. Treść", tight(4)), ("dalej", tight(5))])] == ["Rozdział 1 Zmiany w przepisach", "Art. 5. (pominięty)", "Art. 6. Treść dalej"]
    assert [t for _, t, _ in segment(spark, [("tekst", tight(1)), ("Art. 6 ustawy", tight(2))])] == ["tekst Art. 6 ustawy"]
    assert [t for _, t, _ in segment(spark, [("1) B1, B2 483", tight(1)), ("2) C", tight(2)), ("3) w tekście", tight(3, x0=90.0))])] == ["1) B1, B2 483", "2) C 3) w tekście"]
    # an annex header goes on in lines on the right below it, and ends with the first other one
    right = {"x0": 400.0}
    got = segment(spark, [("tekst.", {}), ("Minister: X", right), ("Załącznik nr 1", tight(9, **right)), ("do rozporządzenia", tight(10, **right)), ("z dnia", tight(11, **right)), ("treść", tight(12)), ("dalsza", tight(13))])
    assert [(k, t) for k, t, _ in got] == [("p", "tekst."), ("signature", "Minister: X"), ("annex", "Załącznik nr 1 do rozporządzenia z dnia"), ("p", "treść dalsza")]
    # behind a dropped page number only a sentence goes on
    rows = [("koszty tłumaczenia", {}), ("Wiersz tabeli", {"page": 2}), ("dążenia do", {"page": 2, "y_top": 61.0}), ("zmniejszania", {"page": 3})]
    flagged = lines(spark, rows).withColumn("after_number", F.col("line_id").isin(2, 4))
    assert [r.text for r in b.segment(flagged).orderBy("first_line").collect()] == ["koszty tłumaczenia", "Wiersz tabeli", "dążenia do zmniejszania"]
    # empty, blank and repeated lines, lines without an act, extra columns
    odd = lines(spark, [(None, {}), ("", {}), (" ", {}), ("a", {"doc_id": None}), ("b", {"doc_id": None, "seq": None}), ("x" * 200_000, {})]).withColumn("opens", F.lit(1)).withColumn("lines", F.lit("clash"))
    assert sorted((r.doc_id or "", len(r.text)) for r in b.segment(odd.unionByName(odd)).collect()) == [("", 1), ("", 1), ("d", 200_000)]
