import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.splitting import split_groups, split_texts


def make(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(["słowo", "ab", "x" * rng.randint(1, 30), "😀é"]) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "\n\n", "; ", ""])
    return out[:n]


def test_texts(spark):
    rng = random.Random(5)
    texts = {i: make(rng, rng.choice([1, 50, 199, 200, 201, 399, 1000, 5000])) for i in range(40)}
    texts |= {100: "y" * 1234, 101: " " * 777, 102: "\n" * 555, 103: None, 104: ""}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()] * 2, "id long, text string, piece_no string")
    rows = split_texts(df, "id", limit=200, overlap=30).orderBy("id", "piece_no").collect()
    for k, text in texts.items():
        own = [r for r in rows if r.id == k]
        assert "".join(r.text[r.overlap_chars :] for r in own) == (text or "")
        assert [r.piece_no for r in own] == list(range(1, len(own) + 1))
        assert all(len(r.text) <= 200 for r in own)
        assert (len(own) > 1) == (len(text or "") > 200)
        for a, b in zip(own, own[1:]):
            assert a.text.endswith(b.text[: b.overlap_chars]) and 0 < b.overlap_chars <= 30
    plain = [r for r in rows if r.id == 100]
    assert all(r.overlap_chars == 30 for r in plain[1:])


def test_boundaries(spark):
    text = "a" * 90 + ". " + "b" * 50 + "\n\n" + "c" * 20 + ", " + "d" * 300
    df = spark.createDataFrame([(1, text)], "id long, text string")
    first, *_ = split_texts(df, "id", limit=200, overlap=10).orderBy("piece_no").collect()
    assert first.text.endswith("\n\n")
    with pytest.raises(ValueError):
        split_texts(df, "id", limit=10, overlap=5)


def test_groups(spark):
    rng = random.Random(6)
    blocks, expected = [], {}
    for g, n in (("a", 40), ("b", 3), ("c", 200), ("d", 1)):
        own = [(g, i, 1000 * (ord(g) - 96) + i, make(rng, rng.choice([5, 120, 260, 700])).strip("\n") or "x") for i in range(n)]
        blocks += own
        expected[g] = "\n\n".join(t for *_, t in own)
    blocks += [("a", 500, 1, None), (None, 1, 2, "x" * 5000), ("e", None, 3, "no order " * 300)]
    expected["e"] = "no order " * 300
    rng.shuffle(blocks)
    df = spark.createDataFrame(blocks + blocks[:50], "doc string, seq int, id long, text string")
    for span in (7, 2048):
        check_groups(split_groups(df, "doc", "seq", "id", limit=1000, overlap=40, span=span).orderBy("doc", "piece_no").collect(), df, expected, span)
    assert split_groups(df.limit(0), "doc", "seq", "id").count() == 0


def check_groups(rows, df, expected, span):
    total = {r.doc: r.n for r in df.distinct().groupBy("doc").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {r.doc for r in rows} == {g for g, n in total.items() if g and n > 1000}
    for g in {r.doc for r in rows}:
        own = [r for r in rows if r.doc == g]
        joined = "".join(r.text[r.overlap_chars :] for r in own)
        assert joined == expected[g] if span > 1000 else joined.replace("\n", "") == expected[g].replace("\n", "")
        assert all(len(r.text) <= 1000 for r in own)
        assert all(a.text.endswith(b.text[: b.overlap_chars]) and b.overlap_chars for a, b in zip(own, own[1:]))
        assert [r.piece_no for r in own] == list(range(1, len(own) + 1))


def test_group_boundaries(spark):
    # a paragraph end near the limit is taken rather than the last sentence end before it
    texts = ["a" * 400, "b" * 480, "Zdanie. " * 60]
    df = spark.createDataFrame([("g", i, i, t) for i, t in enumerate(texts)], "doc string, seq int, id long, text string")
    first, *_ = split_groups(df, "doc", "seq", "id", limit=1000, overlap=10).orderBy("piece_no").collect()
    assert first.text == texts[0] + "\n\n" + texts[1] + "\n\n"


def test_only_cut(spark):
    df = spark.createDataFrame([(1, "x" * 200), (2, "x" * 201), (3, None)], "id long, text string")
    assert {r.id for r in split_texts(df, "id", limit=200, overlap=10, only_cut=True).collect()} == {2}
