import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.encodings import decode_spans, find_multibyte_spans, find_wrong_encoding

WORDS = "się książkę właściwych środków żołnierzy ćwiczeń źródło łąka ogłasza określa załączników także obowiązków jeżeli przepisy nie stosuje ustawa rada gmina i w z do São Tîrgan m² 5½ 3 °C".split()


def sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("codec", ["cp1252", "cp1250", "latin-1", "iso8859_2", "cp437"])
def test_round_trip_of_spans(codec):
    text = "§ 5. Jeżeli książka – „łąka” ogłasza São 2½ °C über château"
    damaged = "".join(chr(b) if codec == "latin-1" else lenient(b, codec) for b in text.encode())
    # letters like these tell encodings apart that differ in few bytes
    counts = {c: 100 for c in text.lower()}
    assert decode_spans(damaged, counts)[0] == text
    twice = "".join(lenient(b, "cp1252") for b in "".join(lenient(b, "cp1252") for b in text.encode()).encode())
    assert decode_spans(twice)[0] == text
    assert decode_spans(text) == (text, [])


def lenient(b, codec):
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def test_regular_text_stays():
    for text in ["ŻÓŁĆ ŚĘŁ ĄŻ ÓŁ", "нова редакція закону", "ο νόμος ισχύει", "déjà agréés Œuvrande", "für Äpfel", "漢字", "áé", "x" * 10_000 + "ó"]:
        assert decode_spans(text) == (text, [])


def test_tables(spark):
    # each kind of damage in one row of a hundred: the letters of the corpus must be mostly right
    rng = random.Random(1)
    clean = [sentence(rng) for _ in range(9000)]
    rows, truth = [], {}
    for i, text in enumerate(clean):
        kind = rng.choice([""] * 90 + ["u", "1", "2", "m", "d", "?", "f"]) if any(c in "ąćęłńóśźż" for c in text) else ""
        bad = text
        if kind == "u":
            bad = "".join(lenient(b, "cp1252") for b in text.encode())
        elif kind:
            was, read = {"1": ("cp1250", "cp1252"), "2": ("iso8859_2", "cp1252"), "m": ("mac_latin2", "mac_roman"), "d": ("cp852", "cp1250")}.get(kind, (None, None))
            if was:
                bad = "".join(c if ord(c) < 128 or c in "ãî²½°" else lenient(c.encode(was)[0], read) for c in text)
            else:
                bad = "".join(c if c not in "ąćęłńśźż" else {"?": "?", "f": "�"}[kind] for c in text)
        if bad != text:
            truth[i] = kind
        rows.append((i, bad, "clash"))
    rows += rows[:5] + [(None, None, ""), (15000, "", ""), (15001, "Czy w gmina? Nie. Czy ustawa? nie", "")]
    df = spark.createDataFrame(rows, "line_id long, text string, damage string")
    got = find_wrong_encoding({"a": (df, "line_id", "text")}).collect()
    found = {r.row_id for r in got}
    assert len(got) == len(found) and found <= set(truth) and len(found) >= 0.99 * len(truth)
    right = [r.restored == clean[r.row_id] for r in got if truth[r.row_id] not in "?f"]
    assert sum(right) >= 0.97 * len(right)
    assert all(r.lost == (truth[r.row_id] in "?f") for r in got)
    assert find_wrong_encoding({"a": (df.limit(0), "line_id", "text")}).count() == 0


def damaged(text, codec="cp1252"):
    return "".join(lenient(b, codec) for b in text.encode())


def test_overlong_tokens(spark):
    # a token without blanks is judged by its runs of letters
    rng = random.Random(2)
    clean = [sentence(rng) for _ in range(4000)]
    bad = "(1)".join(WORDS[:9]).translate({ord("ą"): "¹", ord("ś"): "\x9c", ord("ż"): "¿", ord("ę"): "ê"})
    assert len(bad) > 60 and " " not in bad
    df = spark.createDataFrame([*enumerate(clean), (9000, bad)], "line_id long, text string")
    got = find_wrong_encoding({"a": (df, "line_id", "text")}).collect()
    assert [r.row_id for r in got] == [9000] and got[0].restored == "(1)".join(WORDS[:9])


def test_method_alone(spark):
    thrice = damaged(damaged(damaged("książkę żołnierzy")))
    rows = [(1, damaged("źródło łąka")), (2, "źródło"), (3, thrice), (4, "ŸródÅo?"), (5, None), (6, ""), (7, "plain"), (1, damaged("źródło łąka"))]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("restored", F.lit(1))
    got = {r.row_id: r.restored for r in find_multibyte_spans({"t": (df, "id", "text")}).collect()}
    assert got == {1: "źródło łąka", 3: "książkę żołnierzy"}
    assert find_multibyte_spans({"t": (df, "id", "text")}).count() == 2
    assert find_multibyte_spans({"t": (df.limit(0), "id", "text")}).count() == 0
