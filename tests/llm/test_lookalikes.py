import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.lookalikes import Rules, canonical, classes, confusables, find_look_alikes

REGULAR = ["Żółć – „cytat” … m² 5½ x¹⁾ H₂O 3 °C kΩ μm 10 ℃", "нова редакція закону", "ο νόμος ισχύει", "kąt α oraz β, opór 5 Ω", "zob. договір про співпрацю", "a\tb\nc", "Œuvre Æskildbø São"]
CASES = {
    "szcze­pień": "szczepień", "uc​hyla": "uchyla", "﻿A": "A", "w\u00a0odstępach": "w odstępach", "a\u3000b": "a b", "a\u2003b": "a b", "a\u2028b": "a\nb",
    unicodedata.normalize("NFD", "źródło ćmą"): "źródło ćmą", "uchwal̵ę": "uchwałę", "ｚａｗｉａ，": "zawia,", "ﬁskalny": "fiskalny", "nr Ⅰ": "nr I",
    "tаkżе": "także", "οkreśla": "określa", "Αrt. 9": "Art. 9", "zgoda \u043e których": "zgoda o których", "agrе́és": "agréés", "Міnіѕtеr": "Minister", "ѕztаbоwусh": "sztabowych",
}


def test_cases():
    for text in REGULAR:
        assert canonical(text) == (text, set())
    for text, want in CASES.items():
        got, kinds = canonical(f"Rada {text} gminy.")
        assert got == f"Rada {want} gminy." and kinds


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aąbćeęlłoóńśżź ἀλοαсеорİıſﬁ²½Ω​̵̨́ ­Ａ．°C'-"), st.characters(codec="utf-8")), max_size=40))
def test_stable(text):
    once, kinds = canonical(text)
    assert kinds or once == text
    # a second time changes nothing more than whole-text normalisation would
    assert unicodedata.normalize("NFC", canonical(once)[0]) == canonical(unicodedata.normalize("NFC", once))[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeoᄒ한한ো丽̨́︠क़"), st.characters(codec="utf-8")), max_size=30))
def test_changed_texts_are_composed(text):
    found, kinds = canonical(text)
    assert not kinds or unicodedata.is_normalized("NFC", found)


def test_quick_check():
    # jamo, a compatibility ideograph beyond the basic plane, a vowel sign that composes, marks out of order
    for text in ("한", "\U0002f800", "ো", "ą́̂", "ą̂x"):
        assert canonical(f"z {text} z")[0] == unicodedata.normalize("NFC", f"z {text} z")
    kinds = classes()
    import re
    for name, chars in {"form": "\U0002f81aｚℌ", "mark": "ᅡᆨ́া", "space": "\u00a0\u3000", "invisible": "\u00ad\u200b"}.items():
        assert all(re.fullmatch(f"[{kinds[name]}]", c) for c in chars)


def test_other_scripts(spark):
    r = Rules(classes(), confusables(spark))
    assert canonical("Ꭺrt. 5 ꓮkt", r) == ("Art. 5 Akt", {"script"})
    for text in ["ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", *REGULAR]:
        assert canonical(text, r) == (text, set())
    assert len(r.alike) > 150


def test_restored_and_method(spark):
    rows = [(1, "tаkżе"), (2, "Ð°kt a\u0301"), (3, "zwykły"), (4, "a\u0301"), (4, "a\u0301"), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    restored = spark.createDataFrame([("t", 2, "Ð°kt a\u0301", "аkt a\u0301")], "src_table string, row_id long, text string, restored string")
    got = {r.row_id: (r.canonical, r.text) for r in find_look_alikes({"t": (df, "id", "text")}, restored=restored).collect()}
    assert got == {1: ("także", "tаkżе"), 2: ("akt á", "Ð°kt a\u0301"), 4: ("á", "a\u0301")}
    assert {r.row_id for r in find_look_alikes({"t": (df, "id", "text")}, method_only=True).collect()} == {2, 4}


def test_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(REGULAR) if i % 2 else rng.choice(sorted(CASES)), "x") for i in range(60)]
    rows += rows[:8] + [(None, "tаkżе", "x"), (100, None, "x"), (101, "", "x"), (102, "ą" * 200_000 + "​", "x")]
    df = spark.createDataFrame(rows, "block_id long, text string, kinds string")
    known = spark.createDataFrame([("b", 0)], "src_table string, row_id long")
    got = find_look_alikes({"b": (df, "block_id", "text")}, known).collect()
    assert sorted(r.row_id for r in got if r.row_id is not None) == [*range(2, 60, 2), 102]
    assert all(r.canonical == CASES[r.text] for r in got if r.text in CASES)
    assert find_look_alikes({"b": (df.limit(0), "block_id", "text")}).count() == 0
