import random

from folioflow.llm.subjects import LANGUAGES, _Letters, _Words, assign_subjects, composition, sentence_features

NOUNS = {"sport": "piłka mecz liga trener stadion medal", "taxes": "podatek opłata ulga faktura zeznanie cło", "science": "badanie próbka laboratorium hipoteza pomiar doktorat"}
COMMON = "urząd strona wniosek plan rejestr ocena kierownik termin".split()


def sentence(rng, subject):
    own = rng.sample(NOUNS[subject].split(), 3) if subject else []
    words = own + rng.sample(COMMON, 4) + ["się", "oraz", "nie"]
    rng.shuffle(words)
    return " ".join(words).capitalize() + "."


def test_sentences():
    words, letters = _Words(), _Letters()
    code, got = sentence_features("# Tytuł aktu\nUrząd nie jest zły, por. art. 5 ust. 2 oraz doku-\nmenty. Strona się pyta.\n\nTrzeci", words, letters)
    assert len(got) == 3 and LANGUAGES[code] == "pl"
    assert words["dokumenty"][0] in got[0] and words["pyta"][0] in got[1]
    assert words["tytuł"][0] not in [f for s in got for f in s]


def test_held_out(spark):
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(900):
        main, second = rng.sample(sorted(NOUNS), 2)
        plan = [main] * 9 + [None] * 6 + [second] * rng.choice([0, 0, 1, 6])
        rng.shuffle(plan)
        docs.append((i, " ".join(sentence(rng, s) for s in plan), "clash"))
        treated = [s for s in plan if s]
        truth[i] = {s for s in set(treated) if treated.count(s) >= 0.3 * len(treated)}
    docs += [(1000, None, ""), (1001, "", ""), (1002, "... 12 !", ""), (1003, " ".join(sentence(rng, None) for _ in range(5)), ""), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string").repartition(5)
    s = spark.createDataFrame([(k, "t") for k in NOUNS], "subject string, title_pl string")
    # one label in ten is wrong
    labels = [(i, rng.choice(sorted(truth[i])) if rng.random() > 0.1 else rng.choice(sorted(NOUNS))) for i in range(90)]
    labels = [(i, x.upper() + " ") for i, x in labels] + [(None, "sport"), (5, None), (6, "none such"), (0, labels[0][1])]
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    rows = assign_subjects(d, s, l, dims=8, least_share=0.001, most_share=0.6).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(rows) == len({(r.doc_id, r.subject) for r in rows})
    right = sum(got.get(i) == t for i, t in truth.items())
    assert right >= 0.99 * len(truth)
    assert not {1000, 1001, 1002} & set(got)
    parts = composition(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, subject string")).collect()
    assert {(r.subject, r.documents, r.parts) for r in parts} == {("a", 2, 1.5), ("b", 1, 0.5)}


def test_empty(spark):
    d = spark.createDataFrame([(1, "Coś oraz nic.")], "doc_id long, text string")
    s = spark.createDataFrame([("sport",)], "subject string")
    l = spark.createDataFrame([], "doc_id long, subject string")
    assert assign_subjects(d, s, l).count() == 0
    assert assign_subjects(d.limit(0), s, l).count() == 0
    assert assign_subjects(d, s.limit(0), l).count() == 0


def test_one_sentence_texts(spark):
    """No function word, as many of another language, or one of another language only: the vocabularies decide."""
    english = {"sport": "club match league coach stadium medal", "taxes": "levy charge relief invoice return customs", "science": "trial sample laboratory hypothesis measure doctorate"}
    common = "office party motion plan register rating manager date".split()

    def foreign(rng, subject):
        words = rng.sample(english[subject].split(), 3) + rng.sample(common, 4) + ["the", "shall", "which"]
        rng.shuffle(words)
        return " ".join(words).capitalize() + "."

    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        subject = rng.choice(sorted(NOUNS))
        docs.append((i, " ".join((sentence if i % 2 else foreign)(rng, subject) for _ in range(3)), None))
        labels += [(i, subject)] * (i < 120)
    short = [
        (1001, "Trener wskazuje stadion oraz mecz, to liga the.", None, "sport"),
        (1002, "Urząd ocenia podatek, faktura i ulga.", None, "taxes"),
        (1003, "Urząd ocenia podatek faktura ulga.", "en", "taxes"),
        (1004, "Jeżeli kierownik ocenia hipoteza, to próbka laboratorium doktorat.", "und", "science"),
        (1005, "Kierownik ocenia plan to hipoteza laboratorium doktorat.", None, "science"),
        (1006, "Coach stadium medal office plan.", None, "sport"),
    ]
    docs += [r[:3] for r in short] + [(1007, "Xyz abc.", "pl"), (1008, "Xyz abc.", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    s = spark.createDataFrame([(k,) for k in NOUNS], "subject string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    got = {}
    for r in assign_subjects(d, s, l, dims=8, least_share=0.001, most_share=0.6).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert {i: got.get(i) for i, *_ in short} == {i: {subject} for i, _, _, subject in short}
    assert not {1007, 1008} & set(got)
