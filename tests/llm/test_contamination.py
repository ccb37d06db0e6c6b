import random

from folioflow.llm import contamination as c
from folioflow.llm.contamination import Items, find_leaks, normalise, word_offsets


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(item, doc):
    if len(item) < 30:
        return any(doc[i : i + len(item)] == item for i in range(len(doc)))
    return any(edits(item[a : a + n], doc) * 10 <= n for n in range(30, len(item) + 1, 10) for a in range(len(item) - n + 1))


def test_normalise():
    assert normalise("Żółw, ﬁsk­us – doku-\n  mentów polsko-niemiecki i pierwszo- i drugo") == [
        "zolw", "fiskus", "dokumentow", "polskoniemiecki", "i", "pierwszo", "i", "drugo"]
    text = "A b-\nc, Ćma"
    words, starts, ends = word_offsets(text)
    assert words == normalise(text) and [text[a:b] for a, b in zip(starts, ends)] == ["A", "b-\nc", "Ćma"]


def test_against_brute_force():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.choice([5, 8, 29, 30, 45, 70]))] for _ in range(24)]
    index = Items([(i, " ".join(w)) for i, w in enumerate(items)])
    agree = 0
    for _ in range(150):
        k = rng.randrange(len(items))
        item = items[k]
        n = rng.randint(min(len(item), 20), len(item))
        a = rng.randint(0, len(item) - n)
        piece = list(item[a : a + n])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 3, 4, 5, 6])):
            at = rng.randrange(len(piece))
            kind = rng.randrange(3)
            if kind == 0:
                piece[at] = "changed"
            elif kind == 1:
                del piece[at]
            else:
                piece.insert(at, rng.choice(words))
        doc = [rng.choice(words) for _ in range(rng.randint(0, 40))] + piece + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        got = {r[0] for r in index.leaks(" ".join(doc))}
        want = {i for i, w in enumerate(items) if brute(w, doc)}
        assert got == want, (got, want)
        agree += bool(want)
    assert 30 < agree < 150


def test_frame(spark):
    passage = " ".join(f"słowo{i}" for i in range(40))
    noisy = passage.upper().replace("Ł", "l").replace(" SlOWO7 ", " SlO-\nWO7 ", 1)
    docs = [(1, "Wstęp. " + noisy + ". Koniec", 5), (1, "Wstęp. " + noisy + ". Koniec", 5), (2, None, 5), (3, "", 5), (4, passage[:150], 5), (5, "krótkie zdanie testowe", 5), (None, "x", 1)]
    items = [(10, passage, "a"), (10, passage, "a"), (11, "Krótkie zdanie", "b"), (12, None, "c"), (13, "", "d")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for block in (10**6, 60):
        rows = sorted((r.doc_id, r.item_id, r.words, r.edits) for r in find_leaks(d, i, block_chars=block).collect())
        assert rows == [(1, 10, 40, 0), (5, 11, 2, 0)]
    hit = find_leaks(d, i).filter("doc_id = 1").first()
    assert docs[0][1][hit.start : hit.end] == noisy
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_numbers_are_those_of_normalised_words():
    rng = random.Random(9)
    pieces = ["Ąbc", "def-", "-\n ", "x\u200by", "5½", "\u00a0", "¬\n", "e\u0301", "ﬁ", ".", " ", "\n", "słowo", "ŁÓDŹ", "\u00ad", "a" * 50]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        words = c.normalise(text)
        numbers = c._Numbers({w: i + 1 for i, w in enumerate(dict.fromkeys(words))})
        assert numbers.sequence(text) == tuple(numbers.vocabulary[w] for w in words)
