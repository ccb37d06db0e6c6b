import random

import pytest

from folioflow.llm.packing import Packer, fill_report, pack_tokens
from folioflow.llm.tokens import VOCABULARY, cut, encoding


def test_packer_against_search():
    rng = random.Random(1)
    packer, free, closed = Packer(100, 5), {}, set()
    for _ in range(3000):
        size = rng.randint(1, 100)
        fits = {w: f for w, f in free.items() if f >= size}
        w = packer.add(size)
        if fits:
            assert w in fits and fits[w] == min(fits.values())
        else:
            assert w not in free and w not in closed
            if len(free) == 5:
                fullest = min(free.values())
                gone = set(free) - packer.open()
                assert len(gone) == 1 and free[next(iter(gone))] == fullest
                closed |= gone
                free.pop(next(iter(gone)))
            free[w] = 100
        free[w] -= size
        if not free[w]:
            del free[w]
        assert packer.open() == set(free)


@pytest.mark.parametrize("text", ["słowo inne, " * 4000, "x" * 30000, "   \n\n  " * 3000, "漢字😀" * 3000, "a b" + "ż" * 9000 + " koniec zdania."])
def test_cut(text):
    enc = encoding(VOCABULARY)
    pieces = cut(enc, text, 512)
    assert [a for a, _, _ in pieces] == [0, *[b for _, b, _ in pieces[:-1]]] and pieces[-1][1] == len(text)
    assert all(len(enc.encode_ordinary(text[a:b])) == n <= 512 for a, b, n in pieces)


def test_whole_table(spark):
    rng = random.Random(2)
    enc = encoding(VOCABULARY)
    rows = [(i, " ".join(rng.choice(["akt", "ustawa", "§ 5"]) for _ in range(rng.choice([1, 20, 90, 300, 3000]))), "x") for i in range(400)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "akt", "x"), (1002, "akt", "x"), (None, "akt", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(7)
    for merge in (50_000, 20):
        packed = pack_tokens(df, capacity=512, windows=8, merge_size=merge)
        got = packed.collect()
        texts = {r[0]: r[1] for r in rows}
        assert sum(len(enc.encode_ordinary(t or "")) for _, t, _ in rows) == sum(r.tokens for r in got)
        space, pieces = {}, {}
        for r in got:
            assert (r.container_id is None) == (not texts[r.doc_id])
            if r.container_id is not None:
                space[r.container_id] = space.get(r.container_id, 0) + r.tokens
                pieces.setdefault(r.doc_id, []).append((r.start, r.end))
        assert max(space.values()) <= 512
        for i, own in pieces.items():
            if i != 1002:
                assert "".join(texts[i][a:b] for a, b in sorted(own)) == texts[i]
                assert len(own) == 1 or len(enc.encode_ordinary(texts[i])) > 512
        report = fill_report(packed, 512).first()
        assert report.containers == len(space) and report.unused < 0.1
    assert pack_tokens(df.limit(0)).count() == 0 and fill_report(pack_tokens(df.limit(0))).first().unused is None
