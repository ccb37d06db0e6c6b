"""Evaluation passages inside corpus documents.

One Aho-Corasick automaton holds every run of SEED normalised words of the long test items and the
short items as a whole. A document is normalised once and scanned once; exact runs found there are
extended to both sides with furthest-reaching edit paths, so that changed, left out and added words
are counted exactly. Reported offsets are those of the original text.

Why seven words: of 10 q item words (q >= 3) with at most q edits, at least 9 q words stand in at most
q + 1 runs without an edit, so one run has seven words or more.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Letters that have no decomposition into a plain letter and an accent.
_PLAIN = {"ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_BREAK = re.compile("(?<=[^\\W_])[-‐‑¬­][^\\S\\n]*(?:\\n\\s*)?(?=[^\\W_])")


class _Fold(dict):
    """Character table, filled as characters occur: plain lower-case letters and digits, blanks for the rest."""

    def __missing__(self, code: int):
        out = ""
        ch = chr(code)
        if unicodedata.category(ch) not in ("Mn", "Me", "Cf"):
            for c in unicodedata.normalize("NFKD", ch.lower()):
                c = _PLAIN.get(c, c)
                if unicodedata.category(c[0]) not in ("Mn", "Me", "Cf"):
                    out += c if c.isalnum() else " "
            out = out or " "
        self[code] = out
        return out


_FOLD = _Fold()


def normalise(text: str) -> list[str]:
    """Words without case, accents, punctuation, layout and hyphens (a hyphen joins its two sides)."""
    return _BREAK.sub(_joined, text).translate(_FOLD).split()


class _Numbers(dict):
    """Token as it stands between blanks -> numbers of its normalised words, 0 for words of no item."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> tuple[int, ...]:
        get = self.vocabulary.get
        found = tuple([get(w, 0) for w in token.translate(_FOLD).split()])
        if len(self) < 1_000_000 and len(token) < 40:
            self[token] = found
        return found

    def sequence(self, text: str) -> tuple[int, ...]:
        """The numbers of normalise(text)."""
        return tuple([n for token in _BREAK.sub(_joined, text).split() for n in self[token]])


def _joined(m: re.Match) -> str:
    # a hyphen, blanks and the next word in the same line: a suspended compound, not a word cut at a line end
    s = m.group()
    return " " if len(s) > 1 and "\n" not in s else ""


def word_offsets(text: str) -> tuple[list[str], list[int], list[int]]:
    """normalise with the start and end of each word in the original text."""
    out: list[str] = []
    at: list[int] = []
    dropped = [False] * len(text)
    for m in _BREAK.finditer(text):
        if _joined(m) == "":
            for i in range(*m.span()):
                dropped[i] = True
    for i, ch in enumerate(text):
        if not dropped[i]:
            for c in _FOLD[ord(ch)]:
                out.append(c)
                at.append(i)
    joined = "".join(out)
    words, starts, ends = [], [], []
    for m in re.finditer(r"\S+", joined):
        words.append(m.group())
        starts.append(at[m.start()])
        ends.append(at[m.end() - 1] + 1)
    return words, starts, ends


def _reach(a: list[int], i: int, b: list[int], j: int, step: int, most: int) -> list[tuple[int, int]]:
    """For e = 0..most edits: the most words of a that can be aligned from a[i], b[j] on in direction step, and the words of b used."""
    if step < 0:
        a = a[: i + 1][::-1] if i >= 0 else []
        b = b[max(0, j - 2 * len(a) - 1) : j + 1][::-1] if j >= 0 else ()
    else:
        a, b = a[i:], b[j : j + 2 * (len(a) - i) + 2]
    la, lb = len(a), len(b)
    x = 0
    while x < la and x < lb and a[x] == b[x]:
        x += 1
    best = [(x, x)]
    # furthest word of a on each diagonal (words of b used less words of a used)
    front = {0: x}
    for _ in range(most):
        new: dict[int, int] = {}
        for d, x in front.items():
            y = x + d
            if x < la:
                if y < lb and new.get(d, -1) <= x:
                    new[d] = x + 1
                if new.get(d - 1, -1) <= x:
                    new[d - 1] = x + 1
            if y < lb and new.get(d + 1, -1) < x:
                new[d + 1] = x
        if not new:
            break
        top = (-1, 0)
        for d, x in new.items():
            y = x + d
            while x < la and y < lb and a[x] == b[y]:
                x, y = x + 1, y + 1
            new[d] = x
            if (x, -d) > top:
                top = (x, -d)
        front = new
        best.append((top[0], top[0] - top[1]))
    return best


class Items:
    """The automaton of a block of test items. least: words of a passage; share: edits per word, as 1 in share."""

    def __init__(self, items: list[tuple[int, str]], least: int = 30, share: int = 10) -> None:
        self.least, self.share = least, share
        self.vocabulary: dict[str, int] = {}
        self.words: dict[int, list[int]] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normalise(text or "")]
            if not own:
                continue
            self.words[item] = own
            if len(own) < least:
                places.setdefault(tuple(own), []).append((item, 0))
            else:
                for k in range(len(own) - SEED + 1):
                    places.setdefault(tuple(own[k : k + SEED]), []).append((item, k))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in places.items():
            self.automaton.add_word(key, (len(key), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places
        self.numbers = _Numbers(self.vocabulary)

    def leaks(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, item words covered, edits, start, end) of each item that the text leaks; offsets of the original text."""
        if self.empty:
            return []
        seq = self.numbers.sequence(text)
        if not seq:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, tuple[int, int, int, int]] = {}
        words = self.words
        for end, (length, found) in self.automaton.iter(seq):
            start = end - length + 1
            for item, k in found:
                if length == len(words[item]) < self.least:
                    whole.setdefault(item, (length, 0, start, end + 1))
                elif item in hits:
                    hits[item].append((start, k))
                else:
                    hits[item] = [(start, k)]
        for item, own in hits.items():
            if len(own) >= self._needed() and (found := self._extend(item, seq, own)):
                whole[item] = found
        if not whole:
            return []
        _, starts, ends = word_offsets(text)
        return [(item, n, e, starts[a], ends[b - 1]) for item, (n, e, a, b) in sorted(whole.items())]

    def _needed(self) -> int:
        """Seed hits that a passage has at least: words without an edit less six for each run."""
        edits = self.least // self.share
        return max(1, self.least - edits - (SEED - 1) * (edits + 1))

    def _extend(self, item: int, seq: tuple[int, ...], hits: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        own = self.words[item]
        hits.sort(key=lambda h: (h[0] - h[1], h[1]))
        places = [(d - k, k) for d, k in hits]
        diagonals = [x for x, _ in places]
        needed, span = self._needed(), self.least
        few = self.least // self.share
        longest = len(own) // self.share
        covered = (-1, -1, -1)
        for at, (d, k) in enumerate(hits):
            diagonal = d - k
            if covered[0] == diagonal and covered[1] <= k < covered[2]:
                continue
            # q edits in a passage of q * share words leave q * (share - SEED) - SEED + 1 seed hits or more: the hits bound q
            near = bisect_right(diagonals, diagonal + longest) - bisect_left(diagonals, diagonal - longest)
            most = min(longest, (near + SEED - 1) // (self.share - SEED)) if self.share > SEED else longest
            if most <= few:
                inside = sum(bisect_right(places, (x, k + span)) - bisect_left(places, (x, k - span)) for x in range(diagonal - few, diagonal + few + 1))
                if inside < needed:
                    continue
            right = _reach(own, k, seq, d, 1, most)
            left = _reach(own, k - 1, seq, d - 1, -1, most)
            covered = (d - k, k - left[0][0], k + right[0][0] - SEED + 1)
            best = None
            for e1, (x1, y1) in enumerate(left):
                for e2, (x2, y2) in enumerate(right):
                    n, e = x1 + x2, e1 + e2
                    if n >= self.least and e * self.share <= n and (best is None or n > best[0]):
                        best = (n, e, d - y1, d + y2)
            if best:
                return best
        return None


#: Items read to the driver at once, whose automaton takes some 300 MB of every worker (measured: 90 MB a million characters at first,
#: 60 further on); a larger table is taken in blocks, each against all documents.
BLOCK_CHARS = 4_000_000
_loaded: dict[str, Items] = {}


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id",
    least: int = 30, share: int = 10, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents with at least least successive words of an item, at most one in share of them changed, left out or added.

    Output, one row per document and item: doc_key, item_key, words (item words covered), edits, start,
    end (of the passage in the original text). Items of fewer words count only whole and unchanged.
    NULL and empty texts and items leak nothing; documents delivered twice (same id) give one row,
    items too. Other columns are left out. The items are read in blocks of about block_chars
    characters; every block is matched against all documents.
    """
    source = items.select(F.col(item_key).cast("long").alias("i"), F.col("text").alias("t")).filter("i is not null and t <> ''").distinct()
    total = source.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    kind = dict(documents.dtypes)[doc_key]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    texts = documents.select(F.col(doc_key).alias("_id"), F.col("text").alias("_text")).filter("_text <> ''")
    out = None
    for b in range(blocks):
        own = source if blocks == 1 else source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        part = _scan(texts, [tuple(r) for r in own.collect()], kind, id_type, least, share)
        out = part if out is None else out.unionByName(part)
    order = F.struct(F.col("words"), -F.col("edits"), -F.col("start"))
    best = out.groupBy("_id", "item").agg(F.max_by(F.struct("words", "edits", "start", "end"), order).alias("x"))
    return best.select(F.col("_id").alias(doc_key), F.col("item").alias(item_key), "x.*")


def _scan(texts: DataFrame, items: list[tuple[int, str]], kind: str, id_type: pa.DataType, least: int, share: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = Items(shared.value, least, share)
        automaton = _loaded[name]
        names = ["_id", "item", "words", "edits", "start", "end"]
        types = [id_type, pa.int64(), *[pa.int32()] * 4]
        for batch in batches:
            rows = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leak in automaton.leaks(t)]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return texts.mapInArrow(run, f"_id {kind}, item bigint, words int, edits int, start int, end int")
