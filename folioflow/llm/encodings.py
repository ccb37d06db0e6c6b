"""Text decoded with the wrong character encoding.

Two kinds of damage are undone, and a third is reported:

1. Bytes of a multibyte encoding read as a legacy single-byte one. The characters are mapped back to
   legacy bytes; an automaton over the byte structure finds the maximal well-formed multibyte spans;
   only those spans are decoded, again as long as spans remain (text can be damaged twice).
2. Bytes of one single-byte encoding read as another. Byte structure says nothing here, so the letter
   statistics of the corpus decide: of all pairs of encodings the one is taken that makes the
   row's suspicious words most likely, if they gain enough. This takes most of the corpus for right: a
   kind of damage that touches more than a few of a hundred words passes for a spelling.
3. Characters lost for good: replacement characters, and question marks inside words.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.letters import LONGEST, RUN, Letters, collect_model, letter_counts, plain_token, words_of

#: Single-byte encodings that text is taken for, in order of preference.
READ_AS = ["cp1252", "cp1250", "iso8859_2", "cp437", "cp852", "cp850", "mac_roman", "mac_latin2", "cp1251"]
#: Single-byte encodings that text really was in.
WRITTEN_IN = ["cp1250", "iso8859_2", "cp852", "mac_latin2", "cp1252", "mac_roman", "cp850", "cp437"]

_SPAN = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_LOST = re.compile("�|[^\\W\\d_]\\?+[^\\W\\d_]|(?<![^\\W_])\\?[^\\W\\d_]")
#: A question mark that does not end a sentence: punctuation or a small letter follows.
_LOST_END = re.compile("([^\\W\\d_]+)\\?(?=[,.;:)]|\\s+[^\\W\\d_A-Z]|-[^\\W\\d_])")


def _byte_of(codec: str) -> dict[int, str]:
    """Character code -> byte as a character; control characters of undefined bytes stand for those bytes."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(codec))] = chr(byte)
        except UnicodeDecodeError:
            pass
    for byte in range(0x80, 0xA0):
        table.setdefault(byte, chr(byte))
    return table


class _ToBytes(dict):
    def __init__(self, codec: str) -> None:
        super().__init__(_byte_of(codec))

    def __missing__(self, code: int):
        # a character that the encoding lacks ends every span
        out = code if code < 0x80 else 0x100
        self[code] = out
        return out


_TO_BYTES = {codec: _ToBytes(codec) for codec in READ_AS}


def _span_test() -> re.Pattern:
    """Whether any encoding can have a multibyte span in a text, without mapping the text."""
    parts = []
    for codec in READ_AS:
        two, three, four, more = ("".join(re.escape(chr(c)) for c, b in _byte_of(codec).items() if lo <= b <= hi) for lo, hi in (("\xc2", "\xdf"), ("\xe0", "\xef"), ("\xf0", "\xf4"), ("\x80", "\xbf")))
        parts.append(f"[{two}][{more}]|[{three}][{more}]{{2}}|[{four}][{more}]{{3}}")
    return re.compile("|".join(parts))


_MAY_HAVE_SPAN = _span_test()
#: Bytes of a span are never plain ASCII characters, in no encoding; quick to search.
_PAIR = re.compile("[^\x00-\x7f]{2}")


def _plausible(text: str) -> bool:
    """Decoded characters that texts have: Latin letters, punctuation, usual signs; letters of another script if several stand together."""
    other = 0
    for ch in text:
        code = ord(ch)
        # control characters are bytes of a text that was damaged twice
        if 0x80 <= code <= 0x17F or 0x218 <= code <= 0x21B or code in (0x20AC, 0x2122, 0x1E9E) or 0x2010 <= code <= 0x203A or 0x2070 <= code <= 0x208E:
            continue
        if unicodedata.category(ch)[0] in "LM" and (0x370 <= code <= 0x52F or code in (0x2126,)):
            other += 1
        elif not (0x2150 <= code <= 0x2189 or 0x2190 <= code <= 0x22FF or 0xFB00 <= code <= 0xFB06 or code == 0xFEFF):
            return False
    return other == 0 or other >= 3 or len(text) == other == 1 and text in "µΩαβγδπ"


def decode_spans(text: str, counts: dict[str, int] | None = None) -> tuple[str, list[str]]:
    """Text with all multibyte spans decoded, and the encodings it had been read as, outermost first.

    The encoding with the longest spans is taken; of several, that whose letters counts has more often.
    """
    counts = counts or {}
    used: list[str] = []
    # each round makes the text shorter, so this ends
    while _PAIR.search(text) and _MAY_HAVE_SPAN.search(text):
        best: tuple[tuple[int, float], str, str] | None = None
        for codec in READ_AS:
            raw = text.translate(_TO_BYTES[codec])
            gain, seen, out, at = 0, 0.0, [], 0
            for m in _SPAN.finditer(raw):
                decoded = m.group().encode("latin-1").decode("utf-8")
                if _plausible(decoded):
                    out += [text[at : m.start()], decoded]
                    at = m.end()
                    gain += m.end() - m.start()
                    seen += sum(math.log(counts.get(c.lower(), 0) + 0.5) for c in decoded)
            if gain and (best is None or (gain, seen) > best[0]):
                best = ((gain, seen), codec, "".join(out) + text[at:])
        if best is None:
            break
        used.append(best[1])
        text = best[2]
    return text, used


def _single_byte_pairs() -> list[tuple[str, dict[int, str]]]:
    """(name, table of characters) for each pair of encodings; equal tables once."""
    out: list[tuple[str, dict[int, str]]] = []
    for was in WRITTEN_IN:
        for read in READ_AS:
            if was == read:
                continue
            table = {}
            for code, byte in _byte_of(read).items():
                try:
                    ch = byte.encode("latin-1").decode(was)
                except UnicodeDecodeError:
                    continue
                if ord(ch) != code and chr(code) not in "§°²½" and (ch.isalpha() or not chr(code).isalpha() and ch in "§°²½–„”…’"):
                    table[code] = ch
            if table:
                out.append((f"{was} as {read}", table))
    return out


PAIRS = _single_byte_pairs()


class Repairer:
    """Restores texts by the letter statistics of a corpus."""

    #: A row changes if its best pair gains so much (natural logarithm); a token of it if it gains so much.
    LEAST, EACH = 5.0, 0.7
    #: The same where only signs inside words change (a raised figure for a letter): they need less.
    LEAST_SIGNS = 3.0
    #: Cost from which a letter outside ASCII is looked at.
    ODD = 4.0

    def __init__(self, letters: Letters) -> None:
        self.letters = letters
        self.cache: dict[str, list[tuple[int, str, float, int]]] = {}
        self.ends = [g for g, n in letters.counts.items() if len(g) == 1 and g.isalpha() and not g.isascii() and n > 1e-4 * letters.total]

    def _token(self, token: str) -> list[tuple[int, str, float, int]]:
        """(pair, restored token, gain, changed letters) of each pair of encodings that improves the token."""
        found = self.cache.get(token)
        if found is None:
            # numbers with signs (coordinates, formulas) are no words
            word = not token.isascii() and any(c.isalpha() for c in token) and 4 * sum(c.isdigit() for c in token) < len(token)
            found = self._weigh(token) if word else []
            if len(self.cache) < 1_000_000:
                self.cache[token] = found
        return found

    def _total(self, token: str) -> float:
        # a capital after a small letter is as good as never regular
        mixed = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        return sum(self.letters.costs(plain_token(token))) + 8.0 * mixed

    def _weigh(self, token: str) -> list[tuple[int, str, float, int]]:
        plain = plain_token(token)
        costs = self.letters.costs(plain)
        mixed = any(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        odd = any(c > self.ODD and (not s.isascii()) for s, c in zip(plain, costs))
        odd = odd or any(c > self.ODD and not s.isascii() for s, c in zip(plain, costs[1:])) or len(plain) < len(token.strip("\"'.,;:!?()[]{}<>*_#|/\\-"))
        if not (odd or mixed):
            return []
        before = self._total(token)
        out = {}
        for k, (_, table) in enumerate(PAIRS):
            changed = token.translate(table)
            if changed != token and changed not in out:
                n = sum(a != b for a, b in zip(token, changed))
                gain = before - self._total(changed)
                out[changed] = (k, changed, gain, n)
        return [x for x in out.values() if x[2] > 0]

    def single_byte(self, text: str) -> tuple[str, str | None]:
        """Text restored by the best pair of encodings, and its name; the text itself and None if none is good enough."""
        if text.isascii():
            return text, None
        token_of, seen = self._token, self.cache.get
        tokens = []
        for token in words_of(text):
            if not token.isascii():
                found = seen(token)
                if token_of(token) if found is None else found:
                    tokens.append(token)
        if not tokens:
            return text, None
        # other pairs may change a token alike; they were folded into the first of them, so weigh all again
        labels = {PAIRS[k][0] for t in tokens for k, _, _, _ in token_of(t)}
        best, name = 0.0, None
        for label, table in PAIRS:
            if label not in labels:
                continue
            total, signs = 0.0, True
            for t in tokens:
                changed = t.translate(table)
                gain = next((gain for _, other, gain, _ in token_of(t) if other == changed), 0.0)
                total += gain
                signs = signs and not (gain and any(a != b and a.isalpha() for a, b in zip(t, changed)))
            if total >= (self.LEAST_SIGNS if signs else self.LEAST) and total > best:
                best, name = total, label
        if name is None:
            return text, None
        table = dict(PAIRS)[name]

        def settled(t: str) -> str:
            changed = t.translate(table)
            # the row's encodings are settled; a token follows if it gains at all
            return changed if changed != t and self._total(t) - self._total(changed) >= self.EACH else t

        parts = re.split(r"(\s+)", text)
        for i in range(0, len(parts), 2):
            t = parts[i]
            if not t.isascii():
                parts[i] = settled(t) if len(t) <= LONGEST else RUN.sub(lambda m: settled(m.group()), t)
        return "".join(parts), name

    def _lost(self, text: str) -> bool:
        if _LOST.search(text):
            return True
        for m in _LOST_END.finditer(text):
            # the word is likelier with a letter outside ASCII in this place than as it stands
            word = plain_token(m.group(1)[-LONGEST:])
            if sum(self.letters.costs(word)) > 1.0 + min((sum(self.letters.costs(word + c)) for c in self.ends), default=math.inf):
                return True
        return False

    def repair(self, text: str) -> tuple[str, str | None, bool]:
        """(restored text, how it had been damaged or None, whether characters are lost for good)."""
        lost = ("?" in text or "�" in text) and self._lost(text)
        if text.isascii():
            return text, None, lost
        restored, used = decode_spans(text, self.letters.counts)
        restored, pair = (restored, None) if used else self.single_byte(text)
        how = "; ".join([*(f"utf-8 as {c}" for c in used), *([pair] if pair else [])])
        return restored, how or None, lost


_loaded: dict[str, Repairer] = {}


def _rows(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """src_table, row_id, text of all tables; NULL and empty texts left out."""
    parts = [
        df.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).filter("text <> ''")
        for name, (df, key, text) in sources.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def find_multibyte_spans(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows with multibyte spans that were read as a single-byte encoding: src_table, row_id, text, restored, damage.

    The automaton alone, without statistics of the corpus: rows in which one single-byte encoding was read as another and rows
    with characters lost for good have no such spans and are not found. NULL and empty texts have none; rows delivered
    twice (same id and text) give one row; other columns are left out.
    """
    # a span has two neighbours outside ASCII in any encoding; other rows stay in the JVM
    rows = _rows(sources).filter(F.col("text").rlike(r"[^\x00-\x7f]{2}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src_table", "row_id", "text", "restored", "damage"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for src, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                restored, used = decode_spans(text)
                if used:
                    out.append((src, row, text, restored, "; ".join(f"utf-8 as {c}" for c in used)))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(run, "src_table string, row_id long, text string, restored string, damage string").distinct()


def find_wrong_encoding(sources: dict[str, tuple[DataFrame, str, str]], sample: DataFrame | None = None) -> DataFrame:
    """Affected rows of several tables: src_table, row_id, text, restored, damage, lost.

    sources: name -> (table, id column, text column). The letter statistics are taken over all texts of
    all tables. restored is the text as far as it can be brought back; damage names the encodings, NULL
    if characters are only lost; lost tells of replacement characters and question marks inside words.
    NULL and empty texts are never affected; rows delivered twice (same id and text) give one row; other
    columns are left out.
    """
    rows = _rows(sources)
    letters = collect_model(letter_counts(sample if sample is not None else rows))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(letters.counts)
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _loaded:
            _loaded.clear()
            _loaded[number] = Repairer(Letters(shared.value))
        repair = _loaded[number].repair
        names = ["src_table", "row_id", "text", "restored", "damage", "lost"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            out = []
            for src, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                restored, damage, lost = repair(text)
                if damage or lost:
                    out.append((src, row, text, restored, damage, lost))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = "src_table string, row_id long, text string, restored string, damage string, lost boolean"
    # plain ASCII without a question mark has nothing to look at and stays in the JVM
    return rows.filter(F.col("text").rlike(r"[^\x00-\x7f]|\?")).mapInArrow(run, schema).distinct()
