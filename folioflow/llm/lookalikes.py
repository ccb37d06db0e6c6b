"""One consistent form for text that looks the same.

Characters are sorted by their normalisation quick-check properties: most are Yes and need no attention; a search
finds the few that are No or Maybe. Around each of them a segment is isolated, from the last stable starter to
the next one; only segments are normalised, with that context, and the canonical segments are spliced into the
unchanged text. No normalisation form maps letters of one script to another, so these are judged by their word:
inside a Latin word they stand for the Latin letter they look like, in a word of their own script they stay.
"""

from __future__ import annotations

import functools
import re
import string
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԝв", "ABESIJKMHOPCTYXaeijopcyxshdqwb"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυκτχ", "ABEZHIKMNOPTYXoviapuktx"))
_OTHER = dict(zip("ɡɑıօոսհօԼ", "gaiounhoL"))
LOOK_ALIKE = {**_CYRILLIC, **_GREEK, **_OTHER}
#: Scripts whose look-alikes are among these fixed values; those of others come from the confusables.
_KNOWN = {"latin", "greek", "cyrillic", "armenian"}
#: Signs of units and quantities, regular beside a number or a letter of a unit.
_UNIT = set("ΩµμÅK℃℉")
#: Letters with a stroke, written as letter and overlay.
_STROKED = {"l": "ł", "L": "Ł", "o": "ø", "O": "Ø", "d": "đ", "D": "Đ", "h": "ħ", "H": "Ħ", "t": "ŧ", "T": "Ŧ", "b": "ƀ", "z": "ƶ", "Z": "Ƶ"}
_OVERLAY = {"̵", "̶", "̷", "̸"}
_FILLERS = {0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800, 0x034F}
_KEPT_TAGS = ("<super>", "<sub>", "<fraction>", "<square>")


def _kind(code: int) -> str | None:
    """Class of a character by its normalisation properties, None if nothing ever has to be done with it (quick check Yes).

    'form': quick check No; a compatibility form of a regular character, or a canonical one that composition replaces.
    'mark': quick check Maybe or a combining class; it may compose with
    what stands before. 'space' and 'invisible' are the rest of what has a canonical counterpart.
    """
    ch = chr(code)
    category = unicodedata.category(ch)
    if ch in "\t\n\r " or code < 0x7F:
        return "invisible" if category == "Cc" and ch not in "\t\n\r" else None
    if category in ("Cf", "Cc") or code in _FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return "invisible"
    if category in ("Zs", "Zl", "Zp"):
        return "space"
    if unicodedata.combining(ch) or category in ("Mn", "Me") or ch in _maybe():
        return "mark"
    if unicodedata.is_normalized("NFKC", ch):
        return None
    if not unicodedata.is_normalized("NFC", ch):
        return "form"
    decomposition = unicodedata.decomposition(ch)
    if decomposition.startswith(_KEPT_TAGS) or ch in _UNIT or 0x3300 <= code <= 0x33FF:
        return None
    # compatibility signs such as the ellipsis are regular; letters, digits and wide or styled forms aren't
    return "form" if decomposition.startswith(("<wide", "<narrow", "<font")) or category[0] == "L" or category in ("Nl", "Nd") else None


@functools.cache
def _maybe() -> frozenset[str]:
    """Characters that may compose with one before them: the second ones of all primary composites, and the jamo of Hangul syllables."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for code in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", chr(code)):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@functools.cache
def classes() -> dict[str, str]:
    """Character classes of a regular expression, by kind; over all code points."""
    ranges: dict[str, list[list[int]]] = {}
    for code in range(sys.maxunicode + 1):
        # surrogates, and Hangul syllables (all quick check Yes)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        kind = _kind(code)
        if kind:
            own = ranges.setdefault(kind, [])
            if own and own[-1][1] == code - 1:
                own[-1][1] = code
            else:
                own.append([code, code])
    esc = lambda c: f"\\U{c:08x}"
    return {k: "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in v) for k, v in ranges.items()}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Cased letters of other scripts (and Lisu) with the skeleton of a single Latin letter, by the public confusables data of the JVM's Unicode library.

    Without that library only the fixed values of this module are known.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        letters = [chr(c) for c in range(0x370, 0x1F000) if unicodedata.category(chr(c)) in ("Lu", "Ll") or 0xA4D0 <= c <= 0xA4F7]
        letters = [c for c in letters if not unicodedata.decomposition(c) and not unicodedata.name(c, "").startswith("LATIN")]
        shapes = checker.getSkeleton("\n".join(letters)).split("\n")
        latin = {checker.getSkeleton(c): c for c in string.ascii_letters if c != "I"}
    except (AttributeError, TypeError, Py4JError):
        return dict(LOOK_ALIKE)
    found = {}
    for letter, shape in zip(letters, shapes, strict=True):
        if shape in latin:
            # one shape stands for I and l
            found[letter] = "I" if latin[shape] == "l" and unicodedata.category(letter) == "Lu" else latin[shape]
    return found | LOOK_ALIKE


class Rules:
    """Expressions of the classes of characters, and the look-alikes of Latin letters."""

    def __init__(self, kinds: dict[str, str], alike: dict[str, str]) -> None:
        self.alike = alike
        unstable = "".join(kinds.values())
        # a segment: what is unstable, from the last stable starter on, as that may compose with what follows
        self.segment = re.compile(f"[^{unstable}]?[{unstable}]+")
        self.unstable = re.compile(f"[{unstable}]")
        self.invisible, self.space, self.marks, self.form = (re.compile(f"[{kinds[k]}]") for k in ("invisible", "space", "mark", "form"))
        self.foreign = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯԱ-֏ɐ-ʯı" + "".join(map(re.escape, alike)) + "]")
        self.word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
        self.regular: set[str] = set()

    def odd(self, text: str) -> bool:
        """Whether a text has characters to look at. Each character is classed once; most texts are done by a difference of sets."""
        rest = set(text) - self.regular
        odd = {c for c in rest if self.unstable.match(c) or self.foreign.match(c)}
        self.regular |= rest - odd
        return bool(odd)


@functools.cache
def rules() -> Rules:
    return Rules(classes(), LOOK_ALIKE)


@functools.lru_cache(100_000)
def _script(ch: str) -> str:
    code = ord(ch)
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "greek"
    if 0x400 <= code <= 0x52F:
        return "cyrillic"
    if 0x530 <= code <= 0x58F:
        return "armenian"
    return "latin" if code < 0x2B0 or 0x1E00 <= code <= 0x1EFF else unicodedata.name(ch, "other").split(" ")[0].lower()


def _canonical_segment(segment: str, r: Rules, kinds: set[str]) -> str:
    if r.invisible.search(segment):
        kinds.add("invisible")
        segment = r.invisible.sub("", segment)
    if r.space.search(segment):
        kinds.add("space")
        segment = r.space.sub(lambda m: "\n" if m.group() in "\u2028\u2029" else " ", segment)
    if r.form.search(segment):
        kinds.add("form")
        segment = r.form.sub(lambda m: unicodedata.normalize("NFKC", m.group()), segment)
    if r.marks.search(segment):
        out = ""
        for ch in segment:
            if ch in _OVERLAY and out and out[-1] in _STROKED:
                out = out[:-1] + _STROKED[out[-1]]
            else:
                out += ch
        composed = unicodedata.normalize("NFC", out)
        if composed != segment:
            kinds.add("mark")
        segment = composed
    return segment


def normalized(text: str, r: Rules, kinds: set[str]) -> str:
    """Text with its unstable segments normalised; kinds gets what was changed."""
    return r.segment.sub(lambda m: _canonical_segment(m.group(), r, kinds), text) if r.unstable.search(text) else text


def _latin_words(text: str, r: Rules, kinds: set[str]) -> str:
    """Letters of other scripts that stand in Latin words, or in words that only look Latin without a neighbour of their script."""
    words = list(r.word.finditer(text))
    real: dict[int, set[str]] = {}

    def real_word(k: int) -> set[str]:
        """The script of a word of its own: one script, with a letter that no Latin letter looks like."""
        if k not in real:
            w = words[k].group()
            scripts = {_script(c) for c in w}
            real[k] = scripts if len(scripts) == 1 and scripts != {"latin"} and any(c not in LOOK_ALIKE and (_script(c) in _KNOWN or c not in r.alike) for c in w) else set()
        return real[k]

    out, at = [], 0
    for i, m in enumerate(words):
        w = m.group()
        if w.isascii() or not r.foreign.search(w):
            continue
        scripts = {_script(c) for c in w if c not in "'’-"}
        strange = [c for c in w if _script(c) != "latin" or c in _OTHER]
        if len(scripts) > 1 or strange and scripts == {"latin"}:
            # units: a sign at the end of or before a short prefix (kΩ, μm)
            if len(w) <= 3 and all(c in _UNIT for c in strange):
                continue
            # beside Latin letters every letter with the shape of one stands for it
            alike = r.alike if "latin" in scripts else LOOK_ALIKE
            changed = "".join(alike.get(c, c) for c in w)
        elif all(c in LOOK_ALIKE or _script(c) not in _KNOWN and c in r.alike for c in w if c not in "'’-"):
            if any(scripts & real_word(k) for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(words)):
                continue
            # a small Greek letter by itself is a symbol, but for omicron
            if scripts == {"greek"} and len(w) == 1 and w not in "οΟΑΒΕΖΗΙΚΜΝΡΤΥΧ":
                continue
            changed = "".join(r.alike.get(c, c) for c in w)
        else:
            continue
        if changed != w:
            kinds.add("script")
            out += [text[at : m.start()], changed]
            at = m.end()
    return "".join(out) + text[at:]


def canonical(text: str, r: Rules | None = None) -> tuple[str, set[str]]:
    """The consistent form of a text, and what was changed: invisible, space, mark, form, script. A text in which nothing is to change stays."""
    if text.isascii() and text.isprintable():
        return text, set()
    r = r or rules()
    kinds: set[str] = set()
    if not r.odd(text):
        return text, kinds
    found = normalized(text, r, kinds)
    if r.foreign.search(found):
        words = _latin_words(found, r, kinds)
        # a mark may combine only with the Latin letter
        found = normalized(words, r, kinds) if words != found else words
    return (found, kinds) if kinds else (text, kinds)


def _changed(rows: DataFrame, alike: dict[str, str], method_only: bool) -> DataFrame:
    """Rows (src_table, row_id, text, base) of whose base something is to change."""
    kept = classes()
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _loaded:
            _loaded.clear()
            _loaded[number] = Rules(kept, alike)
        r = _loaded[number]
        names = ["src_table", "row_id", "text", "canonical", "kinds"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            out = []
            for src, row, text, base in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if method_only:
                    kinds: set[str] = set()
                    found = normalized(base, r, kinds) if r.odd(base) else base
                else:
                    found, kinds = canonical(base, r)
                if kinds:
                    out.append((src, row, text, found, sorted(kinds)))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    # text in plain ASCII has nothing to look at and stays in the JVM
    looked_at = rows.filter(F.col("base").rlike(r"[^\t\n\r\x20-\x7e]")).select("src_table", "row_id", "text", "base")
    return looked_at.mapInArrow(run, "src_table string, row_id long, text string, canonical string, kinds array<string>").distinct()


_loaded: dict[str, Rules] = {}


def find_look_alikes(
    sources: dict[str, tuple[DataFrame, str, str]], known: DataFrame | None = None, restored: DataFrame | None = None, method_only: bool = False,
) -> DataFrame:
    """Rows whose text has look-alike or invisible characters: src_table, row_id, text, canonical, kinds.

    sources: name -> (table, id column, text column). known: (src_table, row_id) of rows to leave out,
    such as wrongly decoded ones. restored: (src_table, row_id, text, restored) of such rows; they are judged and
    brought to their form by the restored text instead. method_only: normalisation properties alone, letters of other scripts
    stay. NULL and empty texts have none; rows delivered twice (same id and text) give one row; other
    columns are left out. Raised figures and brackets, fractions, unit signs and words or symbols of another
    script are no reason to change a row. canonical is in the normalisation form C.
    """
    parts = [
        df.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).filter("text <> ''")
        for name, (df, key, text) in sources.items()
    ]
    rows = functools.reduce(DataFrame.unionByName, parts)
    if restored is None:
        rows = rows.withColumn("base", F.col("text"))
    else:
        better = restored.select("src_table", "row_id", "text", F.col("restored").alias("base")).filter("text <> base").dropDuplicates(["src_table", "row_id", "text"])
        rows = rows.join(better, ["src_table", "row_id", "text"], "left").withColumn("base", F.coalesce("base", "text"))
    found = _changed(rows, LOOK_ALIKE if method_only else confusables(rows.sparkSession), method_only)
    return found.join(known, ["src_table", "row_id"], "left_anti") if known is not None else found
