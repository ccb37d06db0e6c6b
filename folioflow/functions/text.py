"""Text expressions: tokens, keys, clean-up. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Act identity, with or without an address before it and a slash behind it.
ACT_ID = r"^(?:.*/)?(DU|MP)/(\d{4})/(\d+)/?$"
_ACCENTED = "ĄĆĘŁŃÓŚŹŻÄÖÜÉÈÀÇ"
_PLAIN = "ACELNOSZZAOUEEAC"
#: Raised and lowered digits, in order.
RAISED, LOWERED = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"


def tokens(text: Column) -> Column:
    """Lower-case word tokens. Letters of any script count, unlike with the plain word class."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def evaluation_tokens(text: Column) -> Column:
    """tokens with raised and lowered digits as tokens of their own, without note markers."""
    digits = f"([{RAISED}{LOWERED}]+)"
    spaced = F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]*\]", ""), digits, " $1 ")
    return tokens(F.translate(spaced, RAISED + LOWERED, "0123456789" * 2))


def clean_title(title: Column) -> Column:
    return F.rtrim(F.substring_index(title, "\t", 1))


def act_id(text: Column) -> Column:
    """Struct of publisher, year, pos; NULL for anything that is no act identity."""
    part = lambda i: F.regexp_extract(text, ACT_ID, i)
    found = F.struct(part(1).alias("publisher"), part(2).cast("int").alias("year"), part(3).try_cast("int").alias("pos"))
    return F.when(text.rlike(ACT_ID), found)


def letters_key(word: Column) -> Column:
    """The word's letters in order: the same for all words of the same letters."""
    return F.array_join(F.array_sort(F.filter(F.split(word, ""), lambda c: c != "")), "")


def plain_form(text: Column) -> Column:
    """Capitals without accents and punctuation, single blanks."""
    bare = F.regexp_replace(F.translate(F.upper(text), _ACCENTED, _PLAIN), r"[^\p{L}\p{N} ]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Markdown without front matter, heading marks, note markers, quote marks and emphasis."""
    out = F.regexp_replace(text, r"^---\n(?:[^-]|-[^-]|--[^-])*\n---\n", "")
    for pattern, new in ((r"(^|\n)#{1,6} +", "$1"), (r"(^|\n)> ?", "$1"), (r"\[\^[^\]]*\](?:: )?", ""), (r"\*+", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def escape_markup(text: Column, read: bool = False) -> Column:
    """Text safe as a Markdown paragraph; read: text from an image, where list and emphasis marks are escaped as well."""
    out = F.regexp_replace(text, r"^([>#])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(out, r"([*_`\[\]])", r"\\$1"), r"^(\d+)([.)]) ", r"$1\\$2 ") if read else out


#: A small letter, in a word that may be cut at the end of a line.
SMALL = "[a-ząćęłńóśźżäöüß]"


def join_lines(left: Column, right: Column) -> Column:
    """Two lines as one text: a word cut at the hyphen is closed, a hyphen repeated on the next line stands once."""
    small = SMALL
    both = F.concat(left, F.lit("\n"), right)
    repeated = F.regexp_replace(both, rf"({small})-\n-({small})", "$1-$2")
    return F.regexp_replace(F.regexp_replace(repeated, rf"({small})-\n({small})", "$1$2"), r"\n", " ")


def masked(text: Column) -> Column:
    """Digits as #, blanks single: the same for running headers that differ in numbers only."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "#"), r"\s+", " "))


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral, NULL if the text is none."""
    values = F.create_map(*[x for c, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in (F.lit(c), F.lit(v))])
    upper = F.upper(text)
    digits = F.transform(F.filter(F.split(upper, ""), lambda c: c != ""), lambda c: values[c])
    # a digit before a larger one is taken off: fold with the last digit as part of the state
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, d: F.struct((s["sum"] + d - F.when(s["last"] < d, 2 * s["last"]).otherwise(0)).alias("sum"), d.alias("last"))
    return F.when(upper.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (text != ""), F.aggregate(digits, start, step)["sum"])


#: Months in the genitive, in order.
MONTHS = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]


def written_date(text: Column) -> Column:
    """First date written as day, month name and year in a text, NULL if none or impossible."""
    pattern = r"(?iu)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, pattern, 2)))
    found = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    return F.when(text.rlike(pattern), found.try_cast("date"))
