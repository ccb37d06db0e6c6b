"""Markdown of acts: writing, front matter, quote depth."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.common import materialize, previous, running_least, running_sum
from folioflow.functions.text import escape_markup

#: Front matter keys in their order and the columns they come from.
FRONT = [("eli", "eli"), ("title", "title"), ("type", "act_type"), ("publisher", "publisher"), ("year", "act_year"), ("position", "pos"), ("announced", "announcement_date"), ("promulgated", "promulgation"), ("changed", "change_date"), ("keywords", "keywords")]


def front_matter(df: DataFrame) -> Column:
    """Front matter of act metadata: one line per key, values as JSON, empty ones left out."""
    kinds = dict(df.dtypes)
    lines = []
    for key, column in FRONT:
        if column not in kinds:
            continue
        c = F.col(column)
        empty = c.isNull() | ((F.size(c) == 0) if kinds[column].startswith("array") else (c.cast("string") == ""))
        # JSON of one value: that of an object without its frame
        value = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        lines.append(F.when(~empty, F.concat(F.lit(f"{key}: "), value)))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def read_front_matter(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keys and JSON values between the rules at the start of a text: key, name, value."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(\n|$)", 1)
    line = df.select(F.col(key), F.explode(F.split(block, "\n")).alias("_l")).filter(F.col("_l").rlike(r"^[\w-]+: "))
    return line.select(key, F.regexp_extract("_l", r"^([\w-]+): ", 1).alias("name"), F.regexp_extract("_l", r"^[\w-]+: (.*)$", 1).alias("value"))


def page_notes(kinds: DataFrame) -> DataFrame:
    """One sentence per act and kind of page that has no plain text: doc_id, note. kinds: doc_id, kind, pages (as ranges)."""
    words = F.create_map(*[F.lit(x) for pair in {"empty": "no text", "scan": "text read from a scan", "ocr": "text read from an image", "image": "an image"}.items() for x in pair])
    known = kinds.filter(F.col("kind").isin("empty", "scan", "ocr", "image"))
    return known.select("doc_id", F.format_string("[Pages %s: %s]", "pages", words[F.col("kind")]).alias("note"))


def heading_unit(blocks: DataFrame) -> DataFrame:
    """Whether articles or sections head each part: doc_id, part, unit ('Art.' if the part has one outside quotes, else '§')."""
    return blocks.filter("depth = 0").groupBy("doc_id", "part").agg(F.when(F.bool_or(F.col("text").rlike(r"^Art\. ?\d")), "Art.").otherwise("§").alias("unit"))


def split_head(text: Column, unit: Column) -> Column:
    """Array of the heading and the rest of a block that begins with its part's unit; the text alone otherwise."""
    head = F.when(unit == "Art.", F.regexp_extract(text, r"^(Art\. ?\d+\w*[⁰¹²³⁴⁵⁶⁷⁸⁹]*\.?)\s*", 1)).otherwise(F.regexp_extract(text, r"^(§ ?\d+\w*[⁰¹²³⁴⁵⁶⁷⁸⁹]*\.?)\s*", 1))
    rest = F.ltrim(F.substring(text, F.length(head) + 1, F.length(text)))
    return F.when(head == "", F.array(text)).otherwise(F.filter(F.array(F.concat(F.lit("##### "), head), rest), lambda x: x != ""))


#: Signs that open and close a quote; the second ones are read for the first.
OPENING, CLOSING = "„“", "”ˮ"
#: A number and the sign of seconds or inches behind it, which closes no quote.
SECONDS = r"\d[’′']?\s?\d*(?:[,.]\d+)?[\"”″]"
#: A quote that opens its block, possibly behind the label of a unit.
HEAD_QUOTE = r"^((§|Art\.) ?\d+\w*\. ?|\d+\w*[.)] ?|[a-z]{1,3}\) ?)?[„“]"
_ARTICLE = r"^Art\. ?(\d+)"
_READ = ("ocr", "scan", "image")


class _Quotes:
    """The open quotes of a document, block by block."""

    def __init__(self) -> None:
        self.depth, self.outer, self.inner, self.announced = 0, 0, set(), False

    def block(self, kind: str, text: str) -> int:
        """Depth before a block; afterwards the state behind it."""
        if kind == "annex":
            self.__init__()
        article = re.match(_ARTICLE, text) if kind not in _READ else None
        number = int(article.group(1)) if article else 0
        resumes = self.depth > 0 and number and number == self.outer + 1 and not self.announced and self.inner.isdisjoint((number - 1, number))
        before = 0 if resumes else self.depth
        if number and before:
            self.inner.add(number)
        elif number:
            self.outer, self.inner = number, set()
        self.announced = text.rstrip().endswith(":")
        if kind in _READ:
            return before
        marks = re.findall(f"[{OPENING}{CLOSING}]", re.sub(SECONDS, "", text))
        head = bool(re.match(HEAD_QUOTE, text))
        own = closed = 0
        for mark in marks[head:]:
            if mark in OPENING:
                own += 1
            elif own:
                own -= 1
            else:
                closed += 1
        self.depth = max(0, before + head - closed)
        return before


def quote_depths(blocks: list[tuple[str, str]]) -> list[int]:
    """Depth of quotes before each block (kind, text) of a document.

    Marks of seconds don't count. Closing marks close what the block opened before they close the depth. Only a quote that
    opens its block is carried on. Text from images changes nothing. Annex headers begin at 0; so does an article whose
    number follows the last outer one, unless the block before announced a quote or an inner article explains the number.
    """
    quotes = _Quotes()
    return [quotes.block(kind, text) for kind, text in blocks]


def with_depth(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, seq, kind, text) with depth, that of quotes before each; for acts of any size.

    A walk that never goes below 0 is its sum less the least sum so far, so the depth comes from running sums and minima over
    the few columns of the acts that have quotes. As in quote_depths; an article is taken for one of the act if the
    articles before it, from one outside quotes on, have the numbers before it.
    """
    text = F.regexp_replace("text", SECONDS, "")
    head = F.col("text").rlike(HEAD_QUOTE) & ~F.col("kind").isin(*_READ)
    marks = F.regexp_extract_all(text, F.lit(f"[{OPENING}{CLOSING}]"), F.lit(0))
    marks = F.when(F.col("_head"), F.slice(marks, F.lit(2), F.greatest(F.size(marks), F.lit(1)))).otherwise(marks)
    opens = lambda m: F.lit(OPENING).contains(m)
    state = lambda own, closed: F.struct(own.cast("int").alias("own"), closed.cast("int").alias("closed"))
    step = lambda s, m: F.when(opens(m), state(s["own"] + 1, s["closed"])).when(s["own"] > 0, state(s["own"] - 1, s["closed"])).otherwise(state(s["own"], s["closed"] + 1))
    closed = F.aggregate(marks, state(F.lit(0), F.lit(0)), step)["closed"]
    place = ["seq", "block_id"]
    rows = blocks.select("doc_id", "block_id", "seq", "kind", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null and seq is not null")
    quoted = rows.filter(F.col("text").rlike(f"[{OPENING}]")).select("doc_id").distinct()
    rows = rows.join(quoted, "doc_id", "left_semi").withColumn("_head", head)
    delta = F.when(F.col("kind").isin(*_READ), 0).otherwise(F.col("_head").cast("int") - closed)
    number = F.when(~F.col("kind").isin(*_READ), F.nullif(F.regexp_extract("text", _ARTICLE, 1), F.lit("")).try_cast("int"))
    narrow = rows.select("doc_id", "block_id", "seq", delta.alias("delta"), number.alias("number"), F.col("text").rlike(r":\s*$").alias("ends"), (F.col("kind") == "annex").cast("int").alias("annex"))
    # parts begin with their annex header
    narrow = running_sum(narrow, ["doc_id"], place, F.col("annex"), "_before").withColumn("part", F.col("_before") + F.col("annex")).drop("_before")
    narrow = materialize(narrow, "quotes")
    key = ["doc_id", "part"]

    def depths(df: DataFrame, keys: list[str]) -> DataFrame:
        sums = materialize(running_sum(df, keys, place, F.col("delta"), "_sum"), "quotes")
        return running_least(sums, keys, place, F.least("_sum", F.lit(0)), "_least").withColumn("depth", F.col("_sum") - F.col("_least")).drop("_sum", "_least")

    plain = previous(depths(narrow, key), key, place, "ends", "announced")
    plain = materialize(plain, "quotes")
    # the articles of a part with their depth: an outer one, or one that follows the article before it, goes on with the act
    articles = plain.filter("number is not null")
    articles = previous(articles, key, place, "number", "last")
    follows = F.coalesce(F.col("number") == F.col("last") + 1, F.lit(False)) & ~F.coalesce("announced", F.lit(False)) & (F.col("depth") > 0)
    articles = materialize(articles.withColumn("follows", follows), "quotes")
    # runs of articles that follow each other belong to the act if the article before the run does
    runs = running_sum(articles, key, place, (~F.col("follows")).cast("int"), "_r").withColumn("run", F.col("_r") + (~F.col("follows")).cast("int"))
    first = runs.filter("not follows").select(*key, "run", (F.col("depth") == 0).alias("outer"))
    resumed = runs.filter("follows").join(first, [*key, "run"]).filter("outer").select("doc_id", "block_id", F.lit(1).alias("resumes"))
    again = plain.drop("depth", "announced").join(resumed, ["doc_id", "block_id"], "left").withColumn("resumes", F.coalesce("resumes", F.lit(0)))
    again = running_sum(again, key, place, F.col("resumes"), "_s").withColumn("stretch", F.col("_s") + F.col("resumes")).drop("_s")
    found = depths(materialize(again, "quotes"), [*key, "stretch"]).select("doc_id", "block_id", F.col("depth").cast("int").alias("depth"))
    return blocks.join(found, ["doc_id", "block_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def to_markdown(blocks: DataFrame, notes: DataFrame, meta: DataFrame, piece: int = 1_000_000) -> DataFrame:
    """Markdown of each act in ordered pieces of about piece characters: doc_id, piece_no (from 0), text.

    blocks: doc_id, seq, kind, text, part, depth (see parts and quote_depths); notes: doc_id, seq, unique_label, text; meta: act
    metadata with eli, one row per act. Units of depth 0 become headings, annex headers second-level headings, signatures
    emphasis, text from images quotes; notes follow at the end. An act of ordinary size is one piece; the pieces of a
    larger one, joined by an empty line, are its text, and no task holds more than a piece of it.
    """
    units = heading_unit(blocks)
    text = F.col("text")
    pieces = F.when(F.col("depth") == 0, split_head(text, F.col("unit"))).otherwise(F.array(escape_markup(text)))
    line = (
        F.when(F.col("kind") == "annex", F.array(F.concat(F.lit("## "), text))).when(F.col("kind") == "signature", F.array(F.concat(F.lit("*"), text, F.lit("*"))))
        .when(F.col("kind").isin("ocr", "scan"), F.array(F.concat(F.lit("> "), escape_markup(text, read=True)))).when(F.col("kind").isin("notext", "image"), F.array(F.concat(F.lit("> ["), text, F.lit("]"))))
        .otherwise(pieces)
    )
    body = blocks.filter("text <> ''").join(units, ["doc_id", "part"], "left").select("doc_id", F.lit(1).alias("place"), "seq", line.alias("lines"))
    end = notes.select("doc_id", F.lit(2).alias("place"), "seq", F.array(F.concat(F.lit("[^"), F.col("unique_label"), F.lit("]: "), "text")).alias("lines"))
    head = meta.select(F.col("eli").alias("doc_id"), F.lit(0).alias("place"), F.lit(0).alias("seq"), F.array(front_matter(meta), F.concat(F.lit("# "), F.col("title"))).alias("lines"))
    # only acts with text are written
    head = head.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = head.unionByName(body).unionByName(end)
    rows = rows.withColumn("text", F.array_join("lines", "\n\n")).withColumn("_order", F.col("place") * (1 << 40) + F.coalesce("seq", F.lit(0)))
    placed = running_sum(rows.select("doc_id", "_order", F.xxhash64("text").alias("_hash"), "text"), ["doc_id"], ["_order", "_hash"], F.length("text") + 2, "_at")
    parts = F.array_sort(F.collect_list(F.struct("_order", "_at", "text")))
    grouped = placed.groupBy("doc_id", F.floor(F.col("_at") / piece).cast("int").alias("piece_no")).agg(parts.alias("p"))
    return grouped.select("doc_id", "piece_no", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
