"""Official HTML of acts: node rows, and the reference texts of measurements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIPPED = {"script", "style"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Nodes(HTMLParser):
    """Elements in document order with their own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = _CLOSES.get(tag)
        if closes and self.stack and self.rows[self.stack[-1]][2] in closes:
            self.stack.pop()
        a = dict(attrs)
        parent = self.rows[self.stack[-1]][0] if self.stack else 0
        self.rows.append([len(self.rows) + 1, parent, tag, a.get("id"), a.get("class"), []])
        if tag not in _VOID:
            self.stack.append(len(self.rows) - 1)
        elif tag == "br" and self.stack:
            self.rows[self.stack[-1]][5].append("\n")

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[k]][2] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.rows[self.stack[-1]][2] not in _SKIPPED:
            self.rows[self.stack[-1]][5].append(data)


def html_nodes(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Elements of each document: key, node_id (in document order), parent_id, tag, id, class, text (own text, blanks single).

    Unclosed paragraphs and list items end where the next one begins; scripts and styles have no text. NULL gives no rows."""
    kind = dict(docs.dtypes)[key]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("key", id_type), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("class", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    parser = _Nodes()
                    parser.feed(t)
                    parser.close()
                    out += [(k, *r[:5], " ".join("".join(r[5]).split())) for r in parser.rows]
            cols = list(zip(*out)) if out else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], names=schema.names)

    ddl = f"key {kind}, node_id int, parent_id int, tag string, id string, `class` string, text string"
    return docs.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, ddl).withColumnRenamed("key", key)


def with_sections(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes with the section (id part_N) that encloses them, and whether they are quoted. Documents are small groups."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("node_id")
    section = F.last(F.when(F.col("id").rlike(r"^part_\d+$"), F.col("id")), ignorenulls=True).over(order)
    return nodes.withColumn("section", section).withColumn("quoted", F.coalesce(F.col("class").rlike(r"(?i)\bquot"), F.lit(False)))


def reference_texts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Main text, annexes and notes of each document: key, part ('main', 'annexes', 'notes'), text, placeholder.

    part_1 is the main text, later sections are annexes; footnotes are elements of that class. placeholder: the section only
    says that its content is missing."""
    placed = with_sections(nodes, key)
    note = F.coalesce(F.col("class").rlike(r"(?i)\bfoot?note"), F.lit(False))
    part = F.when(note, "notes").when(F.col("section") == "part_1", "main").when(F.col("section").isNotNull(), "annexes")
    parts = placed.withColumn("part", part).filter("part is not null and text <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ")
    grouped = parts.groupBy(key, "part").agg(text.alias("text"))
    return grouped.withColumn("placeholder", F.col("text").rlike(r"(?iu)^\W*(treść|załącznik)[^.]{0,60}(w pliku|dostępn|pdf)"))


def html_units(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units by their ids outside quotes: key, node_id, path, type, num. Ids such as part_1-art_2-ust_1a name the path."""
    path = F.regexp_replace(F.regexp_replace("id", r"^part_\d+-?", ""), "-", "/")
    units = nodes.filter(F.col("id").rlike(r"(^|-)(art|par|ust|pkt|lit|tir)_\w+$") & ~F.coalesce(F.col("class").rlike(r"(?i)\bquot"), F.lit(False)))
    last = F.element_at(F.split(path, "/"), -1)
    return units.select(key, "node_id", path.alias("path"), F.substring_index(last, "_", 1).alias("type"), F.regexp_extract(last, r"^[a-z]+_(.*)$", 1).alias("num"))
