"""Files in and out: year lists, catalog, recognised words, Markdown, JSON trees, result rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the catalog file in their order, and those that are numbers.
CATALOG = [
    "eli", "act_year", "pos", "act_type", "title", "announcement_date", "promulgation", "change_date", "pdf_sha256", "pages", "words",
    "no_text_pages", "image_pages", "ocr_pages", "image_ocr_pages", "status", "error", "converter", "converted_at",
]
NUMBERS = ["act_year", "pos", "pages", "words", "no_text_pages", "image_pages", "ocr_pages", "image_ocr_pages"]
_ITEM = "ELI string, title string, type string, pos int, year int, publisher string, announcementDate string, promulgation string, changeDate string, textPDF boolean, textHTML boolean, keywords array<string>"
#: Columns of recognised words, as their tool writes them.
_WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def year_lists(spark: SparkSession, path: str) -> DataFrame:
    """Items of year lists (JSON documents with an array items) in the columns of act metadata."""
    raw = spark.read.schema(f"items array<struct<{_struct(_ITEM)}>>").json(path, multiLine=True)
    item = raw.select(F.explode("items").alias("i")).select("i.*")
    return _metadata(item)


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in ddl.split(", ")))


def _metadata(item: DataFrame) -> DataFrame:
    names = {"ELI": "eli", "title": "title", "type": "act_type", "pos": "pos", "year": "act_year", "publisher": "publisher", "announcementDate": "announcement_date", "promulgation": "promulgation", "changeDate": "change_date", "textPDF": "text_pdf", "textHTML": "text_html", "keywords": "keywords"}
    return item.select(*[F.col(a).alias(b) for a, b in names.items()])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file. An empty cell is NULL: 'never tried' stays apart from 0. The last row of an act counts."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CATALOG), quote='"', escape='"', multiLine=True)
    typed = raw.select("_metadata", *[(F.col(c).try_cast("int") if c in NUMBERS else F.nullif(F.col(c), F.lit(""))).alias(c) for c in CATALOG])
    # files by their names; such a file is read by one task, so ids ascend in it
    placed = typed.withColumn("_at", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()))
    rest = [c for c in CATALOG if c != "eli"]
    return placed.groupBy("eli").agg(F.max_by(F.struct(*rest), "_at").alias("x")).select("eli", "x.*")


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Write the catalog in order under a name of its own, then put it in the place of the last one."""
    spark = catalog.sparkSession
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    ordered = catalog.select(*CATALOG).orderBy("act_year", "pos", "eli")
    ordered.write.csv(staging, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging))
    fs = old.getFileSystem(conf)
    kept = jvm.org.apache.hadoop.fs.Path(staging + ".old")
    if fs.exists(old):
        fs.rename(old, kept)
    if not fs.rename(new, old):
        if fs.exists(kept):
            fs.rename(kept, old)
        raise OSError(f"can't put the catalog in its place: {path}")
    fs.delete(kept, True)


def recognised_words(spark: SparkSession, path: str) -> DataFrame:
    """Words with their boxes (tab-separated, 12 columns) with the page's width and height; file as source."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=_WORDS, quote="").withColumn("source", F.col("_metadata.file_path"))
    size = raw.filter("level = 1").groupBy("source", "page_num").agg(F.max("width").alias("page_width"), F.max("height").alias("page_height"))
    return raw.filter("level = 5 and trim(text) <> ''").join(size, ["source", "page_num"], "left")


def write_markdown(texts: DataFrame, path: str) -> None:
    """One row per act, in folders by publisher and year. texts: doc_id, text."""
    parts = F.split("doc_id", "/")
    rows = texts.withColumns({"publisher": F.get(parts, F.lit(0)), "year": F.get(parts, F.lit(1)), "name": F.concat(F.replace(F.col("doc_id"), F.lit("/"), F.lit("-")), F.lit(".md"))})
    rows.write.mode("overwrite").partitionBy("publisher", "year").json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown written by write_markdown, or a folder of .md files (one text each)."""
    if path.endswith(".md") or "*" in path:
        raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
        return raw.select(F.regexp_replace(F.regexp_replace("file", r"\.md$", ""), "-", "/").alias("doc_id"), F.col("value").alias("text"))
    return spark.read.schema("doc_id string, text string, name string").json(path).select("doc_id", "text")


def node_json(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat node rows as one JSON text per act: key, json (an array of nodes in pre-order)."""
    fields = [c for c in nodes.columns if c not in (key, "error")]
    ordered = F.array_sort(F.collect_list(F.struct("node_id", *[c for c in fields if c != "node_id"])))
    return nodes.groupBy(key).agg(F.to_json(ordered).alias("json"))


def write_rows(rows: DataFrame, path: str, form: str = "json") -> None:
    """Result rows as JSON lines or CSV."""
    if form == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").json(path)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Contents and digests of documents to decode: path, sha256, length, content. A decoder takes these rows to glyph tables."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")
