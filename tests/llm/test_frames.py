"""Every operator on rows of nulls, empty and very long texts, repeated rows, clashing extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import contamination, encodings, lookalikes, packing, scans, splitting, subjects

LONG = "Rada gminy, o której mowa w § 5, określa księgę. " * 20_000
TEXTS = [None, "", " ", "\n\n", LONG, "x" * 1_000_000, "ą" * 300_000, "Ä™" * 50_000, "😀é​" * 20_000, "12 345", "...", "\x00\x01", "�?"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)]
    rows += rows[:5] + [(None, "akt", None, None), (None, None, None, None), (4, "inny tekst", "x", 1)]
    return spark.createDataFrame(rows, "id long, text string, tokens string, _id int").repartition(3)


def drain(df):
    df.write.format("noop").mode("overwrite").save()
    return df.columns


def test_texts(spark, texts):
    docs = texts.withColumnRenamed("id", "doc_id")
    items = texts.select(F.col("id").alias("item_id"), F.substring("text", 1, 500).alias("text"), F.lit(1).alias("doc_id"))
    subj = spark.createDataFrame([("a", None), (None, "b"), ("a", "c")], "subject string, text string")
    labels = spark.createDataFrame([(None, None), (4, None), (None, "a"), (4, "a"), (4, "a"), (5, "zzz")], "doc_id long, subject string")
    for frame in (docs, docs.limit(0)):
        named = frame.withColumnRenamed("doc_id", "id")
        assert drain(encodings.find_wrong_encoding({"t": (named, "id", "text")}))
        assert drain(lookalikes.find_look_alikes({"t": (named, "id", "text")}))
        assert drain(splitting.split_texts(named, "id"))
        assert drain(splitting.split_groups(named.withColumns({"doc": F.lit("d"), "seq": F.col("_id")}), "doc", "seq", "id"))
        assert drain(packing.pack_tokens(frame))
        assert drain(contamination.find_leaks(frame, items))
        assert drain(subjects.assign_subjects(frame, subj, labels, dims=4))


def test_lines(spark, texts):
    base = texts.select(F.col("id").alias("line_id"), F.lit("d").alias("doc_id"), F.col("_id").alias("seq"), F.lit(1).alias("page"), *[F.lit(0.0).alias(c) for c in ("x0", "x1", "y_top", "y_bottom")], F.lit("scan").alias("mark"), "text")
    nulls = base.limit(3)
    for c in base.columns:
        nulls = nulls.withColumn(c, F.lit(None).cast(dict(base.dtypes)[c]))
    # a third of the rows without a place, an act or a page
    holes = base.withColumns({"seq": F.lit(None).cast("int"), "page": F.lit(None).cast("int"), "doc_id": F.lit(None).cast("string")})
    pages = spark.createDataFrame([(1, "d", 1, [None, "", LONG[:5000], "5"]), (None, None, None, None), (2, "d", 2, []), (3, None, None, ["x" * 100_000])], "page_id long, doc_id string, page int, paragraphs array<string>")
    lines = base.unionByName(nulls).unionByName(holes)
    drain(scans.find_defects(lines, pages))
    drain(scans.act_paragraphs(scans.line_decisions(lines, scans.scan_model(lines, pages))))
    assert scans.find_defects(lines.limit(0), pages.limit(0)).count() == 0
