"""Act metadata, catalog and refresh decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions.text import act_id


def parse_ids(df: DataFrame, column: str = "eli") -> tuple[DataFrame, DataFrame]:
    """Rows with publisher, year and pos of their act identity; and the rejected rows."""
    parsed = df.withColumn("_id", act_id(F.col(column)))
    good = parsed.filter("_id is not null").withColumns({c: F.col(f"_id.{c}") for c in ("publisher", "year", "pos")}).drop("_id")
    return good, parsed.filter("_id is null").drop("_id")


def last_rows(log: DataFrame, key: str, order: str) -> DataFrame:
    """Catalog read: the last row of each key. max_by keeps one row per key on the map side."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select(key, "x.*")


def needs_reading(row: str = "") -> Column:
    """Reading images was never tried (NULL, unlike 0) though pages need it."""
    c = lambda n: F.col(f"{row}{n}")
    return ((c("no_text_pages") > 0) & c("ocr_pages").isNull()) | ((c("image_pages") > 0) & c("image_ocr_pages").isNull())


def refresh_reasons(listings: DataFrame, catalog: DataFrame, read_images: bool = True, everything: bool = False) -> DataFrame:
    """Why each listed act has to be converted: eli, reason (new, changed, failed, images, forced), NULL if it hasn't.

    Listings have one row per act. Acts without a PDF or with HTML are left out. The change date is compared as written.
    """
    wanted = listings.filter(F.coalesce("text_pdf", F.lit(False)) & ~F.coalesce("text_html", F.lit(False))).select("eli", "change_date")
    known = catalog.select("eli", F.col("change_date").alias("known_date"), "status", needs_reading().alias("needs"), F.lit(True).alias("known"))
    joined = wanted.join(known, "eli", "left")
    reason = (
        F.when(F.col("known").isNull(), "new").when(~F.col("change_date").eqNullSafe(F.col("known_date")), "changed")
        .when(F.lower(F.trim(F.coalesce("status", F.lit("")))) != "ok", "failed").when(F.coalesce("needs", F.lit(False)) & F.lit(read_images), "images")
        .when(F.lit(everything), "forced")
    )
    return joined.select("eli", reason.alias("reason"))


def upsert(catalog: DataFrame, results: DataFrame, key: str = "eli") -> DataFrame:
    """Catalog with the rows of results put in the place of those of the same key; both have one row per key."""
    columns = [c for c in catalog.columns if c != key]
    old, new = catalog.withColumn("_old", F.lit(True)), results.withColumn("_new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *[F.when(F.col("_new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def catalog_order(catalog: DataFrame) -> DataFrame:
    """Rows in the order in which the catalog is written: year, then position, as numbers."""
    return catalog.orderBy(F.col("act_year").cast("int"), F.col("pos").cast("int"), "eli")


def to_fetch(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Listings whose act and change date the cache lacks."""
    return listings.join(cache.select("eli", "change_date"), (listings.eli == cache.eli) & listings.change_date.eqNullSafe(cache.change_date), "left_anti")


def neighbour_titles(acts: DataFrame, reach: int = 3) -> DataFrame:
    """Titles at the positions around each act, in order, without its own: eli, titles. acts: one row per act.

    A frame over the positions of a year, which are few, instead of a join of ranges.
    """
    around = Window.partitionBy("publisher", "act_year").orderBy("pos").rangeBetween(-reach, reach)
    near = F.filter(F.array_sort(F.collect_list(F.struct("pos", "eli", "title")).over(around)), lambda x: x["eli"] != F.col("eli"))
    return acts.select("eli", F.transform(near, lambda x: x["title"]).alias("titles"))


def newest_before(listings: DataFrame, key: str, order: str, limit: Column, value: str) -> DataFrame:
    """As-of: the newest value of each key before a limit; the smallest of several at the same time."""
    early = listings.filter(F.col(order) < limit)
    newest = early.groupBy(key, order).agg(F.min(value).alias(value))
    return newest.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """same, changed, added or removed for each key of two versions, by a digest of the value."""
    digest = lambda df, name: df.select(key, F.sha2(F.coalesce(F.col(value), F.lit("\x00")), 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), key, "full_outer")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(key, state.alias("state"))


def digest_copies(df: DataFrame, text: str, *also: Column) -> DataFrame:
    """Texts that occur more than once, by digest: digest, n."""
    return df.filter(f"{text} is not null").groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.count("*").alias("n"), *also).filter("n > 1")


def convert_safely(df: DataFrame, key: str, text: str, convert, schema: str) -> DataFrame:
    """Convert each row by itself; one that fails becomes an error row instead of failing its task.

    convert takes the text and gives a dict. Output: key, the columns of schema, status, error (300 characters).
    """
    import pyarrow as pa

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append({"key": k, **convert(t), "status": "ok", "error": None})
                except Exception as e:  # noqa: BLE001 - any failure is this row's own
                    rows.append({"key": k, **dict.fromkeys(fields), "status": "error", "error": f"{type(e).__name__}: {e}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"key {kind}, {schema}, status string, error string"
    shape = to_arrow_schema(StructType.fromDDL(full))
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, full).withColumnRenamed("key", key)
