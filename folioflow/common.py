"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in spark.checkpoint.dir. Where that is unset and the session runs on one machine (tests), a
    folder of our own is made, kept in the session's configuration and removed at exit. On a cluster without the
    setting there is none: a local folder of the driver would lose what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.folioflow.sharedDir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.folioflow.sharedDir", found)
    return found.rstrip("/")


def configure(spark: SparkSession) -> None:
    """Settings that results rest on. This version of Spark takes a union of equally partitioned tables for partitioned, although each of
    them is coalesced by itself at run time; an aggregation over the union then gives rows of one key twice."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it need not be installed on them, and set what results rest on."""
    configure(spark)
    context = spark.sparkContext
    if getattr(context, "_folioflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folioflow-")) / "folioflow.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._folioflow_shipped = True


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a written table, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sum(
    df: DataFrame, keys: list[str], position: list[str], value: Column, out: str,
    totals: dict[str, Column] | None = None, span: int = 4096,
) -> DataFrame:
    """Exclusive running sum of value per key, in the order of integer columns.

    position[0] is the main order, the others break its ties. A key may own a third of all rows, so no
    window runs over a whole key: rows are summed per (key, position[0] div span), the few bucket sums
    are accumulated per key, and the rows of a bucket by themselves. Rows with a NULL position come
    first, spread over buckets by the next column. totals: further sums over the whole key, by name.
    """
    first, *rest = position
    spare = F.floor(F.col(rest[0]) / F.lit(span)) if rest else F.lit(0)
    bucket = F.when(F.col(first).isNull(), F.struct(F.lit(0).alias("p"), F.coalesce(spare, F.lit(0)).cast("long").alias("b")))
    bucket = bucket.otherwise(F.struct(F.lit(1).alias("p"), F.floor(F.col(first) / F.lit(span)).cast("long").alias("b")))
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = [F.sum("_value").alias("_sum"), *[F.sum(c).alias(f"_t_{n}") for n, c in (totals or {}).items()]]
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_bucket").agg(*sums).select(
        *keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_t_{n}").over(whole).alias(f"_t_{n}") for n in totals or {}],
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*position).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    return rows.alias("l").join(before.alias("r"), on).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._within")).alias(out),
        *[F.col(f"r._t_{n}").alias(n) for n in totals or {}],
    )


def running_least(df: DataFrame, keys: list[str], position: list[str], value: Column, out: str, span: int = 4096) -> DataFrame:
    """Inclusive running minimum of value per key, in the order of integer columns, as running_sum is made. keys must not be NULL."""
    bucket = F.coalesce(F.floor(F.col(position[0]) / F.lit(span)), F.lit(-(1 << 50)))
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_bucket").agg(F.min("_value").alias("_least")).select(*keys, "_bucket", F.min("_least").over(earlier).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("_within", F.min("_value").over(within)).join(before, [*keys, "_bucket"])
    return joined.select(*df.columns, F.least("_within", F.coalesce("_before", "_within")).alias(out))


class Stretches:
    """Rows of a key in the order of an integer place, in stretches that know the rows before them.

    A key may own a third of all rows, so windows run over stretches of span places; the rows of the reach x depth places before a
    stretch are copied into it. What a row learns from rows before it goes back at most reach places, so any span
    gives the same results; depth is how many of such steps build on each other. All windows share one shuffle and one sort.
    """

    def __init__(self, key: str, place: str, span: int, reach: int, depth: int, tie: str | None = None) -> None:
        self.key, self.place, self.reach = key, place, reach
        self.context = reach * depth
        self.span = max(span, self.context)
        self.tie = tie
        self.window = Window.partitionBy(key, "_part").orderBy(place, *([tie] if tie else []))

    def spread(self, df: DataFrame) -> DataFrame:
        """df with copies of context rows; _own tells the rows themselves."""
        home = F.floor(F.col(self.place) / self.span)
        next_too = F.col(self.place) - home * self.span >= self.span - self.context
        parts = F.explode(F.when(next_too, F.array(home, home + 1)).otherwise(F.array(home)))
        rows = df.withColumn("_part", parts).withColumn("_own", F.col("_part") == home)
        if self.tie is None:
            return rows
        # rows delivered twice follow each other
        same = [F.lag(c).over(self.window).eqNullSafe(F.col(c)) for c in (self.place, self.tie)]
        rows = rows.withColumn("_twin", same[0] & same[1] & F.lag(F.lit(True)).over(self.window).isNotNull())
        return rows.filter("not _twin").drop("_twin")

    def before(self, value: Column) -> Column:
        """The last value before a row that is not NULL and at most reach places back."""
        seen = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(self.place).alias("p")))
        last = F.last(seen, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, -1))
        return F.when(F.col(self.place) - last["p"] <= self.reach, last["v"])


def number_runs(df: DataFrame, stretches: Stretches, opens: Column) -> DataFrame:
    """Own rows of spread rows with _run, the place of the last row that opens, itself included, however far back; NULL before the first.

    The rows are written once; after that, stretches tell each other where their last run began.
    """
    within = stretches.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(opens & F.col("_own"), F.col(stretches.place))
    rows = materialize(df.withColumn("_local", F.max(place).over(within)).filter("_own").drop("_own"), "runs")
    ends = rows.groupBy(stretches.key, "_part").agg(F.max("_local").alias("_end"))
    earlier = Window.partitionBy(stretches.key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_end", F.max("_end").over(earlier))
    joined = rows.join(before, [stretches.key, "_part"])
    return joined.withColumn("_run", F.coalesce("_local", "_end")).drop("_local", "_end", "_part")


def previous(df: DataFrame, keys: list[str], position: list[str], value: str, out: str, span: int = 4096) -> DataFrame:
    """Value of the row before in the order of integer columns, per key, without a window over a whole key.

    Inside a stretch of span positions it is a lag; the first row of a stretch gets the last value of the stretch before.
    """
    first = position[0]
    rows = df.withColumn("_bucket", F.coalesce(F.floor(F.col(first) / F.lit(span)), F.lit(-(1 << 62))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*position)
    rows = rows.withColumn("_lag", F.lag(value).over(inside)).withColumn("_k", F.row_number().over(inside))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*[F.coalesce(p, F.lit(-(1 << 62))).alias(f"p{i}") for i, p in enumerate(position)])).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))["v"]).drop("_last")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    joined = rows.alias("l").join(before.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.when(F.col("l._k") == 1, F.col("r._before")).otherwise(F.col("l._lag")).alias(out))
