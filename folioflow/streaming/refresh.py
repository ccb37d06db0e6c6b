"""Refresh of the catalog from a stream of year lists.

New files of act metadata are read as micro-batches. Each batch updates the newest listing of its acts and
is committed together with its number, so a batch that is delivered again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.incremental import Commit, CommitLog, append_output, newest_listings, read_output
from folioflow.functions.dates import instant_micros

SCHEMA = "eli string, title string, change_date string, text_pdf boolean, text_html boolean, received_at timestamp"


def apply_batch(log: CommitLog, batch: DataFrame, number: int) -> Commit | None:
    """Add the newest listings of one batch to the committed ones; None if the batch is there already."""
    last = log.latest()
    if last and (last.watermark.get("batch") or 0) >= number + 1:
        return None
    rows = batch.select("eli", instant_micros(F.col("change_date")).alias("changed_us"), F.unix_micros("received_at").alias("received_us"), "text_pdf", "text_html")
    version = last.version + 1 if last else 1
    files, _ = append_output(log, last.outputs["listings"] if last else [], newest_listings(rows), version, "listings")
    commit = Commit(version, {"batch": number + 1}, {"listings": files})
    log.commit(commit)
    return commit


def committed_listings(log: CommitLog) -> DataFrame:
    """The newest listing of each act over all committed batches."""
    return newest_listings(read_output(log, "listings"))


def start_refresh(spark: SparkSession, source: str, state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of metadata files (JSON lines) from a folder into the committed listings of a state folder."""
    log = CommitLog(spark, state)
    stream = spark.readStream.schema(SCHEMA).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, number: apply_batch(log, df, number) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def listing_changes(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Distinct changes of acts by the day they were received; a change delivered twice within lateness counts once."""
    seen = stream.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["eli", "change_date"])
    return seen.groupBy(F.window("received_at", "1 day")).agg(F.count("*").alias("changes")).select(F.col("window.start").alias("day"), "changes")
