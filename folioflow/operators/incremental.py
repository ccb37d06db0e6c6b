"""Processing only new or changed records.

Sources carry a clock (an integer such as the time of receipt), which is no commit sequence: rows arrive late, with the clock of
rows that were read long ago, and several have the same. So every run journals the rows that no run has read yet, and the version
of the commit that makes them visible is their commit sequence; it only grows, and whoever reads the journal above a watermark
skips and repeats nothing. What is new is told by digests of the source in blocks of the clock: only blocks whose digest is not the
committed one are read, and of their rows only those not in the journal go on.

A run reads up to a limit of the clock that is fixed when it starts; later rows wait for the next run. Its journal, its output, the
digests and the watermark become visible in one step: files are written under names of their own, then a manifest that names
them is created with a rename that fails if that version exists already. A run that dies before leaves files that no
manifest names; the next one starts from the same state. Two runs at once can't both commit. The rename is atomic on HDFS and
local file systems; an object store needs a committer of its own in place of CommitLog.commit.

What a run writes is in proportion to what is new: outputs are lists of files, merged as the digits of a binary counter are carried, so
that each row is written again a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.dates import instant_micros


class CommitConflict(RuntimeError):
    """Another run has committed this version."""


@dataclass(frozen=True)
class Commit:
    version: int
    watermark: dict[str, int | None]
    #: Files of each output, oldest first, as pairs of path and how often they were merged.
    outputs: dict[str, list]


@dataclass(frozen=True)
class Source:
    """Rows, the name of their clock column, and how wide a block of the clock is."""

    rows: DataFrame
    clock: str
    width: int


class CommitLog:
    """Versions of a state folder, each a manifest with the watermark and the outputs it belongs to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def _version_path(self, version: int):
        return self._path(f"commits/{version:012d}.json")

    def latest(self) -> Commit | None:
        fs = self._fs()
        folder = self._path("commits")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return None
        stream = fs.open(self._version_path(max(versions)))
        try:
            raw = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(raw))

    def output_path(self, version: int, name: str) -> str:
        return f"{self.folder}/data/{version:012d}-{uuid.uuid4().hex}/{name}"

    def commit(self, commit: Commit) -> None:
        fs = self._fs()
        draft = self._path(f"drafts/{uuid.uuid4().hex}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(commit.__dict__), "utf-8"))
        stream.close()
        target = self._version_path(commit.version)
        fs.mkdirs(target.getParent())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        try:
            context.rename(draft, target, options)
        except Exception as e:
            if fs.exists(target):
                raise CommitConflict(f"version {commit.version} is there already") from e
            raise


def above(df: DataFrame, sequence: str, low: int | None, high: int | None) -> DataFrame:
    """Rows of a commit sequence above the watermark low and up to high."""
    seq = F.col(sequence)
    inside = seq <= F.lit(high) if high is not None else F.lit(False)
    return df.filter(inside & (seq > F.lit(low)) if low is not None else inside)


def _digests(rows: DataFrame) -> DataFrame:
    """Count and sum of hashes of the rows of each block: _block, _n, _sum."""
    columns = [c for c in rows.columns if c != "_block"]
    return rows.groupBy("_block").agg(F.count("*").alias("_n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("_sum"))


def _new_rows(source: DataFrame, digests: DataFrame | None, journal: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (with _block) of changed blocks that aren't in the journal yet, each once, and the digests of those blocks."""
    found = _digests(source)
    if digests is None:
        return source.distinct(), found
    # the newest digest of a block holds
    known = digests.groupBy("_block").agg(F.max_by(F.struct("_n", "_sum"), "_version").alias("k")).select("_block", "k.*")
    same = [found[c].eqNullSafe(known[c]) for c in ("_block", "_n", "_sum")]
    changed = found.join(known, same, "left_anti")
    blocks = changed.select(F.col("_block").alias("_b"))
    rows = source.join(blocks, source["_block"].eqNullSafe(blocks["_b"]), "left_semi").distinct()
    seen = journal.join(blocks, journal["_block"].eqNullSafe(blocks["_b"]), "left_semi")
    return rows.join(seen, [rows[c].eqNullSafe(seen[c]) for c in rows.columns], "left_anti"), changed


def append_output(log: CommitLog, old: list, df: DataFrame, version: int, name: str) -> tuple[list, DataFrame]:
    """The files of an output with df added; files of the same age are merged with it. Also df as written, by its version."""
    kept, merged, level = list(old), [], 0
    while kept and kept[-1][1] == level:
        merged.append(kept.pop()[0])
        level += 1
    rows = df.withColumn("_version", F.lit(version))
    for path in merged:
        rows = rows.unionByName(log.spark.read.parquet(path))
    path = log.output_path(version, name)
    rows.write.parquet(path)
    written = log.spark.read.schema(rows.schema).parquet(path)
    return [*kept, [path, level]], written.filter(F.col("_version") == version).drop("_version")


def read_output(log: CommitLog, name: str, commit: Commit | None = None) -> DataFrame:
    """All rows that runs have added to an output, with _version, their commit sequence."""
    commit = commit or log.latest()
    if commit is None:
        raise LookupError("nothing has been committed")
    return log.spark.read.parquet(*[path for path, _ in commit.outputs[name]])


def run_increment(
    log: CommitLog, sources: dict[str, Source],
    process: Callable[[dict[str, DataFrame], dict[str, DataFrame] | None], dict[str, DataFrame]], upper: dict[str, int | None] | None = None,
) -> Commit:
    """One run. process gets the new rows of each source, each row once over all runs, and everything that earlier runs have
    journalled and put out, by name (None at the first run), and returns rows to add to the outputs by name.

    upper fixes the limits of the clocks; the default is the highest clock at the start. Rows without a clock are read by every run
    and go on once as well. Rows delivered twice are one row.
    """
    last = log.latest()
    version = last.version + 1 if last else 1
    high = upper or {n: s.rows.agg(F.max(s.clock)).first()[0] for n, s in sources.items()}
    state = {n: read_output(log, n, last) for n in last.outputs} if last else None
    outputs: dict[str, list] = dict(last.outputs) if last else {}
    batch = {}
    for name, source in sources.items():
        clock = F.col(source.clock)
        limit = clock.isNull() | (clock <= F.lit(high.get(name))) if high.get(name) is not None else clock.isNull()
        rows = source.rows.filter(limit).withColumn("_block", F.floor(clock / source.width))
        new, digests = _new_rows(rows, state[f"{name}_digests"] if state else None, state[name].drop("_version") if state else None)
        for output, df in ((name, new), (f"{name}_digests", digests)):
            outputs[output], written = append_output(log, outputs.get(output, []), df, version, output)
            if output == name:
                batch[name] = written.drop("_block")
    before = {n: df.drop("_block", "_version") if n in sources else df for n, df in state.items()} if state else None
    for name, df in process(batch, before).items():
        outputs[name], _ = append_output(log, outputs.get(name, []), df, version, name)
    # a limit below the watermark must not move it back
    low = last.watermark if last else {}
    mark = {n: max([x for x in (low.get(n), high.get(n)) if x is not None], default=None) for n in sources}
    commit = Commit(version, mark, outputs)
    log.commit(commit)
    return commit


#: A release number as a whole word: more digits, suffixes or further parts make it another one.
VERSION = r"(?:^|[^0-9A-Za-z.])[vV]?(\d+(?:\.\d+)+)(?![0-9A-Za-z]|[.+~_-][0-9A-Za-z])"


def newest_listings(listings: DataFrame) -> DataFrame:
    """The newest listing of each act by change instant: eli, changed_us, received_us, text_pdf, text_html.

    Listings without a readable change date or without an act are ignored. Of listings with the same
    instant the one received last counts, then a true text_html and a false text_pdf.
    """
    order = F.struct(
        F.col("changed_us"), F.coalesce(F.col("received_us"), F.lit(-(1 << 62))),
        F.coalesce(F.col("text_html"), F.lit(False)).alias("html"), ~F.coalesce(F.col("text_pdf"), F.lit(False)),
    )
    picked = F.max_by(F.struct("changed_us", "received_us", "text_pdf", "text_html"), order).alias("x")
    rows = listings.filter("eli is not null and changed_us is not null")
    return rows.groupBy("eli").agg(picked).select("eli", "x.*")


def listing_rows(acts_meta: DataFrame) -> DataFrame:
    return acts_meta.select(
        "eli", instant_micros(F.col("change_date")).alias("changed_us"),
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"), "text_pdf", "text_html",
    )


def attempt_rows(index_log: DataFrame, releases: DataFrame) -> DataFrame:
    """Attempts that settle a listing: status ok and a converter naming a release of the highest output level."""
    top = releases.agg(F.max("output_level").alias("top"))
    best = releases.join(F.broadcast(top), F.col("output_level") == F.col("top")).select("converter_version").distinct()
    done = index_log.filter(F.lower(F.trim("status")) == "ok").select(
        "log_id", "eli", instant_micros(F.col("change_date")).alias("changed_us"),
        F.regexp_extract("converter", VERSION, 1).alias("converter_version"),
    )
    # the table of releases is a fixed list; AQE broadcasts it from its measured size
    return done.filter("eli is not null and changed_us is not null").join(best, "converter_version", "left_semi").select("log_id", "eli", "changed_us")


def plan_process(batch: dict[str, DataFrame], state: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """What one run changes in the refresh plan: eli, changed_us, wanted (text in PDF, none in HTML, newest listing not settled) of the
    acts with a new listing or a new attempt."""
    listings, settled = batch["listings"], batch["attempts"].select("eli", "changed_us")
    touched = listings.select("eli").unionByName(settled.select("eli")).distinct()
    if state:
        listings = listings.unionByName(state["listings"].join(touched, "eli", "left_semi"))
        settled = settled.unionByName(state["attempts"].select("eli", "changed_us").join(touched, "eli", "left_semi"))
    newest = newest_listings(listings)
    done = settled.distinct().withColumn("done", F.lit(True))
    wanted = F.coalesce(F.col("text_pdf") & ~F.coalesce("text_html", F.lit(False)) & F.col("done").isNull(), F.lit(False))
    return {"plan": newest.join(done, ["eli", "changed_us"], "left").select("eli", "changed_us", wanted.alias("wanted"))}


def current_plan(log: CommitLog) -> DataFrame:
    """The committed plan: eli, changed_us of the acts whose last word is that they are wanted."""
    rows = read_output(log, "plan").groupBy("eli").agg(F.max_by(F.struct("changed_us", "wanted"), "_version").alias("x"))
    return rows.filter("x.wanted").select("eli", "x.changed_us")


#: Blocks of the clocks: a day of receipts, and so many attempts.
DAY_US, ATTEMPTS = 86_400_000_000, 65_536


def refresh_plan(log: CommitLog, acts_meta: DataFrame, index_log: DataFrame, releases: DataFrame, upper: dict | None = None) -> DataFrame:
    """One committed run of the refresh plan; returns the committed plan (eli, changed_us).

    A change of the releases reopens settled acts: start a new state folder then, since the attempts
    journalled before were judged by the old list. Rows delivered twice, listings that arrive late with the clock of
    others or none, and ties give one defined plan (see newest_listings).
    """
    sources = {
        "listings": Source(listing_rows(acts_meta), "received_us", DAY_US),
        "attempts": Source(attempt_rows(index_log, releases), "log_id", ATTEMPTS),
    }
    # the limit of the attempts is that of the whole log, not only of the settling rows
    if upper is None:
        highest = index_log.agg(F.max("log_id")).first()[0]
        received = acts_meta.agg(F.unix_micros(F.max("received_at").cast("timestamp"))).first()[0]
        upper = {"listings": received, "attempts": highest}
    run_increment(log, sources, plan_process, upper)
    return current_plan(log)
