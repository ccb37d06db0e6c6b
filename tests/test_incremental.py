import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.functions.dates import instant_micros
from folioflow.operators import incremental as inc

META = "eli string, change_date string, received_at timestamp_ntz, text_pdf boolean, text_html boolean, eli_year int"
LOG = "log_id long, eli string, change_date string, status string, converter string"


def at(day):
    return dt.datetime(2025, 1, day)


def releases(spark):
    return spark.createDataFrame([("0.1", 1), ("1.0", 2), ("1.10", 2)], "converter_version string, output_level int")


def tables(spark, meta, log):
    return spark.createDataFrame([(*m, 0) for m in meta], META), spark.createDataFrame(log, LOG), releases(spark)


def test_instants(spark):
    same = ["2025-02-03T04:05:06", "2025-02-03T04:05:06Z", "2025-02-03 04:05:06", "2025-02-03T04:05:06.000", "20250203T040506Z",
            "03.02.2025 04:05:06", "2025-02-03T06:05:06+02:00", "2025-02-03T01:05:06-03:00", " 2025-02-03T06:05:06+0200 ", "2025-02-03T06:05:06+02"]
    bad = [None, "", "brak", "0000-00-00", "2025-13-01", "2025-02-30T00:00:00", "31.31.2025 01:02:03"]
    df = spark.createDataFrame([(x,) for x in same + bad], "s string").select(instant_micros(F.col("s")).alias("u"))
    got = [r.u for r in df.collect()]
    assert set(got[: len(same)]) == {1738555506000000} and got[len(same):] == [None] * len(bad)


def test_plan(spark, tmp_path):
    meta = [
        ("A", "2025-01-01T00:00:00", at(1), True, False), ("A", "2025-01-02T00:00:00+01:00", at(2), True, None),
        ("B", "2025-01-01T00:00:00", at(1), True, True), ("C", "2025-01-01T00:00:00", at(1), False, False),
        ("D", "brak", at(1), True, False), ("E", "2025-01-05T00:00:00", at(3), True, False), (None, "2025-01-05", at(3), True, False),
        ("F", "2025-01-05T00:00:00", at(3), True, False), ("F", "2025-01-05T00:00:00", at(3), True, False), ("G", "2025-01-05T00:00:00Z", None, True, False),
    ]
    log = [
        (1, "A", "2025-01-01T00:00:00", "ok", "x 1.0"), (2, "E", "2025-01-05 00:00:00", " OK", "x-1.10 (batch)"),
        (3, "F", "2025-01-05T00:00:00", "ok", "x 1.0.1"), (4, "F", "2025-01-05T00:00:00", "ok", "x 1.0rc1"), (5, "F", None, "ok", "1.0"),
        (6, "F", "2025-01-05T00:00:00", "not ok", "1.0"), (7, "F", "2025-01-05T00:00:00", "ok", "0.1"), (8, None, None, None, None),
    ]
    log_ = inc.CommitLog(spark, f"file://{tmp_path}/s")
    args = tables(spark, meta, log)
    once = {r.eli for r in inc.refresh_plan(log_, *args).collect()}
    assert once == {"A", "F", "G"}
    other = inc.CommitLog(spark, f"file://{tmp_path}/t")
    day = int(dt.datetime(2025, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    first = {r.eli for r in inc.refresh_plan(other, *args, {"listings": day, "attempts": 1}).collect()}
    assert first == {"A", "G"}
    assert {r.eli for r in inc.refresh_plan(other, *args).collect()} == once
    # nothing new: the same plan, one more version
    assert {r.eli for r in inc.refresh_plan(other, *args).collect()} == once
    assert other.latest().version == 3


def test_failure_changes_nothing(spark, tmp_path):
    log = inc.CommitLog(spark, f"file://{tmp_path}/s")
    source = inc.Source(spark.range(10).withColumnRenamed("id", "seq"), "seq", 4)
    keep = lambda batch, state: {"rows": batch["s"]}
    inc.run_increment(log, {"s": source}, keep, {"s": 4})

    def broken(batch, state):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        inc.run_increment(log, {"s": source}, broken, {"s": 7})
    assert log.latest().watermark == {"s": 4} and inc.read_output(log, "rows").count() == 5
    # dies after writing its output, before the commit
    def dies(batch, state):
        return {"rows": batch["s"], "late": batch["s"].select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}

    assert inc.read_output(log, "rows").count() == 5

    with pytest.raises(Exception):
        inc.run_increment(log, {"s": source}, dies, {"s": 7})
    assert inc.read_output(log, "rows").count() == 5
    inc.run_increment(log, {"s": source}, keep)
    assert sorted(r.seq for r in inc.read_output(log, "rows").collect()) == list(range(10))


def test_two_runs_cannot_both_commit(spark, tmp_path):
    log = inc.CommitLog(spark, f"file://{tmp_path}/s")
    log.commit(inc.Commit(1, {"s": 1}, {}))
    with pytest.raises(inc.CommitConflict):
        log.commit(inc.Commit(1, {"s": 9}, {}))
    assert log.latest().watermark == {"s": 1}


def test_empty(spark, tmp_path):
    log = inc.CommitLog(spark, f"file://{tmp_path}/s")
    assert inc.refresh_plan(log, *tables(spark, [], [])).count() == 0
    with pytest.raises(LookupError):
        inc.read_output(inc.CommitLog(spark, f"file://{tmp_path}/none"), "plan")


def test_late_rows_and_ties(spark, tmp_path):
    log = inc.CommitLog(spark, f"file://{tmp_path}/s")
    given: list[list] = []

    def run(rows, upper=None):
        df = spark.createDataFrame(rows, "clock long, what string")
        inc.run_increment(log, {"s": inc.Source(df, "clock", 10)}, lambda batch, state: given.append(sorted(map(str, (r.what for r in batch["s"].collect())))) or {"rows": batch["s"]}, upper)

    first = [(5, "a"), (5, "b"), (17, "c"), (17, "c"), (None, "n"), (30, "later")]
    run(first, {"s": 17})
    # with the watermark's own clock, an earlier one, in a block of its own and without one
    late = [*first, (17, "tie"), (3, "early"), (25, "d"), (None, "m"), (17, None)]
    run(late, {"s": 25})
    run(late, {"s": 25})
    run(late)
    run(late + [(30, "end"), (5, "a")])
    assert given == [["a", "b", "c", "n"], ["None", "d", "early", "m", "tie"], [], ["later"], ["end"]]
    rows = inc.read_output(log, "rows")
    assert rows.count() == rows.distinct().count() == 11
    # the journal's commit sequence is read by a watermark
    assert {r.what for r in inc.above(inc.read_output(log, "s"), "_version", 1, 2).collect()} == {"d", "early", "m", "tie", None}
    assert log.latest().watermark == {"s": 30}


def test_written_in_proportion(spark, tmp_path):
    log = inc.CommitLog(spark, f"file://{tmp_path}/s")
    written = []
    for k in range(1, 17):
        commit = inc.run_increment(log, {"s": inc.Source(spark.range(k * 1000).withColumnRenamed("id", "seq"), "seq", 1000)}, lambda batch, state: {})
        path = commit.outputs["s"][-1][0]
        written.append(spark.read.parquet(path).count())
        assert len(commit.outputs["s"]) == bin(k).count("1")
    # each row is written once, and again once for each doubling
    assert sum(written) <= 16_000 * 5 and written[0] == written[2] == 1000 and written[15] == 16_000
    assert inc.read_output(log, "s").count() == 16_000
