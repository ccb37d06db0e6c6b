"""Filling containers of fixed capacity with texts, measured in tokens.

Each partition packs its texts in the order they come, with a fixed number of open windows: a text
goes into the window that it fills best; if it fits in none, the fullest window is closed and a new
one opened. What stays open at the end, a fixed number of windows per partition, is merged by
packing the windows themselves in the same way. A text is cut only if it exceeds the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.common import materialize
from folioflow.llm.tokens import VOCABULARY, cut, encoding


class Packer:
    """Bounded-space best fit. add gives the window of an item; closed windows are never used again."""

    def __init__(self, capacity: int, windows: int, first: int = 0) -> None:
        self.capacity, self.windows, self.next = capacity, windows, first
        self.room: list[tuple[int, int]] = []  # (free space, window), ascending

    def add(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                self.room.pop(0)
            free, window = self.capacity, self.next
            self.next += 1
        if free > size:
            insort(self.room, (free - size, window))
        return window

    def open(self) -> set[int]:
        return {w for _, w in self.room}


_SHIFT = 40  # window numbers of one partition


def pack_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048,
    windows: int = 128, vocabulary: str = VOCABULARY, merge_size: int = 50_000,
) -> DataFrame:
    """Container of every text: key, piece_no (from 1), start, end, tokens, container_id.

    start and end are character offsets of the piece in the text; texts of at most capacity tokens are
    one piece. NULL and empty texts need no space: one row each with 0 tokens and a NULL
    container. Every row is an item, also a repeated one. Other columns are left out. merge_size is the
    most open windows that one task merges.
    """
    kind = dict(df.dtypes)[key]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    names = ["_id", "piece_no", "start", "end", "tokens", "_window", "_open"]
    types = [id_type, *[pa.int32()] * 4, pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        packer = Packer(capacity, windows, TaskContext.get().partitionId() << _SHIFT)
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    rows.append((i, 1, 0, 0, 0, None, False))
                    continue
                for no, (a, b, n) in enumerate(cut(enc, t, capacity), 1):
                    window = packer.add(n)
                    held.setdefault(window, []).append((i, no, a, b, n, window))
            opened = packer.open()
            for window in [w for w in held if w not in opened]:
                rows += [(*r, False) for r in held.pop(window)]
            yield _batch(rows, names, types)
        yield _batch([(*r, True) for own in held.values() for r in own], names, types)

    source = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # written once: the numbers of the windows depend on how the partitions came to be
    packed = materialize(
        source.mapInArrow(run, f"_id {kind}, piece_no int, start int, end int, tokens int, _window bigint, _open boolean"), "packed"
    )
    left = packed.filter("_open").groupBy("_window").agg(F.sum("tokens").alias("size"))
    tasks = max(1, -(-left.count() // merge_size))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # beyond the numbers that the first round can have given
        packer = Packer(capacity, merge_size, (1 << 62) + (TaskContext.get().partitionId() << _SHIFT))
        for batch in batches:
            into = [packer.add(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(into, pa.int64())], names=["_window", "_into"])

    spread = left.repartition(tasks, F.xxhash64("_window")) if tasks > 1 else left.coalesce(1)
    # larger windows first leaves the small ones to fill the gaps
    merged = materialize(spread.sortWithinPartitions(F.desc("size"), "_window").mapInArrow(merge, "_window bigint, _into bigint"), "merged")
    whole = packed.join(merged, "_window", "left")
    return whole.select(
        F.col("_id").alias(key), "piece_no", "start", "end", "tokens", F.coalesce("_into", "_window").alias("container_id")
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, tokens, least (containers that the tokens need at least), unused (share of all space)."""
    totals = packed.filter("container_id is not null").agg(
        F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )
    space = F.col("containers") * capacity
    return totals.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"),
        F.when(space > 0, F.round(1 - F.col("tokens") / space, 6)).alias("unused"),
    )
