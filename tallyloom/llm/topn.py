"""The N best items of every group: sorted runs, merged by a loser tree that seeks to the next group after N outputs.

Each task sorts its rows by bucket, group and score (Spark's sort, which spills) and keeps the first N of a group: a run.
Runs are packed per bucket in chunks and shuffled; one task merges the runs of a bucket. A group of any size sends at most
N rows per task, and the number of buckets follows the number of rows, so that a bucket holds about ``BUCKET_ROWS`` of
them. A bucket stays in Arrow's form; of every run one chunk at a time becomes Python values, when the merge gets there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyloom.session import written

CHUNK = 10_000
BUCKET_ROWS = 50_000


class LoserTree:
    """A tournament over the heads of sorted runs: inner nodes hold the loser of their match, so the next head of the
    winning run is replayed along one path."""

    def __init__(self, heads: list) -> None:
        self.heads = heads
        self.k = len(heads)
        self.losers = [-1] * self.k
        self.winner = -1
        for run in range(self.k - 1, -1, -1):
            self._replay(run, fresh=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return x is not None or a < b
        return x is not None and (x, a) < (y, b)

    def _replay(self, run: int, fresh: bool = False) -> None:
        node = (run + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:
                if fresh:  # nobody to play yet: wait here
                    self.losers[node] = run
                    return
            elif self._beats(other, run):
                self.losers[node], run = run, other
            node >>= 1
        self.winner = run

    def replace(self, head) -> None:
        """The winning run goes on with ``head``; None ends it."""
        run = self.winner
        self.heads[run] = head
        self._replay(run)


class Run:
    """A sorted run of tuples whose first member is the group, read chunk by chunk. ``head`` is None at its end."""

    def __init__(self, chunks: Iterable[list[tuple]]) -> None:
        self.chunks = iter(chunks)
        self.rows: list[tuple] = []
        self.at = 0
        self._settle()

    def _settle(self) -> None:
        while self.at >= len(self.rows) and (rows := next(self.chunks, None)) is not None:
            self.rows, self.at = rows, 0
        self.head = self.rows[self.at] if self.at < len(self.rows) else None

    def advance(self) -> None:
        self.at += 1
        self._settle()

    def seek_past(self, group) -> None:
        """To the first entry of a later group."""
        while self.head is not None and self.head[0] == group:
            self.at = bisect_right(self.rows, group, self.at, key=lambda entry: entry[0])
            self._settle()


def merge_top(runs: list[Run | list[tuple]], n: int) -> Iterator[tuple]:
    """The first ``n`` entries of each group of sorted runs of tuples whose first member is the group, in order."""
    runs = [run if isinstance(run, Run) else Run([run]) for run in runs]
    tree = LoserTree([run.head for run in runs])
    group, given = object(), 0
    while runs and (entry := tree.heads[tree.winner]) is not None:
        run = runs[tree.winner]
        if entry[0] != group:
            group, given = entry[0], 0
        if given < n:
            yield entry
            given += 1
            run.advance()
        else:
            run.seek_past(group)
        tree.replace(run.head)


def _runs(n: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        carry, given = None, 0
        chunks: list[pa.RecordBatch] = []
        held, seq = 0, 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal chunks, held, seq
            rows = pa.Table.from_batches(chunks).combine_chunks()
            bucket = rows.column("bucket").to_numpy()
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            offsets = pa.array(np.r_[start, len(bucket)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("g", "score", "item")]
            yield pa.record_batch([pa.array(bucket[start]), pa.array(np.full(len(start), run)), pa.array(np.full(len(start), seq)), *lists], names=["bucket", "run", "seq", "g", "score", "item"])
            chunks, held, seq = [], 0, seq + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(1)
            new = np.r_[True, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)]
            first = np.flatnonzero(new)
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.r_[first, batch.num_rows]))
            if carry is not None and g[0].as_py() == carry:
                place[: first[1] if len(first) > 1 else None] += given
            carry, given = g[-1].as_py(), int(place[-1]) + 1
            kept = batch.filter(pa.array(place < n))
            if kept.num_rows:
                chunks.append(kept)
                held += kept.num_rows
            if held >= CHUNK:
                yield from pack()
        if chunks:
            yield from pack()

    return build


def _chunks(parts: list[tuple[pa.RecordBatch, int]]) -> Iterator[list[tuple]]:
    """The chunks of a run as sortable tuples (group, is null, -score, is null, item), made when asked for."""
    for batch, row in parts:
        g, score, item = (batch.column(c)[row].values.to_pylist() for c in ("g", "score", "item"))
        yield [(g_, s is None, -s if s is not None else 0, i is None, i) for g_, s, i in zip(g, score, item, strict=True)]


def _merge(n: int, schema: pa.Schema):
    def merge_bucket(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple[pa.RecordBatch, int]]] = {}
        for batch in parts:
            for row, run in enumerate(batch.column("run").to_pylist()):
                runs.setdefault(run, []).append((batch, row))
        merged = merge_top([Run(_chunks(own)) for own in runs.values()], n)
        rank, last = 0, object()
        while out := list(islice(merged, CHUNK)):
            ranks = []
            for entry in out:
                rank = rank + 1 if entry[0] == last else 1
                last = entry[0]
                ranks.append(rank)
            columns = [[e[0] for e in out], [e[4] for e in out], [None if e[1] else -e[2] for e in out], ranks]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for a, b in zip(start, [*start[1:], len(of)], strict=True):
                if of[a] != bucket:
                    yield from merge_bucket(parts)
                    bucket, parts = of[a], []
                parts.append(batch.slice(a, b - a))
        yield from merge_bucket(parts)

    return merge


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(group, item, score, rank)``: for each group the ``n`` rows with the highest score, ties to the smaller item.

    A null group is none; a null or NaN score ranks below all others, a null item after all others of its score; equal
    rows count each. ``score`` is numeric; an empty table or ``n`` of 0 gives no rows. The three columns are written once,
    which gives the number of rows and so the number of buckets that the groups are hashed into."""
    s = df[score]
    if dict(df.dtypes)[score] in ("double", "float"):
        s = F.when(~F.isnan(s), s)
    rows = written(df.select(df[group].alias("g"), s.alias("score"), df[item].alias("item")).where("g is not null"))
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"), "g", "score", "item")
    rows = rows.sortWithinPartitions("bucket", "g", F.desc_nulls_last("score"), F.asc_nulls_last("item"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = rows.mapInArrow(_runs(n), f"bucket int, run bigint, seq bigint, g array<{kinds['g']}>, score array<{kinds['score']}>, item array<{kinds['item']}>")
    packed = packed.repartition("bucket").sortWithinPartitions("bucket", "run", "seq")
    out = StructType([StructField(group, rows.schema["g"].dataType), StructField(item, rows.schema["item"].dataType), StructField(score, rows.schema["score"].dataType), StructField("rank", IntegerType())])
    return packed.mapInArrow(_merge(n, to_arrow_schema(out)), out)
