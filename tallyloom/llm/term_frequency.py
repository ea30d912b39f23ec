"""Frequency of every distinct term: a vertical layout of compressed record bitmaps.

Each map task turns its records into (term, container) rows. A container holds the record numbers that share their
upper 48 bits, as sorted 16-bit offsets up to ``DENSE`` of them and as a bitmap of 8 KiB beyond; the number of
occurrences travels beside it. Only these combined rows are shuffled - the most common term of the collection costs one
row per 65,536 records of a task - by term and container, so that the containers of a common term spread over tasks. There
they are merged by union and reduced to their cardinality; a term's document frequency is the sum over its containers,
which are disjoint by their number, combined map-side.

The containers are built with Arrow and numpy (``mapInArrow``): Spark's own bitmap aggregates have a fixed 4 KiB per
term and bucket, which is not compressed and unaffordable for the millions of terms that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE = 4096
BLOCK = 2_000_000
COUNTS = ["term", "occurrences", "records"]
CONTAINERS = "term string, container bigint, records bigint, occurrences bigint, bits binary"


def pack(offsets: np.ndarray) -> bytes:
    """Sorted distinct offsets (uint16) as a container."""
    if len(offsets) <= DENSE:
        return offsets.astype("<u2").tobytes()
    marks = np.zeros(65536, np.uint8)
    marks[offsets] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def unpack(bits: bytes, records: int) -> np.ndarray:
    """The offsets in a container of so many records."""
    if records <= DENSE:
        return np.frombuffer(bits, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.uint16)


def union(parts: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    """The union of containers given as (bits, records), and its cardinality."""
    offsets = np.unique(np.concatenate([unpack(b, n) for b, n in parts]))
    return pack(offsets), len(offsets)


def _containers(ids: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    """The containers of one block of records; those of the null term hold every record that has a term."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids = ids[order]
    coded = pc.list_flatten(lists).dictionary_encode()
    parent = rank[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_codes = len(coded.dictionary)
    held = np.unique(parent)
    key = np.sort(np.concatenate([code * len(ids) + parent, n_codes * len(ids) + held]))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    code, record = np.divmod(key[first], len(ids))
    number = ids[record]
    # Two rows of the input may carry the same number (a record that comes in parts): they are one record here.
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (number[1:] != number[:-1])])
    times = np.add.reduceat(times, new)
    code, number = code[new], number[new]
    high, low = number >> 16, (number & 0xFFFF).astype("<u2")
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (high[1:] != high[:-1])])
    end = np.r_[start[1:], len(code)]
    size = end - start
    sparse = size <= DENSE
    # The sparse payloads lie one after the other in ``low`` once the dense ones are cut out.
    data = low[np.repeat(sparse, size)].tobytes()
    offsets = np.concatenate([[0], np.cumsum(2 * size[sparse])]).astype(np.int64)
    rows = np.r_[np.flatnonzero(sparse), np.flatnonzero(~sparse)]
    payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(sparse.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    dense = pa.array([pack(low[start[i] : end[i]]) for i in np.flatnonzero(~sparse)], pa.binary())
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())])
    return pa.record_batch(
        [
            names.take(pa.array(code[start][rows])),
            pa.array(high[start][rows]),
            pa.array(size[rows]),
            pa.array(np.add.reduceat(times, start)[rows]),
            pa.concat_arrays([payload.cast(pa.binary()), dense]),
        ],
        names=["term", "container", "records", "occurrences", "bits"],
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    lists: list[pa.ListArray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            made = _containers(np.concatenate(ids), pa.concat_arrays(lists))
            yield from (made.slice(i, 50_000) for i in range(0, made.num_rows, 50_000))

    for batch in batches:
        terms = batch.column(1)
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        lists.append(terms)
        held += len(pc.list_flatten(terms))
        if held >= BLOCK:
            yield from flush()
            ids, lists, held = [], [], 0
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and container in, one row per term and container out: the cardinality of the union of the
    containers that meet. One container of one term is held at a time."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = _united(batch if carry is None else pa.concat_batches([carry, batch]))
        # The last container may go on in the next batch.
        yield batch.slice(0, batch.num_rows - 1).select(COUNTS)
        carry = batch.slice(batch.num_rows - 1)
    if carry is not None:
        yield carry.select(COUNTS)


def _starts(column: pa.Array) -> np.ndarray:
    filled = pc.coalesce(pc.binary_join_element_wise("t", column, ""), pa.scalar(""))
    return np.r_[True, pc.not_equal(filled[1:], filled[:-1]).to_numpy(zero_copy_only=False)]


def _united(batch: pa.RecordBatch) -> pa.RecordBatch:
    container = batch.column(1).to_numpy()
    new = _starts(batch.column(0))
    new[1:] |= container[1:] != container[:-1]
    start = np.flatnonzero(new)
    if len(start) == batch.num_rows:
        return batch
    end = np.r_[start[1:], batch.num_rows]
    records = batch.column(2).to_numpy().copy()
    times = np.add.reduceat(batch.column(3).to_numpy(), start)
    bits = batch.column(4)
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if b - a == 1:
            out.append(bits[a].as_py())
        else:
            made, records[a] = union([(bits[i].as_py(), int(records[i])) for i in range(a, b)])
            out.append(made)
    rows = pa.array(start)
    return pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(records[start]), pa.array(times), pa.array(out, pa.binary())], names=batch.schema.names)


def term_bitmaps(df: DataFrame, terms: Column | str, record: Column | str | None = None) -> DataFrame:
    """The containers of every term, combined per map task: ``(term, container, records, occurrences, bits)``.

    ``terms`` is an ``array<string>``, ``record`` a bigint that names the record; rows with the same number are parts
    of one record. Without it every row is a record and numbered within its partition. Null arrays, empty arrays and
    null elements have no terms; null ``record`` rows are left out. The rows of term null hold the records with a term.
    """
    terms = df[terms] if isinstance(terms, str) else terms
    record = F.monotonically_increasing_id() if record is None else df[record] if isinstance(record, str) else record
    rows = df.select(record.cast("bigint").alias("record"), terms.alias("terms"))
    rows = rows.select("record", F.array_compact("terms").alias("terms")).where("record is not null and size(terms) > 0")
    return rows.mapInArrow(_build, CONTAINERS)


def term_frequencies(df: DataFrame, terms: Column | str, record: Column | str | None = None) -> DataFrame:
    """``(term, occurrences, records)``: how often each distinct term occurs and in how many records.

    Term null counts the records that have any term (and is absent if there is none). Parameters and the treatment of
    nulls as in :func:`term_bitmaps`; an empty table gives no rows; the order of rows and ties play no part."""
    parts = term_bitmaps(df, terms, record)
    ordered = parts.repartition("term", "container").sortWithinPartitions("term", "container")
    merged = ordered.mapInArrow(_merge, "term string, occurrences bigint, records bigint")
    return merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """``(term, occurrences, records, mark)`` of :func:`term_frequencies`' rows: ``rare`` in at most ``rare_records``
    records, ``common`` in more than ``common_share`` of the records that have a term, null otherwise. A term that is
    both (of a tiny collection) is ``rare``. ``frequencies`` is read twice: pass a written or checkpointed table."""
    total = frequencies.where("term is null").select("records").first()
    many = F.lit(total[0] if total else 0) * F.lit(common_share)
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > many, "common")
    return frequencies.where("term is not null").withColumn("mark", mark)
