"""Frequent itemsets, grown within tasks: nothing is shuffled per set of items that a basket holds.

Items are ordered by their number of baskets, rarest first, and dealt to parts by a hash. A part gets each basket that holds
an item of its own once, from the first such item on, and finds all sets that begin with one of its items: the baskets of a
set, cut to the items after it that are frequent together with it, are what its extensions are counted in. Only frequent
sets leave the task. The result is exact, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.products import expanded
from tallyloom.session import discard, written

PARTS = 24  # enough for the cores of a small cluster
TASK_ROWS = 20_000  # parts aren't made smaller than this to have more tasks
PART_ROWS = 1_000_000  # about the rows of a part, which bound a task's memory
EXPANDED = 500_000  # rows counted at a time, if one set doesn't have more; each size of set holds as many
BATCH = 50_000


def _cuts(work: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole sets, which begin at ``starts``, of about ``EXPANDED`` in ``work`` each."""
    total, low = np.concatenate([[0], np.cumsum(work)]), 0
    ends = np.append(starts[1:], len(work))
    done = total[ends]
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(done, total[starts[low]] + EXPANDED, "right")))
        yield int(starts[low]), int(ends[high - 1])
        low = high


def grown(sets: np.ndarray, of: np.ndarray, items: np.ndarray, begins: np.ndarray, ends: np.ndarray, kinds: int, support: int, max_size: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(sets, supports)`` of all frequent sets that extend a row of ``sets``, a chunk of one size at a time.

    A basket of set ``of[k]`` goes on with ``items[begins[k]:ends[k]]``, numbers below ``kinds`` in an order that all baskets
    share. Sets are finished one range after another, so that what is held grows with their size, not with their number."""
    if max_size is not None and sets.shape[1] >= max_size:
        return
    kept = np.flatnonzero(ends > begins)
    kept = kept[np.bincount(of[kept], minlength=len(sets))[of[kept]] >= support]
    kept = kept[np.argsort(of[kept], kind="stable")]
    of, begins, lengths = of[kept], begins[kept], (ends - begins)[kept]
    for low, high in _cuts(lengths, np.flatnonzero(np.diff(of, prepend=-1))):
        entries = items[expanded(begins[low:high], lengths[low:high])]
        basket = np.repeat(np.arange(low, high), lengths[low:high])
        keys, inverse, counts = np.unique(of[basket] * kinds + entries, return_inverse=True, return_counts=True)
        frequent = counts >= support
        keys, counts = keys[frequent], counts[frequent]
        if not len(keys):
            continue
        larger = np.column_stack([sets[keys // kinds], (keys % kinds).astype(np.int32)])
        yield larger, counts
        held = frequent[inverse]
        entries, basket, number = entries[held], basket[held], (np.cumsum(frequent) - 1)[inverse[held]]
        del keys, inverse, counts, frequent, held
        last = np.append(np.flatnonzero(np.diff(basket)) + 1, len(basket))
        after = np.repeat(last, np.diff(last, prepend=0))
        del basket, last
        yield from grown(larger, number, entries, np.arange(1, len(entries) + 1), after, kinds, support, max_size)


def _extensions(rows: DataFrame, support: int, max_size: int | None) -> DataFrame:
    """``(items, support)``, items in string order: the frequent sets of two or more. ``rows``, a partition per part, has the
    ``items`` of a basket in the order of the sets' growth and ``own``, whether a set may begin with the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got).combine_chunks()
        del got
        lists, own = table["items"].chunk(0), table["own"].chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, items, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64), at - at[0]
        first = np.flatnonzero(own.flatten().to_numpy(zero_copy_only=False))
        ends = at[np.searchsorted(at, first, "right")]
        singles = np.arange(len(names), dtype=np.int32).reshape(-1, 1)
        order = pc.sort_indices(names).to_numpy()
        names, rank = names.take(pa.array(order)), np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        for sets, counts in grown(singles, items[first], items, first + 1, ends, len(names), support, max_size):
            size = sets.shape[1]
            for low in range(0, len(sets), BATCH):
                part = np.sort(rank[sets[low : low + BATCH]], axis=1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, size, dtype=np.int32)), names.take(pa.array(part.ravel())))
                yield pa.RecordBatch.from_arrays([made, pa.array(counts[low : low + BATCH].astype(np.int64))], ["items", "support"])

    return rows.mapInArrow(run, "items array<string>, support bigint")


def frequent_itemsets(df: DataFrame, basket: str, item: str, support: int, min_basket: int = 0, max_size: int | None = None) -> DataFrame:
    """``(size, items, support)``: every set of items that at least ``support`` baskets hold, ``items`` in string order.

    Rows with a null are left out, repeated rows count once, baskets of at most ``min_basket`` items are ignored.
    ``support`` is at least 1. The driver learns only numbers of rows."""
    if support < 1:
        raise ValueError("support must be at least 1")
    rows = df.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()
    distinct = rows = written(rows)
    if min_basket > 0:
        rows = rows.join(rows.groupBy("basket").count().where(F.col("count") > min_basket).select("basket"), "basket", "left_semi")
    singles = written(rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support))
    out = singles.select(F.array("item").alias("items"), "support")
    if max_size is None or max_size > 1:
        ordered = F.sort_array(F.collect_list(F.struct("support", "item")))["item"]
        lists = written(rows.join(singles, "item").groupBy("basket").agg(ordered.alias("items")).where(F.size("items") > 1).select("items"))
        n = F.size("items")
        held, sent = lists.agg(F.sum(n), F.sum(n * F.least((n - 1) / 2, F.lit(PARTS)))).first()
        parts = max(min(PARTS, -(-(held or 0) // TASK_ROWS)), -(-int(sent or 0) // PART_ROWS), 1)
        dealt = lists.withColumn("_parts", F.transform("items", lambda x: F.pmod(F.xxhash64(x), F.lit(parts)).cast("int")))
        # No set begins with the last item of a basket.
        dealt = dealt.withColumn("_part", F.explode(F.array_distinct(F.slice("_parts", F.lit(1), n - 1))))
        first = F.array_position("_parts", F.col("_part")).cast("int")
        dealt = dealt.select(F.slice("items", first, n).alias("items"), F.transform(F.slice("_parts", first, n), lambda x: x == F.col("_part")).alias("own"), "_part")
        out = out.unionByName(_extensions(dealt.repartitionById(parts, F.col("_part")).drop("_part"), support, max_size))
    discard(distinct)
    return out.select(F.size("items").alias("size"), "items", "support")


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """One line of text per size, ``(size, line)``: the sets in order, each in parentheses with its items quoted."""
    shown = F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))
    lines = itemsets.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", shown.alias("shown")))).alias("sets"))
    return lines.select("size", F.array_join(F.transform("sets", lambda s: s["shown"]), ",").alias("line"))
