"""All pairs of sets with what they share, in tiles of two blocks of sets: nothing is emitted per meeting of two members.

The sets are cut into blocks by a hash; a task gets two blocks whole and multiplies them: the few groups that many sets of
both blocks hold as dense matrices, the others by lists of their holders, into counters of one chunk of sets times the other
block. Only pairs that are wanted leave the task, so what is shuffled is the sets, once per block, however hot a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

BLOCK_ROWS = 1_000_000  # rows of a block, which bounds a task's memory
TASK_ROWS = 20_000  # blocks aren't made smaller than this to have more tasks
BLOCKS = 8  # enough tiles for the cores of a small cluster
CELLS = 2_000_000  # counters at a time
EXPANDED = 4_000_000  # meetings at a time
DENSE = 0.01  # a group that holds more of the pairs of sets than this is multiplied as a column of a matrix
MOST_DENSE = 64


@dataclass
class Side:
    """The sets of a block: names, lists of groups (``at`` has their ends) and, if given, a value per entry."""

    names: pa.Array
    at: np.ndarray
    groups: np.ndarray
    values: np.ndarray | None
    rank: np.ndarray | None = None  # of the names of both blocks, in order

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


@dataclass
class Pairs:
    """Pairs of a tile: positions in the two sides, shared groups and, where the sets have values, their moments."""

    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    moments: dict[str, np.ndarray]

    def where(self, kept: np.ndarray) -> Pairs:
        return Pairs(self.left[kept], self.right[kept], self.n[kept], {k: v[kept] for k, v in self.moments.items()})


def expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of every start, ``length`` of each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _side(table: pa.Table) -> Side:
    table = table.combine_chunks()
    lists = table["groups"].chunk(0) if table.num_rows else pa.array([], table["groups"].type)
    at = lists.offsets.to_numpy() if table.num_rows else np.zeros(1, np.int64)
    at = at.astype(np.int64)
    groups = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    values = None
    if "values" in table.column_names:
        held = table["values"].chunk(0) if table.num_rows else pa.array([], table["values"].type)
        values = held.values.to_numpy(zero_copy_only=False)[held.offsets[0].as_py() : held.offsets[-1].as_py()] if table.num_rows else np.zeros(0)
    names = table["name"].chunk(0) if table.num_rows else pa.array([], table["name"].type)
    return Side(names, at - at[0], groups, values)


def _ranked(left: Side, right: Side) -> None:
    names = pa.concat_arrays([left.names, right.names])
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    left.rank, right.rank = rank[: len(left.names)], rank[len(left.names) :]


def _products(left: Side, right: Side, same: bool, min_count: int) -> Iterator[Pairs]:
    """Pairs that share ``min_count`` groups, chunk by chunk; of one block each pair once."""
    width, height = len(right.names), len(left.names)
    if not width or not height:
        return
    kinds, r_group = np.unique(right.groups, return_inverse=True)
    place = np.minimum(np.searchsorted(kinds, left.groups), len(kinds) - 1)
    met = kinds[place] == left.groups
    l_set = np.repeat(np.arange(height), left.sizes)[met]
    l_group, l_value = place[met], left.values[met] if left.values is not None else None
    r_set = np.repeat(np.arange(width), right.sizes)
    share = np.bincount(l_group, minlength=len(kinds)) / height * (r_count := np.bincount(r_group, minlength=len(kinds))) / width
    hot = np.argsort(-share, kind="stable")[:MOST_DENSE]
    hot = hot[share[hot] > DENSE]
    column = np.full(len(kinds), -1)
    column[hot] = np.arange(len(hot))

    def matrix(sets: np.ndarray, groups: np.ndarray, entries: np.ndarray | float, rows: int) -> np.ndarray:
        out, of = np.zeros((rows, len(hot)), np.float64 if isinstance(entries, np.ndarray) else np.float32), column[groups]
        inside = of >= 0
        out[sets[inside], of[inside]] = entries[inside] if isinstance(entries, np.ndarray) else entries
        return out

    l_hot, r_hot = matrix(l_set, l_group, 1.0, height), matrix(r_set, r_group, 1.0, width)
    valued = l_value is not None
    if valued:
        l_stars, r_stars = matrix(l_set, l_group, l_value, height), matrix(r_set, r_group, right.values, width)
    cold = column[l_group] < 0
    l_set, l_group, l_value = l_set[cold], l_group[cold], l_value[cold] if valued else None
    order = np.argsort(r_group, kind="stable")
    holders, starts = r_set[order].astype(np.int64), np.cumsum(r_count) - r_count
    held = right.values[order] if valued else None
    lengths = r_count[l_group]
    work = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(l_set, np.arange(height + 1))]
    entry = np.searchsorted(l_set, np.arange(height + 1))
    rows, low = max(1, CELLS // width), 0
    while low < height:
        high = min(height, low + rows, max(low + 1, int(np.searchsorted(work, work[low] + EXPANDED, "right")) - 1))
        part = slice(entry[low], entry[high])
        at = expanded(starts[l_group[part]], lengths[part])
        keys = np.repeat((l_set[part] - low) * width, lengths[part]) + holders[at]
        cells = (high - low) * width
        if not len(hot) and len(keys) * 20 < cells:
            found, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
            wanted = n >= min_count
            index = np.full(len(found), -1)
            index[wanted] = np.arange(int(wanted.sum()))
            index, found, n = index[inverse], found[wanted], n[wanted]
        else:
            counts = np.bincount(keys, minlength=cells).astype(np.float32)
            if len(hot):
                counts += (l_hot[low:high] @ r_hot.T).ravel()
            found = np.flatnonzero(counts >= min_count)
            n = counts[found].astype(np.int64)
            index = None
        a, b = found // width + low, found % width
        moments: dict[str, np.ndarray] = {}
        if valued:
            if index is None:
                lookup = np.full(cells, -1, np.int32)
                lookup[found] = np.arange(len(found), dtype=np.int32)
                index = lookup[keys]
            kept = index >= 0
            index, x, y = index[kept], np.repeat(l_value[part], lengths[part])[kept], held[at[kept]]
            for name, w in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)):
                moments[name] = np.bincount(index, weights=w, minlength=len(found)).astype(np.float64)  # whole numbers if there are none
            for k in range(len(hot)):
                both = l_hot[a, k] * r_hot[b, k]
                x, y = l_stars[a, k] * both, r_stars[b, k] * both
                for name, w in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)):
                    moments[name] += w
        pairs = Pairs(a, b, n, moments)
        yield pairs.where(a < b) if same else pairs
        low = high


def signatures(side: Side, count: int, n_hashes: int, family: tuple[int, int, int]) -> np.ndarray:
    """What :func:`tallyloom.functions.hashing.modular` gives, the least over each set, the groups being numbers in order."""
    a, b, p = family
    x = side.groups.astype(np.int64)
    return np.stack([np.minimum.reduceat(((a + i) * x + b * i) % p % (2 * count), side.at[:-1]) for i in range(1, n_hashes + 1)], axis=1)


def agreeing(left: np.ndarray, right: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Which pairs agree in one row of their signatures."""
    out = np.zeros(len(pairs.left), bool)
    for low in range(0, len(out), 100_000):
        part = slice(low, low + 100_000)
        out[part] = (left[pairs.left[part]] == right[pairs.right[part]]).any(axis=1)
    return out


def sets_of(rows: DataFrame, group: str, member: str, value: str | None = None, least: int = 1) -> DataFrame:
    """``(name, groups array<bigint>[, values array<double>])`` of the members with ``least`` rows or more; ``group`` is a
    bigint, rows are distinct."""
    if value is None:
        made = rows.groupBy(F.col(member).alias("name")).agg(F.collect_list(group).alias("groups"))
    else:
        made = rows.groupBy(F.col(member).alias("name")).agg(F.collect_list(F.struct(group, value)).alias("e"))
        made = made.select("name", F.col(f"e.{group}").alias("groups"), F.col(f"e.{value}").cast("array<double>").alias("values"))
    return made.where(F.size("groups") >= least)


Tile = Callable[[Side, Side, Iterator[Pairs]], Iterator[pa.RecordBatch]]


def in_tiles(sets: DataFrame, min_count: int, tile: Tile, schema: str) -> DataFrame:
    """What ``tile(left, right, pairs)`` makes of the pairs of sets that share ``min_count`` groups or more, ``pairs`` coming
    in chunks that are short-lived. Every pair of different sets is in one tile, once."""
    sets = written(sets)
    total = sets.agg(F.sum(F.size("groups"))).first()[0] or 0
    blocks = max(min(BLOCKS, -(-total // TASK_ROWS)), -(-total // BLOCK_ROWS), 1)
    cut = sets.withColumn("_block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    number = (high * (high + 1) / 2 + low).cast("int")
    sent = cut.select(*sets.columns, F.when(F.col("_block") == F.col("_other"), F.lit(0)).when(F.col("_block") < F.col("_other"), F.lit(1)).otherwise(F.lit(2)).alias("_side"), number.alias("_tile"))
    sent = sent.repartitionById(blocks * (blocks + 1) // 2, F.col("_tile")).drop("_tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        kind = table["_side"].to_numpy()
        same = bool((kind == 0).any())
        left = _side(table.filter(pa.array(kind <= 1)))
        right = left if same else _side(table.filter(pa.array(kind == 2)))
        del table
        if same:
            left.rank = np.empty(len(left.names), np.int64)
            left.rank[pc.sort_indices(left.names).to_numpy()] = np.arange(len(left.names))
        else:
            _ranked(left, right)
        yield from tile(left, right, _products(left, right, same, min_count))

    return sent.mapInArrow(run, schema)


def named(left: Side, right: Side, pairs: Pairs) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The names of the pairs, the smaller first, and which pairs changed sides for that."""
    turned = left.rank[pairs.left] > right.rank[pairs.right]
    x, y = left.names.take(pa.array(pairs.left)), right.names.take(pa.array(pairs.right))
    if not turned.any():
        return x, y, turned
    mask = pa.array(turned)
    return pc.if_else(mask, y, x), pc.if_else(mask, x, y), turned


BATCH = 50_000


def pair_rows(left: Side, right: Side, pairs: Pairs, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of ``a, b`` and ``columns``, out of ``n``, ``n_a``, ``n_b`` and the moments."""
    for low in range(0, len(pairs.left), BATCH):
        part = Pairs(pairs.left[low : low + BATCH], pairs.right[low : low + BATCH], pairs.n[low : low + BATCH], {k: v[low : low + BATCH] for k, v in pairs.moments.items()})
        a, b, turned = named(left, right, part)
        known = {"n": part.n, **part.moments}
        ends = {"n_a": left.sizes[part.left], "n_b": right.sizes[part.right]}
        known |= {"n_a": np.where(turned, ends["n_b"], ends["n_a"]), "n_b": np.where(turned, ends["n_a"], ends["n_b"])}
        for one, other in (("sx", "sy"), ("sxx", "syy")):
            if one in known:
                known[one], known[other] = np.where(turned, known[other], known[one]), np.where(turned, known[one], known[other])
        yield pa.RecordBatch.from_arrays([a, b, *[pa.array(known[c]) for c in columns]], ["a", "b", *columns])


def shared_pairs(sets: DataFrame, min_count: int, columns: list[str], fit: Callable[[Side, Side, Pairs], np.ndarray] | None = None, signature: tuple[int, int, tuple[int, int, int]] | None = None) -> DataFrame:
    """``(a, b, *columns)``, a before b, of the pairs that share ``min_count`` groups, pass ``fit`` and, with ``signature``
    (number of groups, of hashes, and the family), agree in one row of their MinHash signatures."""
    kinds = {"n": "bigint", "n_a": "bigint", "n_b": "bigint"}
    name = sets.schema["name"].dataType.simpleString()

    def tile(left: Side, right: Side, chunks: Iterator[Pairs]) -> Iterator[pa.RecordBatch]:
        if signature is not None and len(left.names) and len(right.names):
            l_sig = signatures(left, *signature)
            r_sig = l_sig if left is right else signatures(right, *signature)
        for pairs in chunks:
            if fit is not None:
                pairs = pairs.where(fit(left, right, pairs))
            if signature is not None:
                pairs = pairs.where(agreeing(l_sig, r_sig, pairs))
            yield from pair_rows(left, right, pairs, columns)

    schema = f"a {name}, b {name}" + "".join(f", {c} {kinds.get(c, 'double')}" for c in columns)
    return in_tiles(sets, min_count, tile, schema)


def jaccard(left: Side, right: Side, pairs: Pairs) -> np.ndarray:
    return pairs.n / (left.sizes[pairs.left] + right.sizes[pairs.right] - pairs.n)


Measure = Callable[[Pairs], np.ndarray]
FLUSHED = 2_000_000  # pairs at a time


def _first_of(target: Side, near: Side, t: np.ndarray, v: np.ndarray, sim: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """For each target and group that it holds, the first ``top`` of its neighbours that hold it too."""
    rounded = np.round(sim, 9)
    order = np.lexsort((near.rank[v], -rounded, t))
    t, v, sim, rounded = t[order], v[order], sim[order], rounded[order]
    kinds, own = np.unique(target.groups, return_inverse=True)
    place = np.minimum(np.searchsorted(kinds, near.groups), len(kinds) - 1)
    met = kinds[place] == near.groups
    sizes = np.bincount(np.repeat(np.arange(len(near.names)), near.sizes)[met], minlength=len(near.names))
    held, stars = place[met], near.values[met]
    starts = np.cumsum(sizes) - sizes
    lengths, low = sizes[v], 0
    work = np.concatenate([[0], np.cumsum(lengths)])
    distinct, first = np.unique(t, return_index=True)
    first = np.append(first, len(t))
    ends, width = work[first], len(kinds)
    while low < len(distinct):
        high = min(len(distinct), low + max(1, CELLS // width), max(low + 1, int(np.searchsorted(ends, ends[low] + EXPANDED, "right")) - 1))
        part, members = slice(first[low], first[high]), distinct[low:high]
        asked = expanded(target.at[members], target.sizes[members])
        cells = np.repeat(np.arange(high - low) * width, target.sizes[members]) + own[asked]
        lookup = np.full((high - low) * width, -1, np.int32)
        lookup[cells] = np.arange(len(cells), dtype=np.int32)
        at = expanded(starts[v[part]], lengths[part])
        index = lookup[np.repeat(np.searchsorted(members, t[part]) * width, lengths[part]) + held[at]]
        hit = np.flatnonzero(index >= 0)
        index = index[hit]
        by = np.argsort(index, kind="stable")
        index, hit = index[by], hit[by]
        begins = np.flatnonzero(np.diff(index, prepend=-1))
        nth = np.arange(len(index)) - np.repeat(begins, np.diff(np.append(begins, len(index))))
        index, hit = index[nth < top], hit[nth < top]
        pair = np.repeat(np.arange(part.start, part.stop), lengths[part])[hit]
        for k in range(0, len(index), BATCH):
            cut = slice(k, k + BATCH)
            yield pa.RecordBatch.from_arrays(
                [target.names.take(pa.array(t[pair[cut]])), pa.array(target.groups[asked[index[cut]]].astype(np.int64)), near.names.take(pa.array(v[pair[cut]])), pa.array(rounded[pair[cut]]), pa.array(sim[pair[cut]]), pa.array(stars[at[hit[cut]]])],
                ["name", "idx", "near", "rounded", "sim", "stars"],
            )
        low = high


def nearest(sets: DataFrame, min_count: int, top: int, measure: Measure, fit: Callable[[Side, Side, Pairs], np.ndarray] | None = None, signature: tuple[int, int, tuple[int, int, int]] | None = None) -> DataFrame:
    """``(name, idx, near, rounded, sim, stars)``: for each set and each group ``idx`` it holds, the ``top`` sets of greatest
    positive ``measure`` (rounded to nine places, ties to the smaller name) that hold it too, and others of single tiles. The
    pairs of sets are as in :func:`shared_pairs`; they don't leave the task."""

    def tile(left: Side, right: Side, chunks: Iterator[Pairs]) -> Iterator[pa.RecordBatch]:
        if not len(left.names) or not len(right.names):
            return
        if signature is not None:
            l_sig = signatures(left, *signature)
            r_sig = l_sig if left is right else signatures(right, *signature)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            a, b, sim = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            if left is right:
                yield from _first_of(left, left, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim]), top)
            else:
                yield from _first_of(left, right, a, b, sim, top)
                yield from _first_of(right, left, b, a, sim, top)

        for pairs in chunks:
            if fit is not None:
                pairs = pairs.where(fit(left, right, pairs))
            sim = measure(pairs)
            pairs, sim = pairs.where(sim > 0), sim[sim > 0]
            if signature is not None:
                same = agreeing(l_sig, r_sig, pairs)
                pairs, sim = pairs.where(same), sim[same]
            if len(sim):
                kept.append((pairs.left, pairs.right, sim))
            if sum(len(x[0]) for x in kept) > FLUSHED:
                yield from flushed()
        if kept:
            yield from flushed()

    name = sets.schema["name"].dataType.simpleString()
    return in_tiles(sets, min_count, tile, f"name {name}, idx bigint, near {name}, rounded double, sim double, stars double")
