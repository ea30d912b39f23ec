"""Filling containers of fixed capacity: bin completion by branch and bound.

Items are spread over groups of about ``GROUP`` by a hash, so that each group is a fair sample of all sizes, and each
group is packed on its own; the price is less than one partly filled container per group. Within a group the largest
item left is completed by undominated fillings, enumerated as they are asked for, a few at a time with the least waste
first; a node goes on with its further fillings when the search comes back to it, so none is left out. Best-fit decreasing
gives the first incumbent; a branch is cut as soon as its waste exceeds what a better solution could still afford, and the
search ends at a lower bound of the number of containers, or after ``STEPS`` steps with the best solution so far. No item
is ever left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

GROUP = 4096
GROUPS_PER_TASK = 32
STEPS = 100_000
SORTED = 6  # fillings that are put in order of their waste before they are branched on


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``sizes`` in falling order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for s in sizes:
        i = bisect_left(room, (s, -1))
        if i == len(room):
            left, b = capacity, len(bins)
            bins.append([])
        else:
            left, b = room.pop(i)
        bins[b].append(s)
        insort(room, (left - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The bound of Martello and Toth; ``sizes`` in falling order. With a limit k of at most half the capacity, items above
    capacity - k share with nobody that counts, items above half the capacity never meet, and what is left of the room
    beside the latter has to take the items from k on."""
    rising = sizes[::-1]
    below = [0, *accumulate(rising)]
    half = bisect_right(rising, capacity // 2)
    best = -(-below[-1] // capacity)
    for k in set(rising[:half]):
        first, alone = bisect_left(rising, k), bisect_right(rising, capacity - k)
        room = (alone - half) * capacity - (below[alone] - below[half])
        best = max(best, len(rising) - half + max(0, -(-(below[half] - below[first] - room) // capacity)))
    return best


class _Budget:
    def __init__(self, steps: int) -> None:
        self.left = steps


def _fillings(sizes: list[int], counts: list[int], room: int, most_waste: int, budget: _Budget) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """Every undominated filling of ``room`` that wastes at most ``most_waste``, as (waste, ((index of size, times), ...)).

    ``sizes`` are distinct and rising, ``counts`` how many of each are left. A size is taken as often as it fits, then once
    less, down to never; what can't be filled up well enough any more, or would leave room for an item passed over, is cut."""
    below = [0, *accumulate(s * c for s, c in zip(sizes, counts, strict=True))]
    taken: list[list[int]] = []  # [index, times, room before], from the largest size down

    def descend(index: int, room: int) -> None:
        """Takes as much as fits of every size below ``index``."""
        while True:
            index = min(index, bisect_right(sizes, room)) - 1
            while index >= 0 and not counts[index]:
                index -= 1
            if index < 0:
                return
            taken.append([index, min(counts[index], room // sizes[index]), room])
            room -= taken[-1][1] * sizes[index]

    descend(len(sizes), room)
    while True:
        budget.left -= 1
        if budget.left < 0:
            return
        waste = taken[-1][2] - taken[-1][1] * sizes[taken[-1][0]] if taken else room
        if waste <= most_waste:
            chosen = {i: n for i, n, _ in taken if n}
            if _undominated(sizes, counts, chosen, waste):
                yield waste, tuple(chosen.items())
        while taken:
            top = taken[-1]
            if not top[1]:
                taken.pop()
                continue
            top[1] -= 1
            left = top[2] - top[1] * sizes[top[0]]
            # Items below have to fill it up to less than the item just passed over, and well enough.
            if left - below[top[0]] <= min(most_waste, sizes[top[0]] - 1):
                descend(top[0], left)
                break
            taken.pop()
        else:
            return


def _undominated(sizes: list[int], counts: list[int], chosen: dict[int, int], waste: int) -> bool:
    """No item left fits beside the chosen ones, and none of them can be exchanged for a larger one that is left."""
    left = lambda i: counts[i] - chosen.get(i, 0)
    if any(left(i) for i in range(bisect_right(sizes, waste))):
        return False
    return not any(left(j) for i in chosen for j in range(i + 1, bisect_right(sizes, sizes[i] + waste)))


def _ordered(fillings: Iterator) -> Iterator:
    while some := sorted(islice(fillings, SORTED)):
        yield from some


def bin_completion(sizes: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Containers, each a list of sizes of at most ``capacity`` together; sizes are 1 to ``capacity``."""
    sizes = sorted(sizes, reverse=True)
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = lower_bound(sizes, capacity)
    if len(best) <= least:
        return best
    budget, fewest, held = _Budget(steps), len(best), Counter(sizes)
    kinds = sorted(held)

    def node(counts: list[int], packed, number: int, waste: int):
        """A state of the search: the largest item left, and the fillings to go beside it."""
        top = max(i for i, c in enumerate(counts) if c)
        counts[top] -= 1
        affordable = (fewest - 1) * capacity - total - waste
        return counts, packed, number, waste, top, _ordered(_fillings(kinds, counts, capacity - kinds[top], affordable, budget))

    # Depth first, with an explicit stack: a group may need more containers than Python has stack.
    stack = [node([held[k] for k in kinds], None, 0, 0)]
    while stack and budget.left > 0 and fewest > least:
        counts, packed, number, waste, top, options = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        more, filling = option
        if waste + more > (fewest - 1) * capacity - total:
            continue
        after = counts.copy()
        for i, n in filling:
            after[i] -= n
        made = (packed, (top, filling))
        if any(after):
            stack.append(node(after, made, number + 1, waste + more))
        elif number + 1 < fewest:
            fewest, best = number + 1, []
            while made:
                made, (top, filling) = made
                best.append([kinds[top], *(kinds[i] for i, n in filling for _ in range(n))])
    return best


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["size"].tolist()
        held = [s for s in sizes if s > 0]
        waiting: dict[int, list[int]] = {}
        for number, members in enumerate(bin_completion(held, capacity)):
            for s in members:
                waiting.setdefault(s, []).append(number)
        # Equal sizes are alike: they take the places of their size in order. What is empty goes into the first container.
        places = [waiting[s].pop() if s else 0 for s in sizes]
        group = int(pdf["bin_group"].iloc[0])
        return pdf.assign(container=[(group << 31) + p for p in places])[["key", "piece", "start", "size", "container"]]

    return run


def packed(sizes: DataFrame, key: str, size: str, capacity: int, group_size: int = GROUP) -> DataFrame:
    """``(key, piece, start, size, container)``: every item of ``sizes`` (``key``, ``size`` in whole units) in a container
    of at most ``capacity`` units together.

    An item is cut only if it alone exceeds the capacity: into pieces of ``capacity`` and a rest, ``piece`` counting from
    0 and ``start`` being its offset. Items of size 0 take no room and go into the first container of their group; a null
    size counts as 0. Repeated keys are items of their own. Container numbers are unique and not contiguous. An empty
    table gives no rows. The same input in the same partitions gives the same containers."""
    rows = sizes.select(sizes[key].alias("key"), F.coalesce(sizes[size].cast("bigint"), F.lit(0)).alias("total"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / capacity) - 1)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece") * capacity
    rows = written(rows.select("key", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).cast("bigint").alias("size")))
    groups = max(1, round(rows.count() / group_size))
    # Repeated keys would all meet in one group; their place in the written table sets them apart.
    grouped = rows.withColumn("bin_group", F.pmod(F.xxhash64("key", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    # As many tasks as the search is work for; by bytes all groups would be one.
    sc = sizes.sparkSession.sparkContext
    grouped = grouped.repartition(min(groups, max(4 * sc.defaultParallelism, groups // GROUPS_PER_TASK)), "bin_group")
    kind = rows.schema["key"].dataType.simpleString()
    out = grouped.groupBy("bin_group").applyInPandas(_pack(capacity), f"key {kind}, piece bigint, start bigint, size bigint, container bigint")
    return out.select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", F.col("size").alias(size), "container")
