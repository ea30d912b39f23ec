import itertools
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from tallyloom.operators import itemsets


def counted(held, support):
    """All frequent sets of ``(basket, item)`` by brute force."""
    baskets, out = defaultdict(set), Counter()
    for b, i in held:
        baskets[b].add(i)
    for items in baskets.values():
        for size in range(1, len(items) + 1):
            out.update(itertools.combinations(sorted(items), size))
    return {(len(s), s, n) for s, n in out.items() if n >= support}


def rows_of(df):
    return [(r["size"], tuple(r["items"]), r["support"]) for r in df.collect()]


@pytest.mark.parametrize("expanded", [1, 7, 500_000])
@pytest.mark.parametrize("max_size", [None, 3])
def test_sets_grown_in_chunks(monkeypatch, expanded, max_size):
    monkeypatch.setattr(itemsets, "EXPANDED", expanded)
    r = Random(expanded)
    baskets = [sorted(r.sample(range(9), r.randint(0, 9))) for _ in range(40)]
    items = np.array([i for b in baskets for i in b])
    ends = np.repeat(np.cumsum([len(b) for b in baskets]), [len(b) for b in baskets])
    singles = np.arange(9, dtype=np.int32).reshape(-1, 1)
    found = [(len(s), tuple(s.tolist()), int(n)) for sets, counts in itemsets.grown(singles, items, items, np.arange(1, len(items) + 1), ends, 9, 4, max_size) for s, n in zip(sets, counts, strict=True)]
    wanted = {w for w in counted([(k, i) for k, b in enumerate(baskets) for i in b], 4) if 1 < w[0] <= (max_size or 9)}
    assert len(found) == len(wanted) and set(found) == wanted


def test_itemsets_leave_the_tasks_finished(spark, monkeypatch):
    """Eight baskets that share ten items hold 252 sets of five each; no table or shuffle has a row per basket and set."""
    r = Random(5)
    held = {(f"u{b}", f"s{k}") for b in range(8) for k in range(10)} | {(f"v{b}", f"n{r.randrange(12)}") for b in range(40) for _ in range(3)}
    sizes, real = [], itemsets.written

    def recorded(df):
        made = real(df)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(itemsets, "written", recorded)
    made = itemsets.frequent_itemsets(spark.createDataFrame(sorted(held), "b string, i string"), "b", "i", 8)
    assert set(rows_of(made)) == counted(held, 8)
    assert max(sizes) <= len(held)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan


@pytest.mark.parametrize("part_rows", [5, 1_000_000])
def test_itemsets_over_many_parts_and_odd_items(spark, monkeypatch, part_rows):
    monkeypatch.setattr(itemsets, "TASK_ROWS", 1)
    monkeypatch.setattr(itemsets, "PART_ROWS", part_rows)
    r, names = Random(part_rows), ["", " ", ",", "a,b", "a", "b", "é", "é", "\U0001f600", "￿", "10", "9", "\x00"]
    held = {(b, i) for b in range(30) for i in r.sample(names, r.randint(1, 7))} | {(99, i) for i in names}
    found = rows_of(itemsets.frequent_itemsets(spark.createDataFrame([*held, (None, "a"), (3, None)], "b int, i string"), "b", "i", 3))
    by_bytes = {(k, tuple(sorted(s, key=str.encode)), n) for k, s, n in counted(held, 3)}
    assert len(found) == len(by_bytes) and set(found) == by_bytes
