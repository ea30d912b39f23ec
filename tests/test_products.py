from collections import defaultdict
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.functions.hashing import ITEMS, USERS
from tallyloom.operators import cf, graph, products, similarity


def made(seed, members=120, groups=60):
    """Sets with two groups that most hold, as ``member -> {group: stars}``."""
    r = Random(seed)
    out = {}
    for m in range(members):
        held = {g for g in range(groups) if r.random() < (0.8 if g < 2 else 0.07)}
        out[f"m{m}"] = {f"g{g:02}": r.randint(2, 10) / 2 for g in held} or {"g05": 1.0}
    return out


def frame(spark, sets, member="m", group="g"):
    return spark.createDataFrame([(m, g, s) for m, held in sets.items() for g, s in held.items()], f"{member} string, {group} string, stars double")


def signature(held, order, family, hashes=30):
    a, b, p = family
    return [min(((a + i) * order[g] + b * i) % p % (2 * len(order)) for g in held) for i in range(1, hashes + 1)]


def order_of(sets):
    return {g: k for k, g in enumerate(sorted({g for held in sets.values() for g in held}))}


def above_arrow(df):
    """The plan's nodes above the tiles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("MapInArrow")]


def side(sets):
    names = list(sets)
    order = order_of(sets)
    groups = [order[g] for m in names for g in sets[m]]
    at = np.cumsum([0, *[len(sets[m]) for m in names]])
    return products.Side(pa.array(names), at, np.array(groups), np.array([s for m in names for s in sets[m].values()]), np.argsort(np.argsort(names)))


@pytest.mark.parametrize("cells,many,dense", [(2_000_000, 4_000_000, 0.01), (500, 300, 0.01), (500, 300, 2.0), (1, 1, 0.3), (20_000, 300, 2.0)])
def test_products_in_chunks(monkeypatch, cells, many, dense):
    for name, value in (("CELLS", cells), ("EXPANDED", many), ("DENSE", dense)):
        monkeypatch.setattr(products, name, value)
    sets = made(1)
    one = side(sets)
    names = one.names.to_pylist()
    got = {}
    for pairs in products._products(one, one, True, 3):
        for k, (a, b, n) in enumerate(zip(pairs.left, pairs.right, pairs.n, strict=True)):
            assert (a, b) not in got
            got[a, b] = (n, *[pairs.moments[c][k] for c in ("sx", "sy", "sxx", "syy", "sxy")])
    want = {}
    for a, b in combinations(range(len(names)), 2):
        x, y = sets[names[a]], sets[names[b]]
        both = [(x[g], y[g]) for g in x if g in y]
        if len(both) >= 3:
            want[a, b] = (len(both), sum(p for p, _ in both), sum(q for _, q in both), sum(p * p for p, _ in both), sum(q * q for _, q in both), sum(p * q for p, q in both))
    assert got == want


@pytest.mark.parametrize("rows", [20_000, 100])
def test_similar_pairs_leave_the_tiles_finished(spark, monkeypatch, rows):
    monkeypatch.setattr(products, "TASK_ROWS", rows)
    sets = made(2)
    order = order_of(sets)
    sig = {m: signature(held, order, USERS) for m, held in sets.items()}
    agree = {(a, b) for a, b in combinations(sorted(sets), 2) if any(x == y for x, y in zip(sig[a], sig[b], strict=True))}
    shares = {(a, b): len(sets[a].keys() & sets[b].keys()) / len(sets[a].keys() | sets[b].keys()) for a, b in agree}
    found = similarity.similar_pairs(frame(spark, sets), "m", "g", USERS, threshold=0.3)
    assert {(r["b1"], r["b2"]): r["sim"] for r in found.collect()} == {k: v for k, v in shares.items() if v >= 0.3}
    assert "Exchange" not in above_arrow(found) and "Join" not in above_arrow(found)
    listed = similarity.lsh_candidates(similarity.minhash(frame(spark, sets), "m", "g", USERS), "m")
    assert sorted(map(tuple, listed.collect())) == sorted(agree)
    assert "Exchange" not in above_arrow(listed)
    wide = similarity.lsh_candidates(similarity.minhash(frame(spark, sets), "m", "g", USERS), "m", 30, 15)
    two = {(a, b) for a, b in combinations(sorted(sets), 2) if any(sig[a][k : k + 2] == sig[b][k : k + 2] for k in range(0, 30, 2))}
    assert sorted(map(tuple, wide.collect())) == sorted(two)


@pytest.mark.parametrize("entity,other,jaccard,family", [("item", "user", None, None), ("user", "item", 0.05, ITEMS)])
def test_predictions_without_a_written_model(spark, monkeypatch, entity, other, jaccard, family):
    monkeypatch.setattr(products, "TASK_ROWS", 200)
    sets = made(3)
    rated = frame(spark, sets, entity, other)
    order = order_of(sets)
    model = cf.pearson_pairs(rated, entity, other, min_jaccard=jaccard, family=family)
    assert "Exchange" not in above_arrow(model) and "Join" not in above_arrow(model)
    sims = {(r["a"], r["b"]): r["sim"] for r in model.collect()}
    sig = {m: signature(held, order, ITEMS) for m, held in sets.items()}
    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a].keys() & sets[b].keys())
        fits = jaccard is None or shared / len(sets[a].keys() | sets[b].keys()) > jaccard and any(x == y for x, y in zip(sig[a], sig[b], strict=True))
        if (a, b) in sims:
            assert shared >= 3 and fits
    near = defaultdict(list)
    for (a, b), s in sims.items():
        near[a].append((-round(s, 9), b, s))
        near[b].append((-round(s, 9), a, s))
    want = set()
    for m, held in sets.items():
        for g in held:
            for _, v, s in [x for x in sorted(near[m]) if g in sets[x[1]]][:3]:
                want.add((m, g, v, sets[v][g], round(s**2.5, 9)))
    got = cf.nearest_rated(rated, entity, other, min_jaccard=jaccard, family=family).select(entity, other, "stars", "w").collect()
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == sorted((m, g, s, w) for m, g, _, s, w in want)
    ready = rated.select("user", "item", "stars")
    if entity == "item":
        asked, ours = cf.predict_item_based(ready, ready, model), cf.predict_rated_item_based(ready)
    else:
        asked, ours = cf.predict_user_based(ready, ready, model), cf.predict_rated_user_based(ready, jaccard, family)
    key = lambda df: sorted((r["user"], r["item"], round(r["stars"], 6)) for r in df.collect())
    assert key(ours) == key(asked)


def test_edges_leave_the_tiles_finished(spark):
    sets = made(4)
    edges = graph.cooccurrence_edges(frame(spark, sets), "m", "g", 4)
    shared = {(a, b): len(sets[a].keys() & sets[b].keys()) for a, b in combinations(sorted(sets), 2)}
    assert sorted(map(tuple, edges.collect())) == sorted((a, b, n) for (a, b), n in shared.items() if n >= 4)
    assert "Exchange" not in above_arrow(edges)
