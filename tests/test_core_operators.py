import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.hashing import USERS
from tallyloom.operators import cf, explore, graph, hot_keys, itemsets, packed_values, pairs, profiles, similarity
from tallyloom.operators.live import latest
from tallyloom.operators.pairs import pairs_within, shared_counts
from tallyloom.session import written


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


# --- live records

def test_latest_takes_the_newest_and_is_indifferent_to_repeats(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 1, "x"), (None, 3, "y")], "id string, v int, _row string")
    assert rows_of(latest(df, "id", "v", ["_row"])) == [("a", "new"), ("b", "only"), (None, "y")]
    tied = spark.createDataFrame([("a", 1, str(i)) for i in range(20)], "id string, v int, x string")
    assert rows_of(latest(tied, "id", "v", ["x"])) == rows_of(latest(tied.orderBy(F.desc("x")).repartition(3), "id", "v", ["x"]))
    assert latest(df.limit(0), "id", "v", ["_row"]).count() == 0


# --- a few keys holding most records

def test_per_key_under_skew(spark):
    data = [("hot", f"u{i % 50}", i % 5) for i in range(3000)] + [(f"k{i}", None, 1) for i in range(30)] + [(None, "hot", None), ("", "", 2)]
    df = spark.createDataFrame(data, "b string, field string, stars int")
    got = {(r["field"], r["key_value"]): (r["n"], r["total"]) for r in hot_keys.per_key(df, ["b", "field"], {"n": F.count(F.lit(1)), "total": F.sum("stars")}).collect()}
    want = defaultdict(lambda: [0, None])
    for b, u, s in data:
        for f, k in (("b", b), ("field", u)):
            if k is not None:
                want[f, k][0] += 1
                if s is not None:
                    want[f, k][1] = (want[f, k][1] or 0) + s
    assert got == {k: tuple(v) for k, v in want.items()}
    assert rows_of(hot_keys.heavy_keys(df, ["b", "field"], 3), "field", "key_value", "rows") == [("b", "hot", 3000)]
    assert hot_keys.per_key(df.limit(0), ["b"], {"n": F.count(F.lit(1))}).count() == 0
    assert hot_keys.heavy_keys(df.limit(0), ["b"]).count() == 0


# --- packed values

NAMES = ["Wine, Beer & Spirits", "Cafes", "Tapas/Small Bites", "Men's Tailors", 'The "Third Place" Cafes', "Auto Repair: Brakes", "Delis", "Bánh Mì"]
FIELDS = {
    "Cafes": ["Cafes"], "": [], "  ": [], ";;": [], "[]": [], ", ,": [], None: [],
    "Cafes,, Delis,": ["Cafes", "Delis"],
    '"Wine, Beer & Spirits", Delis': ["Wine, Beer & Spirits", "Delis"],
    "Cafes, WINE, BEER & SPIRITS, Delis": ["Cafes", "WINE, BEER & SPIRITS", "Delis"],
    "Wine, Beer & Spirits|Cafes": ["Wine, Beer & Spirits", "Cafes"],
    "Tapas/Small Bites / Delis / Cafes": ["Tapas/Small Bites", "Delis", "Cafes"],
    "'Men''s Tailors','Cafes'": ["Men's Tailors", "Cafes"],
    "'Men's Tailors','Cafes'": ["Men's Tailors", "Cafes"],
    '"The ""Third Place"" Cafes"; Delis\nCafes': ['The "Third Place" Cafes', "Delis", "Cafes"],
    '["The \\"Third Place\\" Cafes", "Delis"]': ['The "Third Place" Cafes', "Delis"],
    "Delis、Cafes、Delis": ["Delis", "Cafes", "Delis"],
    "Auto  Repair: Brakes\tBánh Mì": ["Auto  Repair: Brakes", "Bánh Mì"],
    ",".join(["Delis"] * 400): ["Delis"] * 400,
}


@pytest.mark.parametrize("listed", [True, False])
def test_packed_values(spark, listed):
    data = [(f"b{i}", f, i) for i, f in enumerate(FIELDS)] + [("rep", "Cafes|Delis", 0)] * 2
    if not listed:  # without a list of names the collection itself has to teach them
        data += [(f"x{i}", "|".join(random.Random(i).sample(NAMES, 3)), 0) for i in range(200)]
    df = spark.createDataFrame(data, "id string, field string, pos int")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "Cafes", None, " "]], "name string") if listed else None
    got = defaultdict(list)
    for r in packed_values.unpacked(df, "id", "field", names, "name").collect():
        got[r["id"]].append((r["pos"], r["value"]))
    for i, (_, want) in enumerate(FIELDS.items()):
        assert [v for _, v in sorted(got[f"b{i}"])] == want
        assert [p for p, _ in sorted(got[f"b{i}"])] == list(range(1, len(want) + 1))
    assert sorted(got["rep"]) == [(1, "Cafes"), (1, "Cafes"), (2, "Delis"), (2, "Delis")]
    assert packed_values.unpacked(df.limit(0), "id", "field", names, "name").count() == 0


def test_values_of_many_pieces_and_many_delimiters(spark):
    long = "Arts, Crafts, Sewing, Knitting, Yarn"
    fields = {
        f"Bakery, {long}, Delis": ["Bakery", long, "Delis"],  # a listed value of five pieces
        "Bakery;Wine/Beer|Bar•Delis · Co\tInc, Ltd;Cafes|Bakery": ["Bakery", "Wine/Beer", "Bar•Delis · Co\tInc, Ltd", "Cafes", "Bakery"],  # two delimiters of seven are real
        'Bakery\r\n"Wine/Beer"\r\nCafes': ["Bakery", "Wine/Beer", "Cafes"],
        "".join(f"Cafes{d}" for d in packed_values.DELIMITERS): ["Cafes"] * len(packed_values.DELIMITERS),  # all are
    }
    names = spark.createDataFrame([(n,) for n in ("Bakery", "Delis", "Cafes", "Wine/Beer", "Bar•Delis · Co Inc, Ltd", long)], "name string")
    df = spark.createDataFrame(list(enumerate(fields)), "id int, field string")
    got = defaultdict(list)
    for r in packed_values.unpacked(df, "id", "field", names, "name").collect():
        got[r["id"]].append((r["pos"], r["value"]))
    assert [[v for _, v in sorted(got[i])] for i in range(len(fields))] == list(fields.values())


# --- pairs within groups

@pytest.mark.parametrize("hot_rows", [10, pairs.HOT_ROWS])
def test_pairs_in_blocks_are_complete(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(pairs, "HOT_ROWS", hot_rows)
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(60 if g == 1 else 3)] + [(3, 0)], "g int, item int")
    got = rows_of(pairs_within(df, ["g"], "item", [], lambda x, y: F.struct(x["item"].alias("a"), y["item"].alias("b")), block=7))
    want = sorted([*itertools.combinations(range(60), 2), *itertools.combinations(range(3), 2)])
    assert got == want


@pytest.mark.parametrize("least", [1, 2, 4])
def test_shared_counts_with_large_groups_aside(spark, least):
    rng = random.Random(least)
    rows = {(g, f"m{rng.randrange(12)}") for g in range(20) for _ in range(5)} | {(g, f"m{i}") for g in (100, 101) for i in range(12)}
    df = written(spark.createDataFrame(sorted(rows), "g int, m string"))
    by = defaultdict(set)
    for g, m in rows:
        by[m].add(g)
    want = sorted((a, b, len(by[a] & by[b])) for a, b in itertools.combinations(sorted(by), 2) if len(by[a] & by[b]) >= least)
    assert rows_of(shared_counts(df, "g", "m", least)[0]) == want


# --- exploration

def test_mean_by_label(spark):
    facts = spark.createDataFrame([("a", 5.0), ("a", 3.0), ("b", 1.0), ("z", 4.0)], "id string, stars double")
    dim = spark.createDataFrame([("a", "X, Y"), ("b", "Y,Y,"), ("c", "Z"), ("n", None)], "id string, labels string")
    assert [tuple(r) for r in explore.mean_by_label(facts, dim, "id", "labels", "stars", ",", 9).collect()] == [("X", 4.0), ("Y", 2.5), ("", 1.0)]


def test_counts_tops_and_partitions(spark):
    df = spark.createDataFrame([(k,) for k in ["a1"] * 3 + ["b1"] * 3 + ["c2"] * 2 + ["", None, None, None, None]], "k string")
    assert [tuple(r) for r in explore.top_by_count(df, "k", 2).collect()] == [("a1", 3), ("b1", 3)]
    assert rows_of(explore.having_count(df, "k", 2)) == [("a1", 3), ("b1", 3)]
    report = dict(rows_of(explore.partition_report(df, "k", 0, 5)))
    want = Counter({p: 0 for p in range(5)}) + Counter()
    for k in ("a1", "b1", "c2", ""):
        want[ord(k[-1]) % 5 if k else 0] += 1
    assert report == {p: want.get(p, 0) for p in range(5)}
    assert rows_of(explore.baskets(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, None)], "u int, i string"), "u", "i", 1)) == [(1, ["a", "b"])]
    assert explore.row_count(df, F.col("k").contains("1")).first()["n"] == 6
    assert explore.distinct_count(df, "k").first()["n"] == 4


# --- itemsets

@pytest.mark.parametrize(("seed", "support"), [(1, 2), (2, 3), (3, 5)])
def test_itemsets_against_brute_force(spark, seed, support):
    rng = random.Random(seed)
    sets = [set(rng.sample("abcdefg", rng.randint(0, 6))) for _ in range(14)] + [set("abcdefg")]
    df = spark.createDataFrame([(f"t{i}", x) for i, s in enumerate(sets) for x in s] + [("t0", None), (None, "a"), ("t14", "a")], "basket string, item string")
    want = sorted((k, list(c), n) for k in range(1, 8) for c in itertools.combinations("abcdefg", k) if (n := sum(set(c) <= s for s in sets)) >= support)
    assert rows_of(itemsets.frequent_itemsets(df, "basket", "item", support)) == want
    assert itemsets.frequent_itemsets(df.limit(0), "basket", "item", 1).count() == 0


def test_itemset_report_and_limits(spark):
    df = spark.createDataFrame([(b, i) for b in "xy" for i in "pq"], "b string, i string")
    found = itemsets.frequent_itemsets(df, "b", "i", 2, max_size=2)
    assert rows_of(itemsets.itemset_report(found)) == [(1, "('p'),('q')"), (2, "('p', 'q')")]
    assert itemsets.frequent_itemsets(df, "b", "i", 2, min_basket=2).count() == 0
    with pytest.raises(ValueError, match="support"):
        itemsets.frequent_itemsets(df, "b", "i", 0)


# --- graphs

CLIQUES = [(a, b) for part in ("abcd", "wxyz") for a, b in itertools.combinations(part, 2)] + [("d", "w")]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_components_of_a_long_chain(spark):
    names = [f"n{i:03}" for i in random.Random(0).sample(range(40), 40)]
    edges = frame(spark, [*zip(names, names[1:], strict=False), ("p", "q")])
    nodes = graph.vertices(edges).unionByName(spark.createDataFrame([("alone",)], "id string"))
    got = dict(rows_of(graph.connected_components(nodes, edges)))
    assert set(got[n] for n in names) == {"n000"} and got["p"] == got["q"] == "p" and got["alone"] == "alone"


def test_betweenness_two_ways(spark):
    for edges in (CLIQUES, [("a", "b")], [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], [("c", x) for x in "defgh"], [("a", "b"), ("x", "y"), ("y", "z")]):
        df = graph.canonical(frame(spark, edges))
        whole = {(a, b): v for a, b, v in rows_of(graph.edge_betweenness(df))}
        near = defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        other = defaultdict(float)
        for root in near:
            for e, f in graph._credits(near, root).items():
                other[e] += f / 2
        assert whole == pytest.approx(other)
    assert graph.edge_betweenness(frame(spark, CLIQUES)).orderBy(F.desc("betweenness")).first()["src"] == "d"
    assert graph.edge_betweenness(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("mode", ["reference", "standard"])
def test_communities_of_two_cliques(spark, mode):
    got = dict(rows_of(graph.girvan_newman(frame(spark, [*CLIQUES, ("b", "a"), ("a", "a")]), mode)))
    assert {v: c for v, c in got.items()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    assert graph.girvan_newman(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="vertices"):
        graph.girvan_newman(frame(spark, CLIQUES), max_vertices=3)


def test_label_propagation_and_reports(spark):
    labels = dict(rows_of(graph.label_propagation(frame(spark, CLIQUES))))
    assert len(set(labels[v] for v in "abc")) == 1 and set(labels) == set("abcdwxyz")
    lines = [r["line"] for r in graph.community_lines(spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, community int")).collect()]
    assert lines == ["'c'", "'a', 'b'"]
    shown = graph.betweenness_lines(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double"))
    assert [r["line"] for r in shown.collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]


def test_cooccurrence_edges(spark):
    df = spark.createDataFrame([("u1", x) for x in "abc"] + [("u2", x) for x in "abb"] + [("u3", "c"), ("u3", None)], "u string, i string")
    assert rows_of(graph.cooccurrence_edges(df, "u", "i", 1)) == [("u1", "u2", 2), ("u1", "u3", 1)]
    assert rows_of(graph.cooccurrence_edges(df, "u", "i", 2)) == [("u1", "u2", 2)]
    with pytest.raises(ValueError, match="k"):
        graph.cooccurrence_edges(df, "u", "i", 0)


# --- similarity, profiles, collaborative filtering

def test_numbers_and_minhash(spark):
    rows = [(f"s{i}", f"e{j:02}") for i in range(6) for j in range(20) if (i * 7 + j * 3) % 5 < 2]
    df = spark.createDataFrame(rows, "s string, e string")
    elements = sorted({e for _, e in rows})
    assert rows_of(similarity.numbered(df, "e")) == [(e, i) for i, e in enumerate(elements)]
    a, b, p = USERS
    h = lambda i, x: (((a + i) * x + b * i) % p) % (2 * len(elements))
    want = {s: [min(h(i, elements.index(e)) for t, e in rows if t == s) for i in range(1, 31)] for s, _ in rows}
    signatures = similarity.minhash(df, "s", "e", USERS)
    assert dict(rows_of(signatures)) == want
    meeting = sorted((x, y) for x, y in itertools.combinations(sorted(want), 2) if any(u == v for u, v in zip(want[x], want[y], strict=True)))
    assert rows_of(similarity.lsh_candidates(signatures, "s")) == meeting
    sets = defaultdict(set)
    for s, e in rows:
        sets[s].add(e)
    exact = sorted((x, y) for x, y in meeting if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.3)
    assert rows_of(similarity.similar_pairs(df, "s", "e", USERS, threshold=0.3), "b1", "b2") == exact


def test_pearson_rules(spark):
    data = [("i1", u, s) for u, s in zip("abc", (1, 2, 3), strict=True)] + [("i2", u, s) for u, s in zip("abc", (2, 3, 5), strict=True)] + [("flat", u, 4) for u in "abc"] + [("two", u, 5) for u in "ab"] + [("down", u, s) for u, s in zip("abc", (3, 2, 1), strict=True)]
    df = cf.ratings(spark.createDataFrame([(u, i, float(s)) for i, u, s in data] + [("a", "i1", 0.5), ("a", "i1", None)], "user string, item string, stars double"), "user", "item", "stars")
    got = {(a, b): s for a, b, s in rows_of(cf.pearson_pairs(df, "item", "user"))}
    assert got == pytest.approx({("i1", "i2"): 0.98198050, ("flat", "i1"): 1.0, ("flat", "i2"): 1.0, ("down", "flat"): 1.0})


def test_predictions(spark):
    rated = spark.createDataFrame([("u", "a", 4.0), ("u", "b", 2.0), ("v", "t", 5.0), ("w", "t", 1.0), ("u", "c", 3.0)], "user string, item string, stars double")
    sims = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.25)], "a string, b string, sim double")
    asked = spark.createDataFrame([("u", "t"), ("u", "nothing"), ("stranger", "t"), (None, "t")], "user string, item string")
    wa, wb = 0.5**2.5, 0.25**2.5
    got = {(r["user"], r["item"]): r["stars"] for r in cf.predict_item_based(rated, asked, sims).collect()}
    assert got == pytest.approx({("u", "t"): (4 * wa + 2 * wb) / (wa + wb), ("u", "nothing"): cf.DEFAULT, ("stranger", "t"): cf.DEFAULT, (None, "t"): cf.DEFAULT})
    near = spark.createDataFrame([("u", "v", 1.0), ("u", "w", 0.5)], "a string, b string, sim double")
    got = {(r["user"], r["item"]): r["stars"] for r in cf.predict_user_based(rated, asked, near).collect()}
    mean, w = (5 + 1) / 3, 0.5**2.5
    assert got["u", "t"] == pytest.approx(3 + ((5 - mean) + (1 - mean) * w) / (1 + w)) and got["stranger", "t"] == cf.DEFAULT


def test_profiles(spark):
    docs = spark.createDataFrame([("x", "d1", ["a", "a", "b"]), ("x", "d2", ["a"]), ("y", "d3", ["b", "c"]), ("y", "d4", []), (None, "d5", ["z"])], "item string, doc string, words array<string>")
    scores = profiles.tfidf(docs, "item", "doc", F.col("words"), 4)
    got = {(d, w): s for _, d, w, s in rows_of(scores)}
    assert got == pytest.approx({("d1", "a"): 1.0, ("d1", "b"): 0.5, ("d2", "a"): 1.0, ("d3", "b"): 1.0, ("d3", "c"): 2.0})
    items = profiles.item_profiles(scores, top=2)
    assert rows_of(items) == [("x", "a", 1), ("x", "a", 2), ("y", "b", 2), ("y", "c", 1)]
    assert rows_of(profiles.item_profiles(scores, 2, dedup_terms=True)) == [("x", "a", 1), ("x", "b", 2), ("y", "b", 2), ("y", "c", 1)]
    touched = spark.createDataFrame([("u", "x"), ("u", "y"), ("v", "none")], "user string, item string")
    users = profiles.user_profiles(touched, items, "user", "item")
    assert rows_of(users) == [("u", "a"), ("u", "b"), ("u", "c")]
    got = {(u, i): s for u, i, s in rows_of(profiles.content_predict(touched, users, items, "user", "item"))}
    assert got == pytest.approx({("u", "x"): 1 / (3**0.5 * 2**0.5), ("u", "y"): 2 / (3**0.5 * 2**0.5)})
