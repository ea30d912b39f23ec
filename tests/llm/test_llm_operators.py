import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.text import terms
from tallyloom.llm import bpe, cooccurrence, distinctive, packing, repetition, similar_sets, term_frequency, topn

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
has_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


# --- 1: frequency of every distinct term

LISTS = [["a", "b", "a"], ["a"], [], None, ["c", None, "b"], ["a", "b"], [None]]


def frequencies(lists, ids=None):
    times, records = Counter(), defaultdict(set)
    for i, ts in zip(ids or range(len(lists)), lists, strict=True):
        for t in ts or []:
            if t is not None and i is not None:
                times[t] += 1
                records[t].add(i)
                records[None].add(i)
    return sorted([(t, times[t], len(records[t])) for t in times])


def test_term_frequencies(spark):
    df = spark.createDataFrame([(ts, "x", 1) for ts in LISTS], "terms array<string>, term string, record int").repartition(3)
    counted = term_frequency.term_frequencies(df, "terms")
    assert [r for r in rows_of(counted) if r[0] is not None] == frequencies(LISTS)
    assert [r["records"] for r in counted.where("term is null").collect()] == [4]
    marks = {r["term"]: r["mark"] for r in term_frequency.marked(counted, rare_records=1, common_share=0.6).collect()}
    assert marks == {"a": "common", "b": "common", "c": "rare"}
    empty = term_frequency.term_frequencies(df.limit(0), "terms")
    assert empty.count() == 0 and term_frequency.marked(empty).count() == 0


def test_records_in_parts_are_united(spark):
    ids = [7, 70_000, 7, None, 7, 70_000, 5]
    df = spark.createDataFrame(list(zip(ids, LISTS, strict=True)), "id bigint, terms array<string>").repartition(4)
    counted = term_frequency.term_frequencies(df, "terms", "id")
    assert [r for r in rows_of(counted) if r[0] is not None] == frequencies(LISTS, ids)


def test_dense_containers_and_many_blocks(monkeypatch):
    monkeypatch.setattr(term_frequency, "BLOCK", 30_000)
    n = 150_000
    lists = [["all", "even"] if i % 2 == 0 else ["all", f"t{i % 97}"] for i in range(n)]
    batches = [pa.record_batch([pa.array(range(i, min(i + 9_000, n))), pa.array(lists[i : i + 9_000])], names=["record", "terms"]) for i in range(0, n, 9_000)]
    parts = pa.Table.from_batches(list(term_frequency._build(iter(batches)))).sort_by([("term", "ascending"), ("container", "ascending")])
    merged = [r for b in term_frequency._merge(iter(parts.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    got = defaultdict(lambda: (0, 0))
    for r in merged:  # one row per term and container
        got[r["term"]] = (got[r["term"]][0] + r["occurrences"], got[r["term"]][1] + r["records"])
    assert got["all"] == (n, n) and got[None] == (n, n) and got["even"] == (n // 2, n // 2)
    assert len(got) == 3 + 97 and len(merged) == sum(len(set(parts.filter(parts["term"].is_null() if t is None else pc.equal(parts["term"], t))["container"].to_pylist())) for t in got)
    assert max(len(b) for b in parts["bits"].to_pylist()) <= 8192


@given(st.lists(st.sets(st.integers(0, 65535), min_size=1, max_size=60), min_size=1, max_size=4))
def test_container_round_trip_and_union(sets):
    parts = [(term_frequency.pack(np.array(sorted(s), np.uint16)), len(s)) for s in sets]
    bits, n = term_frequency.union(parts)
    assert set(term_frequency.unpack(bits, n).tolist()) == set().union(*sets) and n == len(set().union(*sets))


def test_dense_container_round_trip():
    offsets = np.arange(0, 65536, 3, dtype=np.uint16)
    bits = term_frequency.pack(offsets)
    assert len(bits) == 8192 and (term_frequency.unpack(bits, len(offsets)) == offsets).all()


# --- 2: items that appear together

def test_pair_counts(spark):
    rng = random.Random(4)
    rows = [(f" u{rng.randrange(9)}", f"i{rng.randrange(7)}　") for _ in range(60)]
    rows += [("big", f"i{k}") for k in range(7)] + [("big2", f"i{k}") for k in range(7)] + [(None, "i1"), ("u1", None), ("", "i1"), ("", "i2"), ("u1", "i1"), ("u1 ", "i1")]
    baskets = defaultdict(set)
    for u, i in rows:
        if u is not None and i is not None:
            baskets[u.strip()].add(i.strip())
    held = Counter(i for b in baskets.values() for i in b)
    together = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "basket string, item string, mask int, n string")
    for least, lift in ((1, 0), (3, 0), (3, 1), (6, 1)):
        want = sorted((a, b, n, held[a], held[b], len(baskets)) for (a, b), n in together.items() if n >= least and n * len(baskets) >= lift * held[a] * held[b])
        got = cooccurrence.pair_counts(df, "basket", "item", least, lift)
        assert rows_of(got, "item_a", "item_b", "together", "baskets_a", "baskets_b", "baskets") == want
    row = cooccurrence.pair_counts(df, "basket", "item").where("item_a = 'i0' and item_b = 'i1'").first()
    assert row["lift"] == pytest.approx(row["together"] * row["baskets"] / row["baskets_a"] / row["baskets_b"]) and row["pmi"] == pytest.approx(math.log2(row["lift"]))
    assert cooccurrence.pair_counts(df.limit(0), "basket", "item", 8, 3).count() == 0


# --- 3: distinctive terms

def test_distinctive_terms(spark):
    rng = random.Random(5)
    data = [(f"r{i}", rng.choice(["hot", "hot", "g1", "g2", None]), rng.choice(["alpha beta beta", "beta gamma", "delta", "", None, "!!", "alpha"])) for i in range(120)]
    df = spark.createDataFrame([(*d, "q") for d in data], "id string, g string, text string, s string")
    held, size = defaultdict(Counter), Counter()
    for _, g, t in data:
        words = set((t or "").replace("!", "").split())
        if g is not None and words:
            size[g] += 1
            held[g].update(words)
    n_all, with_term, groups = sum(size.values()), Counter(), Counter()
    for c in held.values():
        with_term.update(c)
        groups.update(c.keys())

    def g2(a, b, c, d):
        n = a + b + c + d
        return 2 * sum(o * math.log(o * n / (r * k)) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)) if o)

    got = {(r["g"], r["term"]): r for r in distinctive.distinctive_terms(df, "g", "text", terms).collect()}
    assert set(got) == {(g, t) for g, c in held.items() for t in c}
    for (g, t), r in got.items():
        k, n = held[g][t], size[g]
        assert (r["with_term"], r["in_group"], r["groups_with_term"], r["groups"]) == (k, n, groups[t], len(size))
        assert abs(r["llr"]) == pytest.approx(max(0, g2(k, n - k, with_term[t] - k, n_all - n - with_term[t] + k)), abs=1e-9)
        more = k * (n_all - n) >= (with_term[t] - k) * n
        assert r["llr"] >= 0 if more else r["llr"] <= 0
    one = distinctive.distinctive_terms(df.where("g = 'g1'"), "g", "text", terms)
    assert {r["llr"] for r in one.collect()} == {0.0}
    assert distinctive.distinctive_terms(df.limit(0), "g", "text", terms).count() == 0


# --- 4: top N in every group

def test_top_n(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", "ç", None]), rng.choice([f"i{k}" for k in range(50)]), rng.choice([None, 1, 2, 3, 3, 9])) for _ in range(2000)] + [("lone", "x", None), ("nul", None, 5), ("nul", "y", 5)]
    df = spark.createDataFrame([(*d, 1) for d in data], "g string, item string, score bigint, bucket int").repartition(7)
    for n in (1, 3, 40):
        want = []
        for g in sorted({d[0] for d in data if d[0] is not None}):
            own = sorted(((s is None, -(s or 0), i is None, i or "", s, i) for h, i, s in data if h == g))[:n]
            want += [(g, x[5], x[4], k + 1) for k, x in enumerate(own)]
        for bucket_rows in (topn.BUCKET_ROWS, 90):
            got = topn.top_n(df, "g", "item", "score", n, bucket_rows)
            assert rows_of(got, "g", "rank") == sorted((w[0], w[3]) for w in want)
            assert rows_of(got) == sorted(want, key=lambda r: [(x is None, x) for x in r])
    assert topn.top_n(df, "g", "item", "score", 0).count() == 0
    assert topn.top_n(df.limit(0), "g", "item", "score", 3).count() == 0
    nan = spark.createDataFrame([("g", "a", float("nan")), ("g", "b", -1.0)], "g string, item string, score double")
    assert [r["item"] for r in sorted(topn.top_n(nan, "g", "item", "score", 2).collect(), key=lambda r: r["rank"])] == ["b", "a"]


@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9))), max_size=9), st.integers(1, 4))
def test_loser_tree_merge(runs, n):
    runs = [sorted(r) for r in runs]
    want = [x for _, own in itertools.groupby(sorted(x for r in runs for x in r), key=lambda x: x[0]) for x in list(own)[:n]]
    # A run holds no more than n of a group, as the operator's runs do; longer ones must be skipped just the same.
    assert list(topn.merge_top(runs, n)) == want


@given(st.lists(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=4), max_size=5), max_size=6), st.integers(1, 3))
def test_merge_of_runs_in_chunks(runs, n):
    whole = [sorted(x for chunk in run for x in chunk) for run in runs]
    cut = [[own[i : i + 3] for i in range(0, len(own), 3)] + [[]] for own in whole]
    assert list(topn.merge_top([topn.Run(c) for c in cut], n)) == list(topn.merge_top(whole, n))


def test_top_n_of_a_million_groups(spark):
    df = spark.range(2_000_000).select((F.col("id") % 1_000_000).alias("g"), F.col("id").alias("item"), (F.col("id") % 7).alias("score"))
    got = topn.top_n(df, "g", "item", "score", 1)
    want = df.groupBy("g").agg(F.max(F.struct("score", -F.col("item"))).alias("b")).select("g", (-F.col("b.col2")).alias("item"), "b.score")
    sums = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("g", "item", "score"))).first()
    assert sums(got) == sums(want) and sums(got)[0] == 1_000_000


# --- 6: similar sets

def exact_pairs(sets, threshold, least):
    out = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least and len(x & y) >= threshold * len(x | y):
            out.append((a, b))
    return out


@pytest.mark.parametrize(("threshold", "least"), [(0.5, 1), (0.5, 8), (0.8, 1)])
def test_similar_sets(spark, monkeypatch, threshold, least):
    monkeypatch.setattr(similar_sets, "LEAF", 5)  # so that nodes are split
    rng = random.Random(7)
    sets = {f"r{i}": set(rng.sample(range(60), rng.randint(1, 25))) | {"hot"} for i in range(60)}
    for i in range(25):
        base = list(sets[f"r{i}"])
        sets[f"near{i}"] = {x for x in base if rng.random() > 0.15} | {f"n{i}"}
    sets |= {f"copy{i}": set(sets["r1"]) for i in range(4)} | {f"twin{i}": {"p", "q"} for i in range(30)}
    rows = [(r, str(t)) for r, s in sets.items() for t in s] * 2 + [(None, "hot"), ("r1", None)]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "r string, t string, n int, id int")
    text = {r: {str(t) for t in s} for r, s in sets.items()}
    links, members = similar_sets.similar_sets(df, "r", "t", threshold, least)
    want = exact_pairs(text, threshold, least)
    assert rows_of(similar_sets.expanded(links, members, "r")) == want
    assert {r["r"]: r["size"] for r in members.collect()} == {r: len(s) for r, s in text.items() if len(s) >= least}
    if least == 1:
        assert {r["class"] for r in members.where("r like 'copy%'").collect()} == {min(["r1", "copy0"])}
    links, members = similar_sets.similar_sets(df.limit(0), "r", "t", threshold, least)
    assert links.count() == 0 and similar_sets.expanded(links, members, "r").count() == 0


def test_similar_sets_between_tables(spark):
    one = spark.createDataFrame([("a", x) for x in "123"] + [("b", x) for x in "12"], "r string, t string")
    two = spark.createDataFrame([("a", x) for x in "123"] + [("c", x) for x in "1245"], "r string, t string")
    links, members = similar_sets.similar_sets(one, "r", "t", 0.5, other=two)
    assert rows_of(links, "a", "b") == [("a", "a"), ("b", "a"), ("b", "c")] and members.count() == 4


def test_recall_and_work_around_a_hot_token(spark):
    """100,000 records of ten tokens, one of them in all: no two similar, but for 2,000 planted pairs just above the threshold (7 of 13),
    which share the hot token and six others of ten."""
    n, planted = 100_000, 2_000
    own = F.when((F.col("k") < 6) & (F.col("id") < 2 * planted), F.concat(F.lit("p"), (F.col("id") % planted).cast("string"), F.lit("-"), F.col("k").cast("string")))
    rows = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("id", own.alias("t"), "k")
    rows = rows.select(F.col("id").cast("string").alias("r"), F.coalesce("t", F.concat("id", F.lit("_"), "k")).alias("t"))
    rows = rows.unionAll(spark.range(n).select(F.col("id").cast("string").alias("r"), F.lit("hot").alias("t")))
    links, _ = similar_sets.similar_sets(rows, "r", "t", 0.5)
    got = {frozenset((int(r["a"]), int(r["b"]))) for r in links.collect()}
    want = {frozenset((i, i + planted)) for i in range(planted)}
    assert got <= want and len(got) >= 0.999 * planted


def test_sets_that_only_seem_equal_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(similar_sets.F, "bit_xor", lambda c: F.max(F.lit(0).cast("bigint")))
    monkeypatch.setattr(similar_sets.F, "sum", lambda c: F.max(F.lit(0)))
    df = spark.createDataFrame([(r, t) for r, ts in {"a": "xyz", "b": "xyw", "c": "xyz", "d": "pqr"}.items() for t in ts], "r string, t string")
    links, members = similar_sets.similar_sets(df, "r", "t", 0.5)
    assert {r["r"]: r["class"] for r in members.collect()} == {"a": "a", "b": "b", "c": "a", "d": "d"}
    assert rows_of(links, "a", "b") == [("a", "b")]


# --- 8: encoding

@has_vocabulary
def test_encoding_equals_the_libraries(spark):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [None, "", " ", "Hello world's  end \n\n x", "<|endoftext|> <|startoftext|>", "日本語 テキスト", "😀é", "a" * 3000, "ab" * 5000, " " * 400, "\x00�", "".join(rng.choice("abcdefgh ") for _ in range(20_000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "key int, text string, ids string")
    got = {r["key"]: r["ids"] for r in bpe.encoded(df, "key", "text", VOCABULARY).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(VOCABULARY).read_bytes().splitlines())}
    one = tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=ranks, special_tokens={})
    two = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    two.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert got[i] == one.encode_ordinary(t or "") == two.encode(t or "", add_special_tokens=False).ids
    counts = {r["key"]: r["n_tokens"] for r in bpe.token_counts(df, "key", "text", VOCABULARY).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert bpe.encoded(df.limit(0), "key", "text", VOCABULARY).count() == 0
    repeated = bpe.encoded(df.unionAll(df).withColumn("key", F.lit(None).cast("int")), "key", "text", VOCABULARY)
    assert repeated.count() == 2 * len(texts)


@has_vocabulary
@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_encoding_decodes_to_the_text(texts):
    import base64

    vocabulary = Path(VOCABULARY).read_bytes()
    encoder = bpe._encoder(vocabulary)
    back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, vocabulary.splitlines())}
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, n = encoder.encode(texts)
    assert [b"".join(back[i] for i in part).decode() for part in np.split(ids.tolist(), np.cumsum(n))[: len(texts)]] == texts


# --- 9: packing

def fewest(sizes, capacity):
    """Exhaustive search, for a few items."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_bin_completion_is_optimal_on_small_cases(sizes):
    bins = packing.bin_completion(sizes, 20)
    assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
    assert len(bins) == fewest(sizes, 20)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound(sizes):
    assert packing.lower_bound(sorted(sizes, reverse=True), 20) <= fewest(sizes, 20)


def test_many_small_items():
    assert len(packing.bin_completion([2] * 2047, 2047)) == 3
    assert len(packing.bin_completion([1] * 5000, 1000)) == 5


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7), st.integers(1, 20))
def test_every_undominated_filling_comes_out(items, room):
    """Against all subsets: whatever isn't enumerated is dominated by a filling that is."""
    held = Counter(items)
    kinds = sorted(held)
    found = {tuple(sorted((kinds[i], n) for i, n in f)) for _, f in packing._fillings(kinds, [held[k] for k in kinds], room, room, packing._Budget(10**9))}
    waste = {room - sum(k * n for k, n in f) for f in found}
    sums = {sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}
    assert min(waste) == room - max(sums)
    for f in found:
        left = held - Counter(dict(f))
        rest = room - sum(k * n for k, n in f)
        assert rest >= 0 and all(k > rest for k in left) and not any(k < j <= k + rest for k, _ in f for j in left)
    for n in range(len(items) + 1):
        for c in itertools.combinations(sorted(items), n):
            rest, left = room - sum(c), held - Counter(c)
            if rest >= 0 and all(k > rest for k in left) and not any(k < j <= k + rest for k in c for j in left):
                assert tuple(sorted(Counter(c).items())) in found


@pytest.mark.parametrize("capacity", [1024, 2048, 8192])
def test_containers_against_the_lower_bound(capacity):
    rng = random.Random(capacity)
    sizes = [min(capacity, 1 + int(rng.lognormvariate(4.5, 1.2))) for _ in range(packing.GROUP)]
    bins = packing.bin_completion(sizes, capacity)
    assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
    assert len(bins) <= packing.lower_bound(sorted(sizes, reverse=True), capacity) + 1


def test_bin_completion_beats_best_fit():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 2, 2, 2] * 2
    assert len(packing.bin_completion(sizes, 17)) <= len(packing.best_fit(sorted(sizes, reverse=True), 17))


def test_packed(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([0, None, 5, 60, 100, 101, 250, rng.randint(1, 90)])) for i in range(1500)] + [(7, 30)] * 50 + [(None, 40)]
    df = spark.createDataFrame([(*d, 1, "c") for d in data], "id int, size int, piece int, container string")
    rows = packing.packed(df, "id", "size", 100).collect()
    loads = Counter()
    for r in rows:
        loads[r["container"]] += r["size"]
    assert max(loads.values()) <= 100 and sum(loads.values()) == sum(s or 0 for _, s in data)
    assert len(loads) <= len(packing.best_fit(sorted((r["size"] for r in rows if r["size"]), reverse=True), 100))
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["piece"], r["start"], r["size"]))
    for i, s in data:
        if i not in (7, None):
            want = [(k, k * 100, min(100, (s or 0) - k * 100)) for k in range(max(1, math.ceil((s or 0) / 100)))]
            assert sorted(by[i]) == want
    assert len(by[7]) == 50 + max(1, math.ceil((dict(data[:1500])[7] or 0) / 100)) and by[None] == [(0, 0, 40)]
    assert packing.packed(df.limit(0), "id", "size", 100).count() == 0
    assert {tuple(r) for r in packing.packed(df.where("size is null"), "id", "size", 100).select("size").collect()} == {(0,)}


# --- 10: repetition

def brute_repeated(ts, width=5):
    seen, covered = {}, set()
    for i in range(len(ts) - width + 1):
        if tuple(ts[i : i + width]) in seen:
            covered.update(range(i, i + width))
        seen.setdefault(tuple(ts[i : i + width]), i)
    return len(covered)


def test_repeated_positions(spark):
    rng = random.Random(10)
    lists = [[rng.choice("ab") for _ in range(rng.randint(0, 40))] for _ in range(40)] + [["a"] * 3000, list("abcde") * 2, list("abcd") * 2, list("abcdexabcde")]
    df = spark.createDataFrame([(i, ts) for i, ts in enumerate(lists)], "i int, ts array<string>")
    assert {r["i"]: r["n"] for r in df.select("i", repetition.repeated_positions(F.col("ts")).alias("n")).collect()} == {i: brute_repeated(ts) for i, ts in enumerate(lists)}


def test_measures_and_thresholds(spark):
    texts = {1: None, 2: "", 3: "one two\n\none two\n\nthree", 4: "the cat. the cat. the dog!", 5: "$$ ## ab", 6: "spam eggs ham tea milk " * 5_000}
    df = spark.createDataFrame([(i, t, [0]) for i, t in texts.items()] + [(None, "x", None), (2, "", None)], "key int, text string, ts array<int>")
    wanted = list(repetition.measures(F.lit(""), F.array(), []))
    got = {r["key"]: r for r in repetition.measured(df, "key", "text", wanted, ["the"]).collect()}
    assert got[1]["n_terms"] == got[2]["n_chars"] == 0 and all(got[1][m] == 0 for m in wanted)
    assert got[3]["repeated_line_share"] == pytest.approx(1 / 3) and got[3]["repeated_paragraph_share"] == pytest.approx(1 / 3)
    assert got[4]["stopword_share"] == 0.5 and got[4]["repeated_sentence_share"] == pytest.approx(1 / 3) and got[4]["distinct_share"] == 0.5
    assert got[5]["symbol_share"] == 0.5 and got[6]["repeated_terms"] == 24_995
    found = repetition.passing(df, "key", "text", [("n_terms", ">=", 5), ("repeated_share", ">", 0.2), ("n_terms", "<=", 1e9), ("symbol_share", "<", 0.5)])
    assert rows_of(found, "key") == [(6,)]
    assert repetition.passing(df, "key", "text", []).count() == len(texts) + 2
    assert repetition.measured(df.limit(0), "key", "text", wanted).count() == 0
    plan = repetition.passing(df, "key", "text", [("repeated_share", ">=", 0.25)])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
