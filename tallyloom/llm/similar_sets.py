"""All similar pairs between set-valued records, by recursive chosen-path splitting.

A node is a set of tokens - the path chosen so far - and the records that hold all of them and chose them. At every level
each record of a node picks each of its tokens outside the path with probability ``BRANCH / (threshold * size - depth)``,
by a hash of path, token and tree that all records share, and goes into one child per picked token. Two records at the
threshold have at least ``threshold * size - depth`` further tokens in common, so they pick ``BRANCH`` of them on average
and part company as a critical branching process dies out; the number of trees follows from the recall to reach.

Three things end the recursion, none of them a limit on its depth:

* a node of at most ``LEAF`` records is searched by brute force;
* in a larger node the pairs whose required overlap the path already covers are similar for certain and come out at once;
  every other similar pair has another common token and meets again in a child, until the tokens are used up;
* a node whose children hold, tree by tree, as many pairs as itself (``STUCK`` of them) is dense: its pairs are close to
  the threshold on average, and it is searched in hashed blocks.

The trees run together: a row is (node, record) with a bit per tree, so that a node that several trees reach is searched
once. Candidates are dropped within the node if their sizes, or a signature that bounds the difference from below, rule
them out, and are then verified exactly against the token table, so every reported pair is right.

Everything is kept in long form - one row per record and token, a large record's rows spread over chunks - so a record
with any number of tokens is no large value. Records with equal sets are searched as one (a class); equality is found by
hashes and then verified token by token. Pairs within classes are added at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.pairs import attached, pairs_within, with_group_sizes
from tallyloom.session import written

BRANCH = 1.0
BUNDLE = 4
LEVELS = 6  # splittings that the number of trees is reckoned for; there may be more
LEAF = 64
STUCK = 0.9
WORDS = 2
CHUNK = 16_384
MOST_TREES = 60


def trees_for(recall: float) -> int:
    """Trees after which a pair at the threshold, in nodes that were split ``LEVELS`` times, is found with probability
    ``recall`` at least. A pair has a Poisson number of common picks at worst, so this is the generating function of a
    branching process. A tree is a bit of a mask, hence the limit; they come in bundles."""
    missed = 0.0
    for _ in range(LEVELS):
        missed = math.exp(-BRANCH * (1 - missed))
    trees = BUNDLE * max(1, math.ceil(math.log(1 - recall) / math.log(missed) / BUNDLE))
    if trees > MOST_TREES:
        raise ValueError(f"a recall of {recall} takes {trees} trees; {MOST_TREES} is the most")
    return trees


def _picks(node: str, share: str, trees: int) -> Column:
    """One bit per tree: whether the token ``h`` is picked in ``node``. One hash serves ``BUNDLE`` trees: its low half says
    whether one of them picks the token, its highest bits which. So trees of a bundle never agree, and a token that each
    would pick with more than one chance in ``BUNDLE`` is picked by all."""
    h = "xxhash64({0}, h, {1})"
    bits = [f"if(({h} & 4294967295L) < {share}, shiftleft(1L, {BUNDLE * k} + int(shiftrightunsigned({h}, 62))), 0L)".format(node, k) for k in range(trees // BUNDLE)]
    return F.expr(f"if({share} > 4294967295L, {(1 << trees) - 1}L, {' | '.join(bits)})")


def _share(threshold: float, depth: int) -> Column:
    """The probability, out of 2 ** 32, that a tree of a bundle picks a token in a node of that depth."""
    left = F.col("n") * F.lit(threshold) - F.lit(depth)
    return F.when(left <= BRANCH * BUNDLE, F.lit(1 << 32)).otherwise((F.lit(BRANCH * BUNDLE * 2.0**32) / left).cast("bigint"))


def _signature(word: int) -> Column:
    """64 bits of a set's signature: the exclusive or of one bit per token. Two sets differ in as many tokens at least
    as their signatures in bits."""
    h = F.xxhash64("t", F.lit(11))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
    return F.bit_xor(F.when(F.pmod(F.shiftright(h, 8), F.lit(WORDS)) == word, bit).otherwise(F.lit(0).cast("bigint")))


SIGNATURE = [f"s{k}" for k in range(WORDS)]
RECORD = ["id", "n", "side", *SIGNATURE]


def _classes(rows: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Of a written table of distinct ``(side, r, t)``: the records, ``(side, r, c, id, n, chunks, s0, s1)`` with the class
    ``c`` named by the smallest record of its side with an equal set, and the tokens of each class's first record,
    ``(id, n, side, s0, s1, t, h, chunks, chunk)``. Both are written.

    Sets that agree in size and in 192 bits of hashes are compared with the class's first record token by token; one that
    only seems equal becomes a class of its own. The comparison is spread over salts where a class has many members."""
    h1, h2 = F.xxhash64("t"), F.xxhash64("t", F.lit(7))
    folded = rows.groupBy("side", "r").agg(
        F.count("*").alias("n"), F.bit_xor(h1).alias("x"), F.sum(h2.cast("decimal(20,0)")).alias("s"), *[_signature(k).alias(f"s{k}") for k in range(WORDS)]
    )
    folded = written(folded.where(F.col("n") >= min_size))
    key = ["side", "n", "x", "s"]
    # Only sets with an equal have a class to look up; all others are their own.
    groups = written(folded.groupBy(*key).agg(F.min("r").alias("c"), F.count("*").alias("m")).where("m > 1"))
    alike = attached(folded.select("r", *key), groups, key, "m").select("side", "r", "c", "m") if not groups.isEmpty() else None
    named = folded.drop("x", "s").withColumns({"c": F.col("r"), "m": F.lit(1).cast("bigint")})
    if alike is not None:
        named = folded.drop("x", "s").join(alike, ["side", "r"], "left").withColumns({"c": F.coalesce("c", "r"), "m": F.coalesce("m", F.lit(1))})
    # Numbers stand for the records from here on; written, they are the same for every reader.
    named = written(named.withColumns({"id": F.monotonically_increasing_id(), "chunks": F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")}))
    tokens = attached(rows, named, ["side", "r"], "n").withColumn("h", F.xxhash64("t"))
    tokens = written(tokens.select(*RECORD, "r", "c", "m", "t", "h", "chunks", F.pmod(F.col("h"), F.col("chunks")).cast("int").alias("chunk")))
    firsts = tokens.where("r = c")
    if alike is not None:
        salts = F.ceil(F.col("m") / F.lit(CHUNK)).cast("int")
        copies = tokens.where("r <> c").select("side", "c", "t", "id", "n", F.pmod(F.col("id"), salts).cast("int").alias("salt"))
        whole = firsts.where("m > 1").select("side", "c", "t", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        held = copies.join(whole, ["side", "c", "t", "salt"]).groupBy("id").agg(F.count("*").alias("shared"))
        other = written(named.where("r <> c").join(held, "id", "left").where("shared is null or shared <> n").select("id"))
        if not other.isEmpty():
            named = written(named.join(other.withColumn("own", F.lit(True)), "id", "left").withColumn("c", F.when(F.col("own"), F.col("r")).otherwise(F.col("c"))).drop("own"))
            firsts = firsts.unionByName(tokens.where("r <> c").join(other, "id", "left_semi"))
    return named, firsts.drop("r", "c", "m")


def _fitting(x: Column, y: Column, threshold: float, between: bool) -> Column:
    """Whether sizes and signatures leave it open that two records reach the threshold."""
    both = x["n"] + y["n"]
    differ = sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in SIGNATURE), F.lit(0))
    fit = (x["n"] >= y["n"] * F.lit(threshold) - 1e-9) & (y["n"] >= x["n"] * F.lit(threshold) - 1e-9)
    # shared >= threshold * union leaves at most (1 - threshold) / (1 + threshold) of both sizes to differ in
    fit = fit & (differ <= both * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
    return fit & (x["side"] != y["side"]) if between else fit


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x["id"].alias("a"), y["id"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b"))


def _in_leaves(leaves: DataFrame, threshold: float, between: bool) -> DataFrame:
    """Candidates of nodes that are small: a join, in which a row meets ``LEAF`` others at most."""
    rows = leaves.select("node", F.struct(*RECORD).alias("x"))
    other = rows.select(F.col("node").alias("node_"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    met = rows.join(other, (F.col("node") == F.col("node_")) & (x["id"] < y["id"]) & _fitting(x, y, threshold, between))
    return met.select(_pair(x, y).alias("p")).select("p.*")


def _in_blocks(rows: DataFrame, threshold: float, between: bool) -> DataFrame:
    """Candidates of nodes of any size, all with all in hashed blocks."""
    return pairs_within(rows, ["node"], "id", RECORD[1:], _pair, lambda x, y: _fitting(x, y, threshold, between))


def _covered_size(depth: int, threshold: float) -> int:
    """Two sets of so many tokens together that share ``depth`` of them reach the threshold."""
    return math.floor(depth * (1 + threshold) / threshold + 1e-9)


def _covered(large: DataFrame, depth: int, threshold: float, between: bool) -> DataFrame:
    """The pairs of large nodes whose required overlap the path covers: sizes of at most ``most`` together. Any two records
    of half of that are such a pair; a larger one is joined with the sizes it may be paired with. So what is looked at is
    what comes out."""
    most = _covered_size(depth, threshold)
    halves = large.where(F.col("n") <= most // 2)
    pairs = _in_blocks(halves, threshold, between)
    over = large.where((F.col("n") > most // 2) & (F.col("n") <= most - depth))
    fits = F.explode(F.sequence(F.lit(depth).cast("bigint"), F.lit(most) - F.col("n"))).alias("size")
    left = over.select("node", fits, F.struct(*RECORD).alias("x"))
    right = halves.select("node", F.col("n").alias("size"), F.struct(*RECORD).alias("y"))
    x, y = F.col("x"), F.col("y")
    met = left.join(right, ["node", "size"]).where(_fitting(x, y, threshold, between))
    ordered = F.when(x["id"] < y["id"], _pair(x, y)).otherwise(_pair(y, x))
    return pairs.unionAll(met.select(ordered.alias("p")).select("p.*"))


def _candidates(tokens: DataFrame, threshold: float, trees: int, between: bool) -> DataFrame:
    """Distinct ``(a, b, n_a, n_b)`` that meet in a node, a before b. ``tokens`` is a written table of the columns of
    ``RECORD``, ``chunk``, ``chunks`` and ``h``, the hash of a token."""
    first = tokens.withColumns({"node": F.lit(0).cast("bigint"), "share": _share(threshold, 0)})
    first = first.select(F.col("h").alias("node"), F.array("h").alias("path"), _picks("node", "share", trees).alias("trees"), "chunks", *RECORD)
    nodes, found, depth = written(first.where("trees <> 0")), [], 1
    while True:
        sized = with_group_sizes(nodes, ["node"])
        # Written level by level: one plan of all levels would grow with their number.
        found.append(written(_in_leaves(sized.where(F.col("_n") <= LEAF), threshold, between).distinct()))
        large = written(sized.where(F.col("_n") > LEAF))
        smallest, largest = large.agg(F.min("n"), F.max("n")).first()
        if smallest is None:
            break
        if smallest <= _covered_size(depth, threshold) // 2:
            found.append(written(_covered(large, depth, threshold, between)))
        if largest == depth:
            break
        # A record's tokens meet its nodes in chunks, so that a record of very many is spread over tasks.
        spread = large.where(F.col("n") > depth).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = spread.join(tokens.select("id", "chunk", "h"), ["id", "chunk"]).where(~F.array_contains("path", F.col("h"))).withColumn("share", _share(threshold, depth))
        picked = met.withColumn("trees", F.col("trees").bitwiseAND(_picks("node", "share", trees))).where("trees <> 0")
        children = written(picked.select("node", F.col("node").bitwiseXOR(F.col("h")).alias("child"), F.array_append("path", F.col("h")).alias("path"), "trees", "chunks", *RECORD))
        # Weighed tree by tree: the pairs in a node's children against those in the node.
        own = large.groupBy("node").agg(F.count("*").alias("m"), F.sum(F.bit_count("trees")).alias("w"))
        parts = children.groupBy("node", "child").agg(F.count("*").alias("k"), F.sum(F.bit_count("trees")).alias("v"))
        parts = parts.groupBy("node").agg(F.sum(F.col("k").cast("double") * F.col("v")).alias("v"))
        dense = own.join(parts, "node").where(F.col("v") >= F.lit(STUCK) * F.col("m").cast("double") * F.col("w")).select("node")
        going = children
        if not dense.isEmpty():
            dense = written(dense)
            found.append(written(_in_blocks(_of_nodes(large, dense, True), threshold, between)))
            going = _of_nodes(children, dense, False)
        # Two orders of the same tokens are one node; a record that came both ways is in it once.
        same = [F.first(c).alias(c) for c in ("path", "chunks", *RECORD[1:])]
        nodes = written(going.groupBy(F.col("child").alias("node"), "id").agg(F.bit_or("trees").alias("trees"), *same))
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _of_nodes(rows: DataFrame, nodes: DataFrame, among: bool) -> DataFrame:
    """The rows whose node is in a written table of nodes, or isn't. That table's size decides how they are joined; a node
    of many rows is no hot key of the join, as the rows are told apart by a second key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    listed = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return salted.join(listed, ["node", "_salt"], "left_semi" if among else "left_anti").drop("_salt")


def _verified(candidates: DataFrame, tokens: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """The candidates that reach the threshold, with their Jaccard similarity. The smaller set is looked up in the larger."""
    swap = F.col("n_a") > F.col("n_b")
    small, large = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    asked = candidates.select("a", "b", "n_a", "n_b", small.alias("id"), large.alias("other")).join(chunks, "id")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    left = asked.join(tokens.select("id", "chunk", "t"), ["id", "chunk"]).drop("id", "chunk")
    shared = left.join(tokens.select(F.col("id").alias("other"), "t"), ["other", "t"]).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    # The slack is for thresholds such as 0.7 that a double only comes close to.
    return shared.where(F.col("shared") >= union * F.lit(threshold) - 1e-9).select("a", "b", "shared", (F.col("shared") / union).alias("jaccard"))


def similar_sets(df: DataFrame, record: str, token: str, threshold: float = 0.5, min_size: int = 1, other: DataFrame | None = None, recall: float = 1 - 1e-5) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: links ``(a, b, shared, jaccard)`` between classes of equal sets, and the class of each record,
    ``members`` ``(record, class, size)``; a before b as strings.

    ``df`` has one row per record and token. Rows with a null record or token are left out, repeated rows count once;
    records with fewer than ``min_size`` tokens take no part; the empty string is a token. With ``other`` (a table with the
    same two columns) only links from ``df`` (a) to ``other`` (b) are sought, ``members`` has a column ``side`` (0 and 1),
    and classes are formed within a table. An empty table gives two empty results. A pair at the threshold is missed with
    probability ``1 - recall`` at most where its nodes were split up to ``LEVELS`` times, others less; none is reported
    wrongly."""

    def long(table: DataFrame, side: int) -> DataFrame:
        return table.select(F.lit(side).alias("side"), table[record].cast("string").alias("r"), table[token].cast("string").alias("t")).dropna()

    rows = long(df, 0) if other is None else long(df, 0).unionByName(long(other, 1))
    rows = written(rows.distinct())
    members, tokens = _classes(rows, min_size)
    sets = members.where("r = c")
    candidates = _candidates(tokens, threshold, trees_for(recall), other is not None)
    links = _verified(candidates, tokens, sets.select("id", "chunks"), threshold)
    name = lambda end: sets.select(F.col("id").alias(end), F.col("r").alias(f"r_{end}"), F.col("side").alias(f"side_{end}"))
    links = links.join(name("a"), "a").join(name("b"), "b")
    first = F.col("side_a") < F.col("side_b") if other is not None else F.col("r_a") < F.col("r_b")
    a, b = F.when(first, F.col("r_a")).otherwise(F.col("r_b")), F.when(first, F.col("r_b")).otherwise(F.col("r_a"))
    shown = [F.col("r").alias(record), F.col("c").alias("class"), F.col("n").alias("size")]
    return links.select(a.alias("a"), b.alias("b"), "shared", "jaccard"), members.select(*shown, *(["side"] if other is not None else []))


def expanded(links: DataFrame, members: DataFrame, record: str) -> DataFrame:
    """Every similar pair of records of one table, ``(a, b)`` with a before b: the links between classes and the pairs
    within one."""
    of = members.select(F.col("class"), F.col(record).alias("_r"))
    across = links.select("a", "b").join(of.withColumnsRenamed({"class": "a", "_r": "x"}), "a").join(of.withColumnsRenamed({"class": "b", "_r": "y"}), "b")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = pairs_within(of, ["class"], "_r", [], lambda x, y: F.struct(x["_r"].alias("a"), y["_r"].alias("b")))
    return across.unionByName(within)
