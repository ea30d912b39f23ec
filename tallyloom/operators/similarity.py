"""MinHash signatures, LSH candidates and exactly verified similar pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import modular
from tallyloom.operators import products
from tallyloom.session import written


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``(key, idx)``: the distinct non-null keys, numbered from 0 in their order, the same on every run.

    Keys are range-partitioned and counted per range, so only one row per range is numbered in a single task."""
    keys = written(df.select(F.col(key).alias("k")).dropna().distinct().repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id()))
    sizes = keys.groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("low"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("k"))
    return keys.join(base, "part").select(F.col("k").alias(key), (F.col("base") + within - 1).alias("idx"))


def minhash(df: DataFrame, set_col: str, element: str, family: tuple[int, int, int], n_hashes: int = 30) -> DataFrame:
    """``(set_col, signature array<bigint>)``: element-wise minimum of the hashes of each set's elements.

    Elements are hashed once each, by their number in order; the minima are algebraic aggregates, combined map-side."""
    rows = df.select(set_col, element).dropna().distinct()
    index = written(numbered(rows, element))
    hashed = index.select(element, modular(F.col("idx"), F.lit(index.count()), n_hashes, family).alias("h"))
    joined = rows.join(hashed, element).select(set_col, *[F.col("h")[i].alias(f"h{i}") for i in range(n_hashes)])
    mins = joined.groupBy(set_col).agg(*[F.min(f"h{i}").alias(f"h{i}") for i in range(n_hashes)])
    return mins.select(set_col, F.array(*[f"h{i}" for i in range(n_hashes)]).alias("signature"))


def bands(signature: Column, n_hashes: int, n_bands: int) -> Column:
    """The signature cut into bands, as ``array<struct<band, rows>>``; the rows themselves are the bucket's key."""
    width = -(-n_hashes // n_bands)
    return F.transform(F.sequence(F.lit(0), F.lit(-(-n_hashes // width) - 1)), lambda b: F.struct(b.alias("band"), F.slice(F.lit(signature) if isinstance(signature, str) else signature, b * width + 1, width).alias("rows")))


def lsh_candidates(signatures: DataFrame, set_col: str, n_hashes: int = 30, n_bands: int = 30) -> DataFrame:
    """``(a, b)``, a before b: the sets that share the rows of a band at least."""
    width = -(-n_hashes // n_bands)
    rows = signatures.select(F.col(set_col).alias("set"), F.explode(bands(F.col("signature"), n_hashes, n_bands)).alias("bucket"))
    if width == 1:
        number = F.col("bucket.rows")[0] * n_bands + F.col("bucket.band")
    else:
        rows = written(rows)
        numbers = written(rows.select("bucket").distinct().withColumn("number", F.monotonically_increasing_id()))
        rows, number = rows.join(numbers, "bucket"), F.col("number")
    sets = products.sets_of(rows.select("set", number.alias("number")), "number", "set")
    return products.shared_pairs(sets, 1, [])


def jaccard_of(pairs: DataFrame, df: DataFrame, set_col: str, element: str) -> DataFrame:
    """``(a, b, shared, jaccard)`` of the given pairs of sets that share an element."""
    rows = written(df.select(F.col(set_col).alias("s"), F.col(element).alias("e")).dropna().distinct())
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    shared = pairs.join(rows.withColumnRenamed("s", "a"), "a").join(rows.withColumnRenamed("s", "b"), ["b", "e"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(sizes.withColumnsRenamed({"s": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"s": "b", "n": "n_b"}), "b")
    return sized.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def similar_pairs(df: DataFrame, set_col: str, element: str, family: tuple[int, int, int], n_hashes: int = 30, n_bands: int = 30, threshold: float = 0.05) -> DataFrame:
    """``(b1, b2, sim)``: LSH candidates whose exact Jaccard similarity is ``threshold`` or more, b1 before b2.

    Bands of one row aren't listed first: pairs with a common element are counted exactly in tiles, and those above the
    threshold compared by their signatures, which are made in the tile."""
    if n_bands != n_hashes or threshold <= 0:  # then a candidate needs more than one row, or no common element
        verified = jaccard_of(lsh_candidates(minhash(df, set_col, element, family, n_hashes), set_col, n_hashes, n_bands), df, set_col, element)
        return verified.where(F.col("jaccard") >= threshold).select(F.col("a").alias("b1"), F.col("b").alias("b2"), F.col("jaccard").alias("sim"))
    sets, count = numbered_sets(df.select(set_col, element).dropna().distinct(), set_col, element)
    fit = lambda left, right, pairs: products.jaccard(left, right, pairs) >= threshold
    found = products.shared_pairs(sets, 1, ["n", "n_a", "n_b"], fit, (count, n_hashes, family))
    return found.select(F.col("a").alias("b1"), F.col("b").alias("b2"), (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("sim"))


def numbered_sets(rows: DataFrame, set_col: str, element: str, value: str | None = None, least: int = 1) -> tuple[DataFrame, int]:
    """:func:`products.sets_of` distinct rows, the elements numbered in order, and the number of elements."""
    rows = written(rows)
    index = written(numbered(rows, element))
    joined = rows.join(index, element).select(set_col, "idx", *([value] if value else []))
    return products.sets_of(joined, "idx", set_col, value, least), index.count()
