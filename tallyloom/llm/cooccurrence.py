"""Items that appear together in a basket: counts, lift and pointwise mutual information.

Items are deduplicated per basket, ordered pairs are emitted and counted with map-side combining, and the marginals give
lift and PMI. Exact prunings keep the emission in check (:func:`~tallyloom.operators.pairs.shared_counts`): the largest
baskets emit nothing where ``min_count`` allows, an item in fewer than ``min_count`` baskets, or one so common that
``min_lift`` is out of reach, is left out before. Large baskets are cut into hashed blocks, and each pair of blocks is a
row of its own, so that the pairs of one basket spread over tasks and no task gathers a basket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import trimmed
from tallyloom.operators.pairs import shared_counts
from tallyloom.session import written


def pair_counts(df: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: int = 0) -> DataFrame:
    """``(item_a, item_b, together, baskets_a, baskets_b, baskets, lift, pmi)`` of every pair of items with
    ``together >= min_count`` and ``together * baskets >= min_lift * baskets_a * baskets_b``; ``item_a < item_b`` as
    strings by code point, each pair once.

    White space at the ends of keys is not part of them; rows with a null key are left out; repeated rows count once;
    the empty key is a key. An empty table, or baskets of one item, give no rows. With ``min_count=1`` the result
    itself holds the square of the largest basket."""
    rows = written(df.select(trimmed(df[basket].cast("string")).alias("basket"), trimmed(df[item].cast("string")).alias("item")).dropna().distinct())
    total = rows.select("basket").distinct().count()
    counted, items = shared_counts(rows, "basket", "item", min_count, lambda n: n * min_lift <= total)
    out = counted.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  (products of counts may exceed a bigint)
    seen, chance = wide("together") * F.lit(total), wide("n_a") * wide("n_b")
    lift = seen.cast("double") / chance.cast("double")
    return out.where(seen >= chance * F.lit(min_lift)).select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "together", F.col("n_a").alias("baskets_a"), F.col("n_b").alias("baskets_b"),
        F.lit(total).cast("bigint").alias("baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"),
    )
