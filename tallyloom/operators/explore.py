"""Counts, top lists, means per label, and controlled partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import trimmed


def row_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n"))


def top_by_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, n)`` of the ``k`` most frequent non-null keys, ties to the smaller key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_words(docs: DataFrame, words: Column, k: int) -> DataFrame:
    """``(word, n)`` of the ``k`` most frequent words, ``words`` being an array column."""
    return top_by_count(docs.select(F.explode(words).alias("word")), "word", k)


def mean_by_label(facts: DataFrame, dim: DataFrame, key: str, labels: str, value: str, delimiter: str, k: int) -> DataFrame:
    """``(label, mean)`` of the ``k`` labels with the highest mean of ``value``, ties to the smaller label.

    Every row of ``facts`` counts once for each label that ``labels`` of its ``dim`` row packs between ``delimiter``s; a
    label listed twice counts twice, an empty one is a label, a null list has none."""
    pairs = dim.where(F.col(labels).isNotNull()).select(key, F.explode(F.transform(F.split(labels, f"\\Q{delimiter}\\E"), lambda x: trimmed(x))).alias("label"))
    joined = facts.select(key, value).join(pairs, key)
    return joined.groupBy("label").agg(F.round(F.avg(value), 6).alias("mean")).orderBy(F.desc("mean"), "label").limit(k)


def having_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """``(key, n)`` of the keys with more than ``n`` rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def last_character_part(key: str, parts: int) -> Column:
    """Part number of a key by its last character; the empty key is in part 0."""
    return F.pmod(F.ascii(F.substring(key, -1, 1)), F.lit(parts)).cast("int")


def partitioned_counts(df: DataFrame, key: str, n: int, parts: int) -> DataFrame:
    """:func:`having_count`, laid out in ``parts`` partitions by the last character. The counts are made before, so the
    large shuffle is the aggregate's own and only its result moves again."""
    return having_count(df, key, n).repartitionById(parts, last_character_part(key, parts))


def partition_report(df: DataFrame, key: str, n: int, parts: int) -> DataFrame:
    """``(partition_id, n_items)`` of :func:`partitioned_counts`, empty partitions included."""
    laid = partitioned_counts(df, key, n, parts).select(F.spark_partition_id().alias("partition_id"))
    sizes = laid.groupBy("partition_id").agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(sizes, "partition_id", "left").select("partition_id", F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"))


def pairs_where(facts: DataFrame, dim: DataFrame, key: str, condition: Column, columns: list[str]) -> DataFrame:
    """The rows of ``facts`` whose ``dim`` row meets ``condition`` (which reaches the scan), reduced to ``columns``."""
    return facts.join(dim.where(condition).select(key), key, "left_semi").select(*columns)


def baskets(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """``(basket, items)``: the distinct non-null items of each basket in order, for baskets of more than ``more_than``."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    return rows.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > more_than)
