"""Results per key where a handful of keys hold most rows.

Every aggregate here is algebraic, so Spark's partial aggregation is the bounded per-task hash table: it combines the
rows of a key before the shuffle, spills sorted runs of states when it outgrows its memory, and only one compact state
per key and task moves. A key with a third of all rows costs a reducer one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def per_key(df: DataFrame, fields: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """``(field, key_value, <aggregates>)`` for every value of each of ``fields``, in one pass over ``df``.

    ``aggregates`` maps names to algebraic aggregate expressions (count, sum, min, max, avg, variance, sketches) over
    columns other than ``fields``. A null key is no key; the empty string is one. Keys come out as strings. An empty
    table gives no rows."""
    sets = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    long = df.withColumn("_key", sets).where(F.col("_key.key_value").isNotNull())
    grouped = long.groupBy(F.col("_key.field").alias("field"), F.col("_key.key_value").alias("key_value"))
    return grouped.agg(*[a.alias(name) for name, a in aggregates.items()])


def heavy_keys(df: DataFrame, fields: list[str], share: int = 100) -> DataFrame:
    """``(field, key_value, rows)`` of the keys that more than 1 in ``share`` of all rows of ``df`` hold, rows with null keys
    included in the total; fewer than ``share`` of each field. The rows are counted in the same pass: they are the rows of a
    key that all have. An empty table gives no rows."""
    every = "".join(fields) + "_every_row"
    counts = written(per_key(df.select(*fields, F.lit("").alias(every)), [*fields, every], {"rows": F.count(F.lit(1))}))
    whole = counts.where(F.col("field") == every).first()
    return counts.where((F.col("field") != every) & (F.col("rows") * share > F.lit(whole["rows"] if whole else 0)))
