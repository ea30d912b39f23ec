"""The current version of every record of a table that is delivered with repeats and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: str, columns: dict[str, Column] | list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``version``, with ``columns`` (names, or a dict of name to
    expression) computed **before** the shuffle, so callers that need only a number of a text never move the text.

    The maximum is combined within each map task first, so a key that is delivered very often is no hot key. Rows that
    tie on ``version`` are told apart by a hash of ``columns`` - the same row wins on every run. Null versions are the
    oldest. Rows with a null key form one record. Columns may be of any type but map.
    """
    if not isinstance(columns, dict):
        columns = {c: df[c] for c in columns}
    names = list(columns)
    # Fixed inner names: a column of the caller's choosing can't clash with them.
    narrow = df.select(
        df[key].alias("_k"), df[version].alias("_v"), F.struct(*[columns[n].alias(f"c{i}") for i, n in enumerate(names)]).alias("_row")
    )
    best = narrow.groupBy("_k").agg(F.max_by("_row", F.struct("_v", F.xxhash64("_row"))).alias("_row"))
    return best.select(F.col("_k").alias(key), *[F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)])
