"""How distinctive a term is for a group of records: Dunning's log-likelihood ratio on a two-by-two table.

The table counts the records of the group with and without the term against those of the rest of the collection. Every
record's distinct terms are counted by (group, term) with map-side combining, so texts stay where they are and a group of
any size costs a task at most one row per term. The counts are written once and read twice: for the totals per term, again
combined map-side, and for the rows to score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def _entropy_part(k: Column, n: Column) -> Column:
    """k * ln(k / n), 0 for k = 0."""
    return F.when(k > 0, k * F.log(k / n)).otherwise(F.lit(0.0))


def llr(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """G-squared of a two-by-two table of counts, never below 0."""
    total = k11 + k12 + k21 + k22
    cells = sum((_entropy_part(k, total) for k in (k11, k12, k21, k22)), F.lit(0.0))
    rows = _entropy_part(k11 + k12, total) + _entropy_part(k21 + k22, total)
    cols = _entropy_part(k11 + k21, total) + _entropy_part(k12 + k22, total)
    return F.greatest(F.lit(0.0), 2 * (cells - rows - cols))


def distinctive_terms(records: DataFrame, group: str, text: str, terms, min_records: int = 1) -> DataFrame:
    """``(group, term, with_term, in_group, groups_with_term, groups, llr)`` for every term of every group that at least
    ``min_records`` of its records hold.

    ``records`` has one row per record; ``terms`` maps the column ``text`` to its array of terms. ``with_term`` of the
    group's ``in_group`` records with any term hold the term, as do ``groups_with_term`` of the ``groups`` that have such
    records. ``llr`` is positive if the group holds the term more often than the rest, negative if less. A null group is
    none; null and empty texts have no terms; with a single group nothing remains to compare with and ``llr`` is 0. An
    empty table gives no rows."""
    rows = records.select(records[group].alias("g"), records[text].alias("t")).where("g is not null")
    held = rows.select("g", F.array_distinct(terms(F.col("t"))).alias("ts")).where("size(ts) > 0")
    # The null at the end of each record's terms counts the record itself.
    counts = held.select("g", F.explode(F.array_append("ts", F.lit(None).cast("string"))).alias("term")).groupBy("g", "term").agg(F.count("*").alias("n"))
    counts = written(counts)
    sizes = counts.where("term is null").select("g", F.col("n").alias("in_group"))
    groups, all_records = sizes.agg(F.count("*"), F.sum("in_group")).first()
    totals = counts.where("term is not null").groupBy("term").agg(F.count("*").alias("groups_with_term"), F.sum("n").alias("all_with_term"))
    scored = counts.where((F.col("n") >= min_records) & F.col("term").isNotNull()).join(sizes, "g").join(totals, "term")
    n, size, with_term, rest = (F.col(c).cast("double") for c in ("n", "in_group", "all_with_term", "rest"))
    rest = F.lit(float(all_records or 0)) - size
    ratio = llr(n, size - n, with_term - n, rest - (with_term - n))
    more = n * rest >= (with_term - n) * size
    return scored.select(
        F.col("g").alias(group), "term", F.col("n").alias("with_term"), "in_group", "groups_with_term", F.lit(groups).cast("bigint").alias("groups"),
        F.when(more, ratio).otherwise(-ratio).alias("llr"),
    )
