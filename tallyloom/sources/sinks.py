"""Sinks. Large results are written by the executors; only :func:`json_document` makes a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text_lines(df: DataFrame, column: str, path: str) -> None:
    """One line per row, in the order of the rows; for reports, which are of bounded size."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_records(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Rows as JSON lines tagged with their kind, beside those of other kinds."""
    df.select(F.lit(kind).alias("type"), "*").write.mode(mode).json(path)


def json_document(**results: DataFrame) -> DataFrame:
    """``(document)``: one row with a JSON object of all results, each an array of its rows' values. A one-column row is a
    bare value. The results are reports: bounded lists such as a top-k, in an order of their own that is kept."""
    document = None
    for name, df in results.items():
        value = F.array(*[F.col(c) for c in df.columns]) if len(set(dict(df.dtypes).values())) == 1 and len(df.columns) > 1 else F.struct(*df.columns) if len(df.columns) > 1 else F.col(df.columns[0])
        rows = df.withColumn("_at", F.monotonically_increasing_id()).select("_at", value.alias("_v"))
        one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(name)).withColumn("_one", F.lit(1))
        document = one if document is None else document.join(one, "_one")
    return document.drop("_one").select(F.to_json(F.struct("*")).alias("document"))
