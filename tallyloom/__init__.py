"""Spark-native basket, text, graph and similarity analytics over DataFrames."""

from tallyloom.session import get_spark, table, written

__all__ = ["get_spark", "table", "written"]
