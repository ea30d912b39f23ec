"""Readers with explicit schemas: nothing is inferred, so a scan reads what it needs and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, date string, text string"
BUSINESS = (
    "business_id string, name string, address string, city string, state string, postal_code string, latitude double, longitude double, "
    "stars double, review_count int, is_open int, attributes map<string,string>, categories string, hours map<string,string>"
)
PAIRS = "user_id string, business_id string"
RECORDS = {
    "business_id_lookup": "business_id string, business_index bigint",
    "user_id_lookup": "user_id string, user_index bigint",
    "business_profile": "business_index bigint, business_profile array<bigint>",
    "user_profile": "user_index bigint, user_profile array<bigint>",
}


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review records, JSON lines. A line that is no JSON object becomes a row of nulls."""
    return spark.read.schema(REVIEW).json(path)


def read_business(spark: SparkSession, path: str) -> DataFrame:
    """Business records, JSON lines."""
    return spark.read.schema(BUSINESS).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Basket file: CSV with a header, two string columns, either line end."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(PAIRS).csv(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: one word per line, trimmed, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Prediction requests, JSON lines: ``(user_id, business_id)``."""
    return spark.read.schema(PAIRS).json(path)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind from a model file of tagged JSON lines (field ``type``)."""
    return spark.read.schema(f"type string, {RECORDS[kind]}").json(path).where(F.col("type") == kind).drop("type")


def read_average_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``(id, mean)`` from JSON lines that map ids to means; the entry ``UNK`` is left out."""
    entries = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m")).select(F.explode("m").alias("id", "mean"))
    return entries.where("id <> 'UNK'")


def interactions(spark: SparkSession, root: str) -> DataFrame:
    """``(user, item, stars)`` from the order tables: who bought which part, with a rating derived from the quantity."""
    lines = spark.read.parquet(f"{root}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{root}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    stars = F.max(1.0 + (F.col("l_quantity").cast("int") - 1) % 5)
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(stars.alias("stars"))
