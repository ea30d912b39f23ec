"""The queries of this folder: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import terms
from tallyloom.llm import bpe, cooccurrence, distinctive, packing, repetition, similar_sets, term_frequency, topn
from tallyloom.operators.live import latest
from tallyloom.session import table, written

#: Where the public vocabularies are; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 1024


def live_reviews(spark: SparkSession, root: str, **columns: F.Column) -> DataFrame:
    return latest(table(spark, root, "review"), "review_id", "loaded_at", columns)


def p1_terms(spark: SparkSession, root: str) -> DataFrame:
    live = live_reviews(spark, root, text=F.col("text"))
    counted = written(term_frequency.term_frequencies(live, terms(live["text"])))
    return term_frequency.marked(counted)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_terms(spark, root).where("mark is not null").select("term", "mark")


def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    return cooccurrence.pair_counts(table(spark, root, "small2"), "user_id", "business_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(table(spark, root, "small2"), "user_id", "business_id", min_count=8, min_lift=3)
    return pairs.select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"))


def _distinctive(spark: SparkSession, root: str, min_records: int = 1) -> DataFrame:
    live = live_reviews(spark, root, business_id=F.col("business_id"), text=F.col("text"))
    return distinctive.distinctive_terms(live, "business_id", "text", terms, min_records)


def p3_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every term of every business, down to those that one review holds."""
    return _distinctive(spark, root).withColumn("llr", F.round("llr", 4))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    weight = F.col("with_term") / F.col("in_group") * F.log2(F.col("groups") / F.col("groups_with_term"))
    return _distinctive(spark, root, min_records=3).where(weight >= 1.37).select("business_id", "term")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    live = live_reviews(spark, root, business_id=F.col("business_id"), n_terms=F.size(terms(F.col("text"))))
    return topn.top_n(live.where("n_terms > 0"), "business_id", "review_id", "n_terms", 3).select("business_id", "review_id")


def _visitors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    live = live_reviews(spark, root, business_id=F.col("business_id"), user_id=F.col("user_id"))
    return similar_sets.similar_sets(live, "business_id", "user_id", 0.5, min_size=8)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = similar_sets.expanded(*_visitors(spark, root), "business_id")
    return pairs.select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p6_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row per business with its class of equal visitors and the number of similar classes."""
    links, members = _visitors(spark, root)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(ends, "class", "left").select("business_id", "class", "size", F.coalesce("links", F.lit(0)).alias("links"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encoded(table(spark, root, "documents"), "doc_id", "text", VOCABULARY)


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, root, "documents"), "doc_id", "text", VOCABULARY)
    return packing.packed(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_checked(spark: SparkSession, root: str) -> DataFrame:
    """One row per document: whether its pieces are the whole of it, cut only at multiples of the capacity, and whether
    every container that holds one of them keeps to the capacity."""
    rows = written(p9_containers(spark, root))
    loads = rows.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    last, size = F.max("piece"), F.sum("n_tokens")
    whole = (F.count("*") == last + 1) & (F.min(F.col("start") == F.col("piece") * CAPACITY)) & (last == F.greatest(F.lit(0), F.ceil(size / CAPACITY) - 1))
    return rows.join(loads, "container").groupBy("doc_id").agg(whole.alias("whole"), (F.max("load") <= CAPACITY).alias("fits"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    rules = [("n_terms", ">=", 20), ("repeated_share", ">=", 0.25)]
    return repetition.passing(table(spark, root, "documents"), "doc_id", "text", rules).select("doc_id")


def p10_measures(spark: SparkSession, root: str) -> DataFrame:
    words = [r["word"] for r in table(spark, root, "stopwords").select(F.lower(F.trim("word")).alias("word")).dropna().distinct().collect()]
    wanted = ["n_terms", "repeated_terms", "distinct_share", "stopword_share", "repeated_line_share"]
    out = repetition.measured(table(spark, root, "documents"), "doc_id", "text", wanted, sorted(w for w in words if w))
    return out.select("doc_id", *[F.round(c, 6).alias(c) if c.endswith("share") else c for c in wanted])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p10_found": p10_found,
    "p10_measures": p10_measures,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p6_classes": p6_classes,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_checked": p9_checked,
    "p9_containers": p9_containers,
}
