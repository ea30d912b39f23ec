"""TF-IDF item profiles, user profiles, and content-based prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.pairs import attached
from tallyloom.operators.products import BLOCK_ROWS, BLOCKS, EXPANDED, TASK_ROWS, expanded
from tallyloom.operators.similarity import numbered
from tallyloom.session import written

WORD_ROWS = 5_000_000  # profile entries of a block of words


def term_counts(words: Column) -> Column:
    """``array<struct<word, n>>`` of an array of words, null ones left out: runs of the sorted array, counted within the row."""
    def runs(ordered: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ends = lambda starts: F.transform(starts, lambda at, k: F.struct(F.get(ordered, at).alias("word"), (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - at).alias("n")))
        return F.element_at(F.transform(F.array(first), ends), 1)

    return F.element_at(F.transform(F.array(F.array_sort(F.array_compact(words))), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered))), 1)


def tfidf(docs: DataFrame, item: str, doc: str, words: Column, n_docs: int) -> DataFrame:
    """``(item, doc, word, tfidf)``: term frequency over the most frequent word of the document, times
    ``log2(n_docs / documents with the word)``. A document is one row of ``docs``; the score is negative for words in more
    than ``n_docs`` documents. Rows with a null item are left out; a document without words has no rows.

    Words are counted within the row, so the only shuffles are the map-side combined number of documents per word and its
    join with the counts, in which the commonest words stay where they are."""
    rows = docs.select(F.col(item).alias("item"), F.col(doc).alias("doc"), term_counts(words).alias("counts")).where("item is not null and size(counts) > 0")
    rows = rows.select("item", "doc", F.array_max(F.transform("counts", lambda c: c["n"])).alias("most"), F.explode("counts").alias("c"))
    rows = written(rows.select("item", "doc", F.col("c.word").alias("word"), (F.col("c.n") / F.col("most")).alias("tf")))
    held = written(rows.groupBy("word").agg(F.count("*").alias("held")))
    scored = attached(rows, held, ["word"], "held")
    return scored.select("item", "doc", "word", (F.col("tf") * F.log2(F.lit(float(n_docs)) / F.col("held"))).alias("tfidf"))


def item_profiles(scores: DataFrame, top: int = 200, dedup_terms: bool = False) -> DataFrame:
    """``(item, word, place)``: the ``top`` words of an item's documents by score, ties to the smaller word. A word counts
    once per document, so it may take several places, unless ``dedup_terms``."""
    rows = scores.groupBy("item", "word").agg(F.max("tfidf").alias("tfidf"), F.lit(None).cast("string").alias("doc")) if dedup_terms else scores
    # Rounded, so that sums in another order don't move a tie; the first filter keeps only what can be in the list.
    order = Window.partitionBy("item").orderBy(F.desc(F.round("tfidf", 9)), "word", "doc")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("item", "word", "place")


def user_profiles(pairs: DataFrame, profiles: DataFrame, user: str, item: str) -> DataFrame:
    """``(user, word)``: the distinct words of the profiles of the items a user touched, for users with more than one entry
    (counted before repeated words are removed)."""
    touched = pairs.select(F.col(user).alias("user"), F.col(item).alias("item")).dropna().distinct()
    words = touched.join(profiles.select("item", "word"), "item").groupBy("user", "word").agg(F.count("*").alias("n"))
    rich = words.groupBy("user").agg(F.sum("n").alias("n")).where("n > 1").select("user")
    return words.join(rich, "user", "left_semi").select("user", "word")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The users of a block by the words of a block: all words of the items a user touched, each once."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    kind = table["kind"].to_numpy()
    users, items, words = (table.filter(pa.array(kind == k)).combine_chunks() for k in range(3))
    if not users.num_rows or not items.num_rows:
        return

    def lists(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = part["list"].chunk(0)
        at = held.offsets.to_numpy().astype(np.int64)
        return at - at[0], held.values.to_numpy()[at[0] : at[-1]]

    order = np.argsort(items["id"].to_numpy())
    ids = items["id"].to_numpy()[order]
    at, entries = lists(items)
    starts, sizes = at[:-1][order], np.diff(at)[order]
    known = words["id"].to_numpy()
    by = np.argsort(known)
    known, values = known[by], words["value"].to_numpy()[by]
    entries = np.searchsorted(known, entries)
    at, touched = lists(users)
    place = np.minimum(np.searchsorted(ids, touched), len(ids) - 1)
    lengths = np.where(ids[place] == touched, sizes[place], 0)
    work = np.concatenate([[0], np.cumsum(lengths)])[at]
    names, low = users["name"].chunk(0), 0
    while low < len(names):
        high = min(len(names), max(low + 1, int(np.searchsorted(work, work[low] + EXPANDED, "right")) - 1))
        part = slice(at[low], at[high])
        owner = np.repeat(np.repeat(np.arange(high - low), np.diff(at[low : high + 1])), lengths[part])
        keys = np.unique(owner * len(known) + entries[expanded(starts[place[part]], lengths[part])])
        user, word = keys // len(known), keys % len(known)
        begins = np.flatnonzero(np.diff(user, prepend=-1))
        if len(begins):
            ends = np.append(begins[1:], len(user)) - 1
            found = user[begins]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(found + low)), pa.array(ends - begins + 1), pa.array((work[low + 1 : high + 1] - work[low:high])[found]), pa.array(known[word[begins]].astype(np.int64)), pa.array(known[word[ends]].astype(np.int64)), pa.array(np.add.reduceat(values[word], begins))],
                ["user", "words", "entries", "least", "most", "digest"],
            )
        low = high


def profile_digests(pairs: DataFrame, profiles: DataFrame, user: str, item: str, value: Column) -> DataFrame:
    """``(user, words, first, last, digest)`` of the profiles of :func:`user_profiles` without making them: the number of
    words, the ends of their list, and the sum of ``value``, a bigint of the column ``word``.

    A task gets a block of users, with the items they touched, and the entries of all items in a block of words, so what is
    shuffled are the touched items once per block of words, and the entries once per block of users."""
    touched = written(pairs.select(F.col(user).alias("user"), F.col(item).alias("item")).dropna().distinct())
    entries = written(profiles.select("item", "word"))
    word_ids = written(numbered(entries, "word").withColumn("value", value.cast("bigint")))
    item_ids = written(numbered(touched, "item"))
    n_touched, n_entries = touched.count(), entries.count()
    blocks = max(min(BLOCKS, -(-n_touched // TASK_ROWS)), -(-n_touched // BLOCK_ROWS), 1)
    word_blocks = max(1, -(-n_entries // WORD_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_word = F.pmod("idx", F.lit(word_blocks)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    kind = touched.schema["user"].dataType.simpleString()
    lists = touched.join(item_ids, "item").groupBy("user").agg(F.collect_list(F.col("idx").cast("int")).alias("list"))
    sent = lists.select(F.lit(0).alias("kind"), F.col("user").alias("name"), none("int").alias("id"), "list", none("bigint").alias("value"), F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int").alias("u"), every(word_blocks).alias("w"))
    held = entries.join(word_ids.select("word", "idx"), "word").select("item", F.col("idx").cast("int").alias("word"), of_word.alias("w"))
    held = held.join(item_ids, "item").groupBy("idx", "w").agg(F.array_sort(F.collect_list("word")).alias("list"))
    sent = sent.unionByName(held.select(F.lit(1).alias("kind"), none(kind).alias("name"), F.col("idx").cast("int").alias("id"), "list", none("bigint").alias("value"), every(blocks).alias("u"), "w"))
    sent = sent.unionByName(word_ids.select(F.lit(2).alias("kind"), none(kind).alias("name"), F.col("idx").cast("int").alias("id"), none("array<int>").alias("list"), "value", every(blocks).alias("u"), of_word.alias("w")))
    tiles = sent.withColumn("tile", F.col("u") * word_blocks + F.col("w")).drop("u", "w").repartitionById(blocks * word_blocks, F.col("tile")).drop("tile")
    made = tiles.mapInArrow(_digests, f"user {kind}, words bigint, entries bigint, least bigint, most bigint, digest bigint")
    if word_blocks > 1:
        made = made.groupBy("user").agg(*[f(c).alias(c) for c, f in (("words", F.sum), ("entries", F.sum), ("least", F.min), ("most", F.max), ("digest", F.sum))])
    made = made.where("entries > 1")
    for end, name in (("least", "first"), ("most", "last")):
        made = made.join(word_ids.select(F.col("idx").alias(end), F.col("word").alias(name)), end)
    return made.select("user", "words", "first", "last", "digest")


def content_of_touched(pairs: DataFrame, items: DataFrame, user: str, item: str, min_sim: float = 0.01) -> DataFrame:
    """:func:`content_predict` for all pairs that the user profiles are made of: such a profile holds every word of the item,
    so the words shared are the item's distinct ones, and of the user only the number of words is needed."""
    users = profile_digests(pairs, items, user, item, F.lit(0)).select(F.col("user").alias("_u"), F.col("words").alias("n_user"))
    facts = items.groupBy("item").agg(F.count("*").alias("n_item"), F.countDistinct("word").alias("shared"))
    asked = pairs.select(F.col(user).alias("user"), F.col(item).alias("item")).dropna().distinct()
    sim = F.col("shared") / (F.sqrt("n_user") * F.sqrt("n_item"))
    out = asked.join(facts, "item").join(users, F.col("user") == F.col("_u")).select(F.col("user").alias(user), F.col("item").alias(item), sim.alias("sim"))
    return out.where(F.col("sim") > min_sim)


def content_predict(requests: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, min_sim: float = 0.01) -> DataFrame:
    """``(user, item, sim)`` of the requested pairs with a set cosine above ``min_sim``: shared words over the roots of the
    profiles' lengths, an item's length counting repeated words. Pairs without a profile, or without a shared word, have no
    similarity and don't come out."""
    lengths = items.groupBy("item").agg(F.count("*").alias("n_item"))
    user_lengths = users.groupBy("user").agg(F.count("*").alias("n_user"))
    asked = requests.select(F.col(user).alias("user"), F.col(item).alias("item")).dropna().distinct()
    shared = asked.join(items.select("item", "word").distinct(), "item").join(users, ["user", "word"]).groupBy("user", "item").agg(F.count("*").alias("shared"))
    sim = F.col("shared") / (F.sqrt("n_user") * F.sqrt("n_item"))
    out = shared.join(lengths, "item").join(user_lengths, "user").select(F.col("user").alias(user), F.col("item").alias(item), sim.alias("sim"))
    return out.where(F.col("sim") > min_sim)
