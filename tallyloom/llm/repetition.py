"""Repetition inside a single document: a table of thresholds compiled into one Spark projection.

Every measure is an expression over arrays of the row itself - no user function, no explode, no shuffle: the plan is a
scan and a projection. Repeated phrases are found by sorting the hashes of a document's shingles with their places, so a
text of n terms costs n log n however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import SPACE, terms

SHINGLE = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if ``body`` uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_positions(ts: Column, width: int = SHINGLE) -> Column:
    """How many positions of an array of terms lie in ``width`` consecutive terms that equal ``width`` consecutive terms
    beginning earlier. Shingles are compared by a 64-bit hash."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ts) - width + 1), lambda i: F.struct(F.xxhash64(F.slice(ts, i, width)).alias("h"), i.alias("p")))

    def again(found: Column) -> Column:
        later = F.filter(found, lambda x, i: (i > 0) & (F.get(found, i - 1)["h"] == x["h"]))
        return F.sort_array(F.transform(later, lambda x: x["p"]))

    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda p, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), p - F.get(starts, i - 1))))
        return F.aggregate(widths, F.lit(0), lambda s, x: s + x)

    return F.when(F.size(ts) >= width, _let(F.sort_array(hashes), lambda found: _let(again(found), covered))).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _pieces(text: Column, separator: str) -> Column:
    cut = F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", ""))
    return F.filter(cut, lambda x: F.length(x) > 0)


def _repeated_share(pieces: Column) -> Column:
    return _let(pieces, lambda p: _share(F.size(p) - F.size(F.array_distinct(p)), F.size(p)))


def measures(text: Column, ts: Column, stopwords: list[str]) -> dict[str, Column]:
    """The measures that a threshold may name, of a text (not null) and its array of terms."""
    symbols = F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{M}}\p{{N}}{SPACE}]+", ""))
    words = F.size(F.filter(ts, lambda t: t.isin(stopwords))) if stopwords else F.lit(0)
    return {
        "n_chars": F.length(text),
        "n_terms": F.size(ts),
        "repeated_terms": repeated_positions(ts),
        "repeated_share": _share(repeated_positions(ts), F.size(ts)),
        "distinct_share": _share(F.size(F.array_distinct(ts)), F.size(ts)),
        "stopword_share": _share(words, F.size(ts)),
        "symbol_share": _share(symbols, F.length(text)),
        "repeated_line_share": _repeated_share(_pieces(text, r"\r\n|[\r\n\x{85}\x{2028}\x{2029}]")),
        "repeated_paragraph_share": _repeated_share(_pieces(text, r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")),
        "repeated_sentence_share": _repeated_share(_pieces(text, r"[.!?\x{3002}\x{FF01}\x{FF1F}]+|[\r\n]+")),
    }


def measured(df: DataFrame, key: str, text: str, wanted: list[str], stopwords: list[str] = ()) -> DataFrame:
    """``(key, <wanted measures>)``, one row per row of ``df``. A null or empty text has 0 of everything; texts are
    measured whole; null keys and repeated rows stay. An empty table gives no rows."""
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    rows = df.select(df[key].alias("key"), body.alias("text"), terms(body).alias("ts"))
    of = measures(F.col("text"), F.col("ts"), list(stopwords))
    return rows.select(F.col("key").alias(key), *[of[m].alias(m) for m in wanted])


def passing(df: DataFrame, key: str, text: str, thresholds: list[tuple[str, str, float]], stopwords: list[str] = ()) -> DataFrame:
    """``(key, <measures>)`` of the documents that meet every threshold ``(measure, ">=" | "<=" | ">" | "<", value)``; the
    table of thresholds becomes one projection and one filter. An empty table of thresholds is met by all."""
    compare = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}
    out = measured(df, key, text, list(dict.fromkeys(m for m, _, _ in thresholds)), stopwords)
    for measure, sign, value in thresholds:
        out = out.where(compare[sign](F.col(measure), F.lit(value)))
    return out
