"""Text columns: terms, the two legacy tokenizers, and key clean-up. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space in a key or a text (Unicode White_Space and the four separators U+001C-U+001F).
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Characters deleted from a text before it is split, and the ranges whose characters stand alone.
DELETED = r"\x{27}\x{2019}\x{AD}\x{200B}"
SINGLE = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}"
TERM = rf"[{SINGLE}]|[\p{{L}}&&[^{SINGLE}]]+"


def composed(text: Column) -> Column:
    """NFC form. Spark has no such function, but its own class path holds ICU; texts without a
    character from U+0300 on are in that form already and skip the call. Spark counts the call as
    non-deterministic, so it may stand in projections but not inside an aggregate function."""
    icu = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), icu).otherwise(text)


def terms(text: Column) -> Column:
    """The terms of a text in their order, as ``array<string>``; null for null, empty for a text without any.

    Composed form, lower case, apostrophes (U+0027, U+2019), soft hyphens and zero-width spaces deleted; each kana
    or ideograph is a term, and so is each maximal run of other letters."""
    clean = F.regexp_replace(F.lower(composed(text)), f"[{DELETED}]", "")
    return F.regexp_extract_all(clean, F.lit(TERM), F.lit(0))


def trimmed(key: Column) -> Column:
    """``key`` without white space (of any kind) at its ends."""
    return F.regexp_replace(key, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def squeezed(name: Column) -> Column:
    """A name for comparison: composed, lower case, trimmed, every run of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(composed(name)), rf"[{SPACE}]+", " "))


def tokenize_alnum(text: Column, stopwords: list[str] = ()) -> Column:
    """Lower case, everything but ASCII letters, digits and white space deleted, split at white space, then stop words and
    empty words dropped - in this order, so "don't" becomes "dont" and survives the stop word "don". Lone punctuation
    marks are words of nothing and go with the empty ones."""
    clean = F.regexp_replace(F.lower(text), rf"[^a-zA-Z0-9{SPACE}]+", "")
    drop = ["", *stopwords]
    return F.filter(F.split(clean, rf"[{SPACE}]+"), lambda w: ~w.isin(drop))


def tokenize_strip_punct(text: Column, stopwords: list[str] = ()) -> Column:
    """Lower case, digits and ASCII punctuation deleted, split at white space, stop words and empty words dropped;
    accented letters stay."""
    clean = F.regexp_replace(F.lower(text), r"[0-9!-/:-@\[-`{-~]", "")
    drop = ["", *stopwords]
    return F.filter(F.split(clean, rf"[{SPACE}]+"), lambda w: ~w.isin(drop))
