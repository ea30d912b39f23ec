import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from tallyloom.functions.text import squeezed, terms, tokenize_alnum, tokenize_strip_punct, trimmed

TEXTS = [
    None, "", "   ", "...!?", "Don't stop", "don’t", "soft­hy​phen", "Café CAFÉ", "東京タワー tower", "・ー", "가나 한국어", "x1y2",
    "\U0001d49c\U0001f600b", "İstanbul İX", "ΣΣ", "a b c　d", "word " * 20_000, "é" * 5_000,
]


def expected_terms(text):
    text = unicodedata.normalize("NFC", text).lower()
    for c in "'’­​":
        text = text.replace(c, "")
    return regex.findall(r"[぀-ヿ一-鿿]|[\p{L}--[぀-ヿ一-鿿]]+", text, flags=regex.V1)


def test_terms_as_defined(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for r in df.select("i", terms(F.col("text")).alias("ts")).collect():
        text = TEXTS[r["i"]]
        assert r["ts"] == (None if text is None else expected_terms(text)), repr(text)[:80]


def test_trimmed_and_squeezed(spark):
    row = spark.range(1).select(trimmed(F.lit(" \t a b 　\n")).alias("t"), squeezed(F.lit(" A   b\nCafé ")).alias("s")).first()
    assert (row["t"], row["s"]) == ("a b", "a b café")


@pytest.mark.parametrize(("tokenize", "want"), [(tokenize_alnum, ["dont", "caf", "x2", "end"]), (tokenize_strip_punct, ["dont", "café", "x", "end"])])
def test_tokenizers(spark, tokenize, want):
    text = "  Don't ,  THE café   x2 ( end."
    assert spark.range(1).select(tokenize(F.lit(text), ["the", "don", "t"]).alias("w")).first()["w"] == want
