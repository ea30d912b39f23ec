from collections import defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import products, profiles


@pytest.mark.parametrize("task_rows,word_rows", [(20_000, 5_000_000), (20, 30)])
def test_digests_and_cosines_without_rows_per_word(spark, monkeypatch, task_rows, word_rows):
    monkeypatch.setattr(profiles, "TASK_ROWS", task_rows)
    monkeypatch.setattr(profiles, "WORD_ROWS", word_rows)
    r = Random(5)
    words = {f"i{k}": [f"w{r.randrange(60)}" for _ in range(r.randint(1, 12))] for k in range(20)} | {"one": ["w1"], "none": []}
    pairs = sorted({(f"u{r.randrange(40)}", f"i{r.randrange(20)}") for _ in range(150)} | {("poor", "one"), ("empty", "none"), ("lost", "gone"), ("two", "one"), ("two", "i3")})
    held = spark.createDataFrame([(i, w, k) for i, ws in words.items() for k, w in enumerate(ws)], "item string, word string, place int")
    asked = spark.createDataFrame([*pairs, pairs[0], (None, "i1")], "u string, i string")
    entries, distinct = defaultdict(int), defaultdict(set)
    for u, i in pairs:
        entries[u] += len(words.get(i, []))
        distinct[u] |= set(words.get(i, []))
    want = sorted((u, len(ws), min(ws), max(ws), sum(len(w) * 7 for w in ws)) for u, ws in distinct.items() if entries[u] > 1)
    made = profiles.profile_digests(asked, held, "u", "i", F.length("word") * 7)
    assert sorted(map(tuple, made.collect())) == want
    assert "poor" not in {u for u, *_ in want}
    users = profiles.user_profiles(asked, held, "u", "i")
    key = lambda df: sorted((x["u"], x["i"], round(x["sim"], 9)) for x in df.collect())
    assert key(profiles.content_of_touched(asked, held, "u", "i")) == key(profiles.content_predict(asked, users, held, "u", "i"))
