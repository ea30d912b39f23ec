import json

from pyspark.sql import functions as F

from tallyloom.sources import readers, sinks
from tallyloom.streaming import windows


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text("".join(json.dumps(r) + "\n" for r in ({"review_id": "1", "user_id": "u", "stars": 4, "extra": [1]}, {"review_id": "2", "text": "x"})) + "broken\n")
    got = readers.read_reviews(spark, str(tmp_path / "r.json")).orderBy("review_id").collect()
    assert [r["review_id"] for r in got] == [None, "1", "2"] and got[1]["stars"] == 4.0
    (tmp_path / "b.json").write_text(json.dumps({"business_id": "b", "categories": None, "hours": {"Monday": "9-17"}}) + "\n")
    assert readers.read_business(spark, str(tmp_path / "b.json")).first()["hours"] == {"Monday": "9-17"}
    (tmp_path / "p.csv").write_bytes(b"user_id,business_id\r\n1,2\r\n3,4\r\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "p.csv")).orderBy("user_id").collect()] == [("1", "2"), ("3", "4")]
    (tmp_path / "s.txt").write_text(" the \n\nof\n")
    assert sorted(r["word"] for r in readers.read_stopwords(spark, str(tmp_path / "s.txt")).collect()) == ["of", "the"]
    (tmp_path / "a.json").write_text('{"x": 1.5, "U": 2.0, "UNK": 3.0}\n')
    assert dict(tuple(r) for r in readers.read_average_ratings(spark, str(tmp_path / "a.json")).collect()) == {"x": 1.5, "U": 2.0}
    (tmp_path / "q.json").write_text('{"user_id": "u", "business_id": "b"}\n')
    assert tuple(readers.read_requests(spark, str(tmp_path / "q.json")).first()) == ("u", "b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "n"]
    profile = spark.createDataFrame([(1, [2, 3])], "business_index bigint, business_profile array<bigint>")
    sinks.write_records(profile, "business_profile", str(tmp_path / "m"))
    sinks.write_records(spark.createDataFrame([("u", 1)], "user_id string, user_index bigint"), "user_id_lookup", str(tmp_path / "m"))
    assert tuple(readers.read_records(spark, str(tmp_path / "m"), "business_profile").first()) == (1, [2, 3])
    assert readers.read_records(spark, str(tmp_path / "m"), "user_id_lookup").count() == 1
    sinks.write_text_lines(spark.createDataFrame([("x",), ("y",)], "line string").coalesce(1), "line", str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["x", "y"]
    doc = sinks.json_document(A=spark.range(1).select(F.lit(7).alias("n")), B=df.orderBy("k"), C=spark.createDataFrame([("w",)], "w string")).first()["document"]
    assert json.loads(doc) == {"A": [7], "B": [{"k": "a", "n": 1}, {"k": "b", "n": 2}], "C": ["w"]}


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:1{i % 6}:00", "ab"[i % 2]) for i in range(30)] + [(99, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "id int, t string, kind string").select("id", F.to_timestamp("t").alias("ts"), "kind")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = sorted(tuple(r) for r in windows.windowed_counts(df, "ts", "kind").collect())
    stream = windows.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from w").collect()) == batch and sum(r[2] for r in batch) == 30
    assert windows.top_per_window(windows.windowed_counts(df, "ts", "kind"), "kind", 1).count() == 3
