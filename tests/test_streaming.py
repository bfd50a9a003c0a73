from pyspark.sql import functions as F

from folioflow.operators import checkpoint
from folioflow.streaming import front

SCHEMA = "ord long, id string, md5 string, raw string, original string, ignored boolean, attributes string, page string, translation string, engine_name string, target_lang string"


def test_upsert_stream_is_idempotent(spark, tmp_path):
    source, store = tmp_path / "in", checkpoint.Checkpoint(spark, str(tmp_path / "store"))
    row = lambda i, o: (i, f"id{i}", "m", "r", o, False, "body", "p", None, None, None)
    spark.createDataFrame([row(0, "a"), row(1, "b")], SCHEMA).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(source))
    front.upsert_into(store, stream(), "k", str(tmp_path / "s1")).awaitTermination()
    spark.createDataFrame([row(1, "B"), row(2, "c")], SCHEMA).write.mode("append").parquet(str(source))
    front.upsert_into(store, stream(), "k", str(tmp_path / "s1")).awaitTermination()
    got = store.read("k").orderBy("ord").select("id", "original").collect()
    assert [tuple(r) for r in got] == [("id0", "a"), ("id1", "B"), ("id2", "c")]
    front.upsert_into(store, stream(), "k", str(tmp_path / "s2")).awaitTermination()
    assert store.read("k").count() == 3


def test_folding_stream(spark, tmp_path):
    delta = lambda t: 'data: {"choices":[{"delta":{"content":"' + t + '"}}]}'
    rows = [("r", 1, delta("b"), "2024-01-01 00:00:01"), ("r", 0, delta("a"), "2024-01-01 00:00:00"), ("r", 2, "data: [DONE]", "2024-01-01 00:00:02"), ("q", 0, delta("x"), "2024-01-01 00:00:03"), ("late", 0, delta("z"), "2024-01-02 00:00:00")]
    source = str(tmp_path / "lines")
    spark.createDataFrame(rows, "resp string, seq long, line string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(source)
    got = {}
    lines = spark.readStream.schema("resp string, seq long, line string, at timestamp").parquet(source)
    front.fold_batches(lines, "openai", lambda b: got.update({r.resp: (r.text, r.error) for r in b.collect()}), str(tmp_path / "state")).awaitTermination()
    assert got == {"r": ("ab", None), "q": (None, "incomplete")}
