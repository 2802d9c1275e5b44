"""Streams give what the batch functions give."""

import json

from pyspark.sql import functions as F

from glyphflow.operators import store
from glyphflow.streaming import store as streams

FEEDBACK = "request_id long, user_id long, rating string, correction string, seq long"
ROWS = [(i % 7, i % 3 if i % 5 else None, "up" if i % 2 else "down", f"c{i}" if i % 4 == 0 else None, i) for i in range(60)]


def written(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_upserts(spark, tmp_path):
    got = drained(streams.feedback_upserts(written(spark, tmp_path, ROWS, FEEDBACK)), "upserts", "complete", tmp_path)
    want = store.upsert_feedback(spark.createDataFrame(ROWS, FEEDBACK).where("user_id IS NOT NULL"))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_replay(spark, tmp_path):
    got = drained(streams.replay_stream(written(spark, tmp_path, ROWS, FEEDBACK), ["request_id", "user_id"]), "replayed", "append", tmp_path)
    assert got.count() == spark.createDataFrame(ROWS, FEEDBACK).select("request_id", "user_id").distinct().count()


def test_stats(spark, tmp_path):
    rows = [("todo" if i % 3 else "fix", i % 4 > 0) for i in range(30)]
    got = drained(streams.stats_stream(written(spark, tmp_path, rows, "target string, ok boolean")), "stats", "complete", tmp_path)
    want = store.by_target(spark.createDataFrame(rows, "target string, ok boolean")).where("target != 'all'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_corrections(spark, tmp_path):
    kinds = ["down", "text", "text", "down", "cancel", "text", "down", "down", "text"]
    schema = "chat_id long, user_id long, seq long, kind string, request_id long, text string"
    rows = [(u, u, i, k, 100 + i, f"t{i}") for u in (1, 2) for i, k in enumerate(kinds)]
    stream = written(spark, tmp_path, sorted(rows, key=lambda r: r[2]), schema, parts=1)
    got = drained(streams.corrections_stream(stream), "corrections", "append", tmp_path)
    want = store.corrections(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


def test_event_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(json.dumps({"event": "request", "id": 1}) + "\n\n" + '{"event": "feed')
    got = drained(streams.event_stream(spark, str(tmp_path / "log")), "events_in", "append", tmp_path)
    assert sorted((r.event is None, r.id) for r in got.collect()) == [(False, 1), (True, None)]


def test_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "a", 1) for i in range(8)]
    df = spark.createDataFrame(rows, "ts string, target string, user_id int").withColumn("ts", F.to_timestamp("ts"))
    stream = written(spark, tmp_path, df.collect(), df.schema, parts=1)
    assert sum(r.n for r in drained(streams.windowed(stream), "windows", "complete", tmp_path).collect()) == 8
    assert drained(streams.sessions(stream), "sessions", "complete", tmp_path).count() == 1
