from cladewise.streaming import sessions as S


def test_a_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 20:02d}:{i * 7 % 60:02d}:00", i % 3, "a" if i % 2 else "b", 1.0) for i in range(80)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = S.sliding_counts(stream, "2 hours", "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, S.sliding_counts(events, "2 hours", "1 hour").collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    assert sum(r.n for r in S.sessions(events, "30 minutes").collect()) == 80
