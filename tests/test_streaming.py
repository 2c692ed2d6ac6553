from fieldspan.streaming.decades import event_decades


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02d} 10:00:00", i % 40, float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").selectExpr("event_id", "timestamp(t) ts", "user_id", "value")
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    q = event_decades(spark.readStream.schema(events.schema).parquet(path)).writeStream.format("memory").queryName("decades").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    show = lambda df: sorted((r.pixel, r.window.start, r.days, r.total) for r in df.collect())
    assert show(spark.table("decades")) == show(event_decades(events)) != []
