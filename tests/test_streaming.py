import datetime as dt

from seqweave.streaming.sessions import stream_gap_sessions


def test_sessions_end_at_the_gap(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t + dt.timedelta(seconds=s)) for s in (0, 5, 9, 19, 20)] + [("v", t), ("w", t + dt.timedelta(hours=2))]
    schema = "user string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    q = stream_gap_sessions(stream, "user", "ts", 10, "1 minute").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("w", t + dt.timedelta(hours=3))], schema).write.parquet(str(tmp_path / "in" / "2"))
        q.processAllAvailable()
        got = sorted((r.key, r.n) for r in spark.table("sessions").collect())
    finally:
        q.stop()
    assert got[:3] == [("u", 2), ("u", 3), ("v", 1)]
