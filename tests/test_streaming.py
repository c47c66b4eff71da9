from pyspark.sql import functions as F

from locuspark.streaming import events as S


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_windowed_counts_match_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(S.windowed_counts(stream(spark, tmp_path, e), "ts", ["event_type"], "1 day", "10 days"), "w", "complete")
    want = e.groupBy(F.window("ts", "1 day"), "event_type").count().select("window.start", "event_type", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_go(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts")
    got = drain(S.without_repeats(stream(spark, tmp_path, e.unionByName(e)), "ts", ["event_id"], "1000 days"), "d", "append")
    assert got.count() == e.select("event_id").distinct().count()


def test_sessions(spark, tmp_path):
    e = spark.createDataFrame([(1, 0), (1, 50), (1, 300), (2, 10)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = drain(S.sessions(stream(spark, tmp_path, e), "ts", "k", "60 seconds", "1 hour"), "s", "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_runs(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 5, "b")], "k int, p long, v string").coalesce(1)
    got = drain(S.runs(stream(spark, tmp_path, e), "k", "p", "v"), "r", "append")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, 2, 2), (1, "b", 3, 3, 1)]
