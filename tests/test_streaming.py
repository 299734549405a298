import datetime as dt

from keyloom.streaming import processors as P


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_expiry_and_waiters(spark, tmp_path):
    schema = "key string, seq bigint, ts timestamp, expire_at bigint"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    ms = lambda s: 1704067200000 + 1000 * s
    src = str(tmp_path / "writes")
    for i, rows in enumerate([[("a", 1, at(0), ms(5)), ("b", 2, at(0), ms(5))], [("b", 3, at(1), -1)], [("c", 4, at(60), -1)], [("c", 5, at(120), -1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    assert [(r.key, r.event) for r in run(P.expirations(stream), spark, "expired")] == [("a", "expired")]

    schema = "key string, kind string, seq bigint, conn bigint, deadline bigint, value string, at bigint"
    src = str(tmp_path / "waits")
    rows = [("q", "wait", 1, 10, -1, None, 1), ("q", "wait", 2, 11, 5, None, 2), ("q", "push", 3, 0, 0, "x", 3), ("q", "push", 4, 0, 0, "y", 9), ("q", "wait", 5, 12, -1, None, 10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    got = sorted((r.conn, r.value) for r in run(P.blocking_pops(stream), spark, "popped"))
    assert got == [(10, "x"), (11, None), (12, "y")]


def test_stateless_streams(spark, tmp_path):
    schema = "seq bigint, db int, key string, cmd string, channel string, ts timestamp, shard int, off bigint"
    src = str(tmp_path / "ops")
    now = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 0, "k", "SET", "news", now, 0, 1), (2, 0, "k", "GET", "newt", now, 0, 1)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    assert len(run(P.notifications(stream), spark, "events")) == 2
    subs = spark.createDataFrame([("news", 1)], "channel string, conn int")
    assert len(run(P.deliver(stream, subs, ((2, "new*"),)), spark, "delivered")) == 3
    assert len(run(P.replicated(stream), spark, "replicated")) == 1
    assert run(P.rates(stream), spark, "rates", "update")


def test_scored_pops_moves_and_gaps(spark, tmp_path):
    schema = "key string, kind string, seq bigint, conn bigint, deadline bigint, value string, at bigint, place double"
    src = str(tmp_path / "scored")
    rows = [("z", "push", 1, 0, 0, "low", 1, 1.0), ("z", "push", 2, 0, 0, "top", 2, 9.0), ("z", "push", 3, 0, 0, "mid", 3, 5.0), ("z", "wait", 4, 7, -1, None, 4, 0.0)]
    later = [("z", "wait", 5, 8, -1, None, 5, 0.0), ("z", "wait", 6, 9, -1, None, 6, 0.0), ("z", "push", 7, 0, 0, "new", 7, 2.0)]
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    assert [(r.conn, r.value) for r in run(P.blocking_pops(stream, last=True, count=2), spark, "scored")] == [(7, "top"), (7, "mid"), (8, "low"), (9, "new")]
    stream = spark.readStream.schema(schema).parquet(f"{src}/*").drop("place")
    assert sorted((r.key, r.value) for r in run(P.blocking_moves(stream, "t"), spark, "moved")) == [("t", "low"), ("t", "mid"), ("t", "top")]

    schema, src = "shard int, off bigint, kind string, value string", str(tmp_path / "log")
    parts = [[(0, 1, "op", "a"), (0, 2, "op", "b"), (0, 2, "op", "b"), (1, 5, "op", "x")], [(0, 4, "op", "d"), (0, 5, "op", "e"), (1, 6, "op", "y")], [(0, 8, "snapshot", None), (0, 9, "op", "i"), (0, 3, "op", "c")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = [(r.shard, r.off, r.action) for r in run(P.replica_apply(stream), spark, "replica")]
    assert [g for g in got if g[0] == 0] == [(0, 1, "apply"), (0, 2, "apply"), (0, 3, "resync"), (0, 9, "apply")]
    assert [g for g in got if g[0] == 1] == [(1, 5, "apply"), (1, 6, "apply")]
