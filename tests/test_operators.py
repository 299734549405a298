from pyspark.sql import functions as F

from keyloom.operators import bitmaps, generic, hashes, hll, lists, sets, sort, strings, ttl, zsets
from keyloom.plans import fold, persist, ranges, routing, stats
from keyloom.sources import model


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


LST = "db int, key string, pos bigint, value string"
SET = "db int, key string, member string"
ZSET = "db int, key string, member string, score double"
BITS = "db int, key string, bit bigint"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_getrange_and_setrange(spark):
    df = table(spark, "value string", [("Hello World",)])
    cases = {(0, 4): b"Hello", (-5, -1): b"World", (0, -100): b"H", (5, 3): b"", (-1, -5): b"", (20, 30): b""}
    for (a, b), want in cases.items():
        assert bytes(df.select(strings.getrange("value", a, b)).first()[0]) == want, (a, b)
    assert bytes(df.select(strings.setrange("value", 6, "Spark")).first()[0]) == b"Hello Spark"
    assert bytes(df.select(strings.setrange(F.lit("ab"), 4, "x")).first()[0]) == b"ab\0\0x"
    assert bytes(df.select(strings.setrange(F.lit("ab"), 0, "")).first()[0]) == b"ab"


def test_incr_overflow_is_an_error_value(spark):
    log = table(spark, "db int, key string, seq bigint, by bigint", [(0, "a", 1, 2**63 - 1), (0, "a", 2, 1), (0, "b", 1, 5)])
    got = {r.key: (r.value, r.err is not None) for r in strings.incr_total(log).collect()}
    assert got == {"a": (None, True), "b": (5, False)}


def test_all_or_nothing(spark):
    commands = table(spark, "seq int, db int, key string, value string", [(1, 0, "a", "x"), (1, 0, "b", "x"), (2, 0, "c", "x")])
    there = table(spark, "db int, key string", [(0, "b")])
    assert values(strings.all_or_nothing(commands, there), "seq", "applied") == [(1, False), (1, False), (2, True)]


def test_ordered_fold(spark):
    rows = [(0, "k", i, c, a) for i, (c, a) in enumerate([("SETNX", "5"), ("INCRBY", "3"), ("SETNX", "9"), ("APPEND", "x"), ("INCRBY", "1"), ("DELIFEQ", "8x"), ("SETXX", "z"), ("GETSET", "7"), ("DEL", "")])]
    got = fold.ordered_strings(table(spark, "db int, key string, seq bigint, cmd string, arg string", rows)).orderBy("seq").collect()
    assert [r.reply for r in got] == ["1", "8", "0", "2", None, "1", None, None, "1"]
    assert got[4].err and got[4].value == "8x" and got[-1].value is None


def test_lists(spark):
    lst = table(spark, LST, [(0, "l", i, v) for i, v in enumerate("abcab")])
    seq = lambda df: [r.value for r in df.orderBy("pos").collect()]
    assert seq(lists.lrem(lst, 1, "a")) == list("bcab")
    assert seq(lists.lrem(lst, -1, "a")) == list("abcb")
    assert seq(lists.lrem(lst, 0, "a")) == list("bcb")
    assert seq(lists.linsert(lst, "c", "X", after=True)) == list("abcXab")
    assert seq(lists.lset(lst, -1, "Z")) == list("abcaZ")
    assert [r.i for r in lists.lpos(lst, "a", rank=-1, count=0).orderBy("nth").collect()] == [3, 0]
    assert lists.lindex(lst, 9).count() == 0
    pushes = table(spark, "db int, key string, seq int, arg int, value string", [(0, "l", 1, 0, "x"), (0, "l", 1, 1, "y"), (0, "n", 2, 0, "q")])
    assert seq(lists.push(pushes, True, lst).where("key = 'l'")) == list("yxabcab")
    assert lists.push(pushes, False, lst, only_existing=True).where("key = 'n'").count() == 0
    assert seq(lists.lmove(lst, "l", "l", False, True)) == list("babca")
    popped, left = lists.pop(lst, 2, left=False)
    assert seq(popped) == ["a", "b"] and seq(left) == ["a", "b", "c"]


def test_hash_field_gates(spark):
    h = table(spark, "db int, key string, field string, value string, field_expire_at bigint", [(0, "h", "a", "1", None), (0, "h", "b", "2", 500)])
    got = ttl.expire(h, F.lit(300), 100, column="field_expire_at", gt=True)
    assert values(got, "field", "reply") == [("a", 0), ("b", 0)]
    got = ttl.expire(h, F.lit(300), 100, column="field_expire_at", lt=True)
    assert values(got, "field", "reply") == [("a", 1), ("b", 1)]
    assert values(ttl.expire(h, F.lit(50), 100, column="field_expire_at"), "field", "reply", "deleted") == [("a", 2, True), ("b", 2, True)]
    writes = table(spark, "seq int, arg int, db int, key string, field string, value string", [(1, 0, 0, "h", "a", "9"), (1, 1, 0, "h", "c", "9"), (2, 0, 0, "h", "d", "9")])
    assert values(hashes.hsetex(writes, h, 900, "fnx"), "field", "value") == [("a", "1"), ("b", "2"), ("d", "9")]


def test_deadline_boundary(spark):
    keys = table(spark, "db int, key string, type string, expire_at bigint", [(0, "a", "string", 100), (0, "b", "string", 99), (0, "c", "list", None)])
    assert values(model.live(keys, 100), "key") == [("a",), ("c",)]
    assert values(keys.withColumn("e", model.wrong_type(keys, "string").isNotNull()), "key", "e") == [("a", False), ("b", False), ("c", True)]


def test_set_algebra(spark):
    s = table(spark, SET, [(0, "a", "1"), (0, "a", "2"), (0, "b", "2"), (0, "b", "3")])
    assert values(sets.sinter(s, ["a", "b"]), "member") == [("2",)]
    assert values(sets.sinter(s, ["a", "missing"]), "member") == []
    assert values(sets.sdiff(s, ["a", "b"]), "member") == [("1",)]
    assert values(sets.sdiff(s, ["a", "a"]), "member") == []
    assert values(sets.store(s, "a", sets.sinter(s, ["a", "missing"])), "key", "member") == [("b", "2"), ("b", "3")]


def test_zset_ties_and_nan(spark):
    z = table(spark, ZSET, [(0, "z", "b", 1.0), (0, "z", "a", 1.0), (0, "z", "c", float("inf")), (0, "y", "c", float("-inf")), (0, "y", "a", 2.0)])
    assert [r.member for r in zsets.zrange(z.where("key = 'z'"), 0, -1).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.member for r in zsets.zrange(z.where("key = 'z'"), 0, 1, reverse=True).orderBy("rank").collect()] == ["c", "b"]
    got = {r.member: r.score for r in zsets.combine(z, ["z", "y"]).collect()}
    assert got == {"a": 3.0, "b": 1.0, "c": 0.0}
    assert {r.member: r.score for r in zsets.combine(z, ["z", "z"], "inter").collect()}["a"] == 2.0
    assert values(zsets.combine(z, ["z", "y"], "diff"), "member") == [("b",)]


def test_bitops(spark):
    b = table(spark, BITS, [(0, "a", 0), (0, "a", 1), (0, "a", 9), (0, "b", 1), (0, "b", 3)])
    want = {"AND": [1], "OR": [0, 1, 3, 9], "XOR": [0, 3, 9], "ONE": [0, 3, 9], "DIFF": [0, 9], "DIFF1": [3], "ANDOR": [1]}
    for op, bits in want.items():
        assert [x for (x,) in values(bitmaps.bitop(b, op, ["a", "b"]), "bit")] == bits, op
    assert values(bitmaps.bitop(b, "NOT", ["b"]), "bit") == [(i,) for i in (0, 2, 4, 5, 6, 7)]
    assert values(bitmaps.bitop(b, "XOR", ["a", "a"]), "bit") == []
    assert values(bitmaps.bitpos(b, 0), "key", "pos") == [("a", 2), ("b", 0)]
    assert values(bitmaps.bitcount(b, -1, -1), "key", "n") == [("a", 1), ("b", 2)]
    assert values(bitmaps.bitfield_get(b, 4, 0), "key", "value") == [("a", -4), ("b", 5)]
    df = table(spark, "v bigint", [(127,), (-128,)])
    assert [r[0] for r in df.select(bitmaps.bitfield_incr("v", 1, 8, True, "WRAP")).collect()] == [-128, -127]
    assert [r[0] for r in df.select(bitmaps.bitfield_incr("v", 1, 8, True, "FAIL")).collect()] == [None, -127]


def test_hll_estimate_is_near(spark):
    e = spark.range(20000).select(F.lit(0).alias("db"), F.lit("k").alias("key"), F.col("id").cast("string").alias("element"))
    n = hll.pfcount(hll.pfadd(e.unionByName(e))).first().n
    assert abs(n - 20000) < 20000 * 0.03
    assert hll.ertl({}) == 0.0


def test_sort(spark):
    members = table(spark, "ord int, member string", [(0, "1"), (1, "2"), (2, "3")])
    strs = table(spark, "key string, value string", [("w_1", "3"), ("w_2", "1"), ("d_1", "one"), ("d_2", "two")])
    got = sort.sort(members, strs, by="w_*", get=("#", "d_*")).collect()
    assert [(r.member, r.get_1) for r in got] == [("3", None), ("2", "two"), ("1", "one")]
    assert [r.member for r in sort.sort(members, strs, by="nosort", count=2).collect()] == ["1", "2"]
    assert sort.sort(table(spark, "ord int, member string", [(0, "x")])).first().err


def test_eviction_and_stats(spark):
    e = table(spark, "db int, key string, bytes bigint, freq int, idle_ms bigint, expire_at bigint", [(0, "a", 10, 1, 5, None), (0, "b", 10, 2, 9, 7), (0, "c", 10, 1, 1, 3)])
    assert values(stats.evict(e, 15), "key") == [("a",), ("c",)]
    assert values(stats.evict(e, 25, "volatile-ttl"), "key") == [("c",)]
    assert stats.evict(e, 30).count() == 0 and stats.evict(e, 0, "noeviction").count() == 0
    ops = table(spark, "seq int, db int, key string, cmd string", [(1, 0, "k", "SET"), (2, 0, "k", "GET")])
    assert values(stats.keyspace_events(ops), "channel", "payload") == [("__keyevent@0__:set", "k"), ("__keyspace@0__:k", "set")]


def test_snapshot_and_deltas(spark, tmp_path):
    base = table(spark, "db int, key string, value string", [(0, "a", "1"), (0, "b", "1")])
    deltas = table(spark, "delta_no int, rec_no bigint, op string, db int, key string, value string", [(0, 1, "put", 0, "a", "2"), (1, 0, "tombstone", 0, "b", None), (1, 1, "put", 0, "c", "3")])
    folded = persist.fold_deltas(base, deltas)
    assert values(folded, "key", "value") == [("a", "2"), ("c", "3")]
    persist.save({"str": folded}, str(tmp_path / "snap"), 123)
    assert values(persist.load(spark, str(tmp_path / "snap"))["str"], "key", "value") == [("a", "2"), ("c", "3")]
    assert persist.snapshot_mode(0, 0, 0) == "base" and persist.snapshot_mode(100, 10, 1) == "delta"


def test_replication(spark):
    log = table(spark, "shard int, off bigint, op string, db int, key string, value string", [(0, 1, "put", 0, "a", "1"), (0, 1, "put", 0, "a", "1"), (0, 2, "del", 0, "a", None), (0, 5, "put", 0, "b", "2")])
    assert values(persist.gaps(log), "off", "prev") == [(5, 2)]
    assert values(persist.apply_log(log), "key", "value") == [("b", "2")]
    lags = table(spark, "shard int, node int, lag bigint, link_up boolean", [(0, 1, 5, True), (0, 2, 1, False), (0, 3, 5, True)])
    assert values(persist.promotable(lags, 10), "shard", "node") == [(0, 1)]


def test_keyspace_moves(spark):
    s = table(spark, SET, [(0, "a", "1"), (0, "b", "2"), (1, "a", "3")])
    assert values(generic.rename(s.where("db = 0"), "a", "b"), "key", "member") == [("b", "1")]
    assert values(generic.rename(s.where("db = 0"), "a", "b", nx=True), "key", "member") == [("a", "1"), ("b", "2")]
    assert values(generic.move(s, "b", 0, 1), "db", "key") == [(0, "a"), (1, "a"), (1, "b")]
    assert values(generic.move(s, "a", 0, 1), "db", "key") == [(0, "a"), (0, "b"), (1, "a")]
    assert generic.random_repeats(s.where("db = 0 and key = 'a'"), "member", 5).count() == 5
    bad = generic.dump(s, "member").withColumn("checksum", F.col("checksum") + 1)
    assert generic.restore(bad, "member string").count() == 0


def test_workload(spark):
    w = persist.zipf_workload(spark, 4000, 1000)
    top = w.groupBy("key").count().orderBy(F.col("count").desc()).first()
    assert top.key == "key:0" and w.where("cmd = 'GET'").count() > 3400


def test_ranks_without_whole_keys(spark):
    z = spark.range(500).selectExpr("0 as db", "if(id % 3 = 0, 'a', 'hot') as key", "cast(id as string) as member", "cast(id % 7 as double) as score")
    for reverse in (False, True):
        want = {(r.key, r.member): r["rank"] for r in zsets.ranked(z, reverse).collect()}
        assert {(r.key, r.member): r["rank"] for r in zsets.ranked(z, reverse, hot=True).collect()} == want
        asked = spark.createDataFrame([(0, "hot", "7"), (0, "a", "3"), (0, "a", "nope"), (0, "none", "1")], SET)
        got = {(r.key, r.member): r["rank"] for r in zsets.zrank(z, asked, reverse).collect()}
        assert got == {k: want[k] for k in (("hot", "7"), ("a", "3"))}


def test_total_order(spark):
    from keyloom.plans.ranges import total_order

    got = total_order(spark.range(1000).withColumn("v", F.lit(2)), ["id"], "v").orderBy("id").collect()
    assert [(r.ix, r.upto) for r in got] == [(i, 2 * i + 2) for i in range(1000)]


def test_rename_to_itself_and_move(spark):
    df = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], "db int, key string, value string")
    assert sorted(generic.rename(df, "a", "a").collect()) == sorted(df.collect())
    assert generic.rename(df, "a", "a", nx=True).count() == 2


def test_ordered_fold_survives_odd_numbers(spark):
    ops = [(0, "k", 1, "SET", "--5"), (0, "k", 2, "INCRBY", "1"), (0, "k", 3, "SET", "٣"), (0, "k", 4, "INCRBY", "1"), (0, "k", 5, "SET", "9223372036854775807"), (0, "k", 6, "INCRBY", "1"), (0, "k", 7, "DECRBY", "7")]
    got = {r.seq: r for r in fold.ordered_strings(spark.createDataFrame(ops, "db int, key string, seq bigint, cmd string, arg string")).collect()}
    assert got[2].err and got[4].err and "overflow" in got[6].err and got[7].value == "9223372036854775800"


def test_blocking_deadlines(spark):
    rows = [(0, "k", 1, "wait", 7, 5, None, None), (0, "k", 2, "wait", 8, None, None, None), (0, "k", 99, "push", None, None, 1.0, "a"), (0, "k", 100, "push", None, None, 2.0, "b"), (0, "k", 101, "wait", 7, 0, None, None)]
    events = spark.createDataFrame(rows, "db int, key string, seq bigint, kind string, conn bigint, deadline bigint, place double, value string")
    assert sorted((r.conn, r.seq, r.value) for r in fold.blocking(events).collect()) == [(7, 101, "b"), (8, 2, "a")]
    moved = fold.blocking_move(events, "t", True, False).orderBy("pos").collect()
    assert [(r.key, r.value) for r in moved] == [("t", "a"), ("t", "b")]


def test_hot_keys_need_no_task_of_their_own(spark):
    rows = [(0, "hot" if i % 10 else f"k{i}", i, f"v{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "db int, key string, seq bigint, value string, by bigint").repartition(4)
    lst = df.select("db", "key", F.col("seq").alias("pos"), "value")
    key = lambda r: tuple(r)
    for a, b in (
        (lists.lrange(lst, -5, -2), lists.lrange(lst, -5, -2, hot=True)),
        (lists.lindex(lst, 3), lists.lindex(lst, 3, hot=True)),
        (strings.previous(df), strings.previous(df, hot=True)),
        (strings.incr_running(df), strings.incr_running(df, hot=True)),
    ):
        assert sorted(map(key, a.collect()), key=repr) == sorted(map(key, b.select(*a.columns).collect()), key=repr)
    placed = ranges.rank_in_keys(lst, ["db", "key"], ["pos"]).withColumn("part", F.spark_partition_id())
    plan = strings.incr_running(df, hot=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "__part" in plan  # windows run inside the parts of a range partitioning
    sizes = [r["count"] for r in ranges.total_order(lst, ["db", "key", "pos"]).select(F.floor(F.col("ix") / 1000).alias("g")).groupBy("g").count().collect()]
    assert sum(sizes) == 3000 and placed.where("key = 'hot'").agg(F.max("rank")).first()[0] == 2699


def test_backlog_and_snapshot(spark, tmp_path):
    log = spark.createDataFrame([("a", i, f"k{i}") for i in range(50)], "shard string, off bigint, key string")
    persist.spill(log.where("off < 30"), str(tmp_path / "log"), 10)
    persist.spill(log.where("off >= 30"), str(tmp_path / "log"), 10)
    assert sorted(r.off for r in persist.ops_after(spark, str(tmp_path / "log"), "a", 37, 10).collect()) == list(range(38, 50))
    assert {r.segment for r in persist.prune(log, 15, 10).collect()} == {0, 1, 2}
    manifest = persist.save({"log": log}, str(tmp_path / "snap"), 5)
    assert manifest.first().n_rows == 50 and persist.load(spark, str(tmp_path / "snap"))["log"].count() == 50


def test_malformed_commands_have_no_keys(spark):
    cases = [("MSET", ["a"], []), ("MSET", ["a", "1", "b", "2"], ["a", "b"]), ("ZUNION", ["3", "a", "b"], []), ("ZUNION", ["x", "a"], []), ("ZINTERSTORE", ["d", "1", "s"], ["d", "s"]), ("GET", [], []), ("get", ["a", "b"], ["a"]), ("OBJECT", ["ENCODING", "k"], ["k"]), ("SORT", ["STORE"], ["STORE"]), ("SORT", ["l", "STORE"], ["l"]), ("BITOP", ["NOT", "d"], []), ("COPY", ["a", "b", "REPLACE"], ["a", "b"]), ("PING", ["x"], [])]
    df = spark.createDataFrame([(c, a) for c, a, _ in cases], "cmd string, args array<string>")
    assert [r[0] for r in df.select(routing.command_keys("cmd", "args")).collect()] == [w for _, _, w in cases]
