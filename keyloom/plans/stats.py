"""Statistics of an operation log, sketches and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import col
from keyloom.plans.ranges import total_order

#: Upper bounds of the latency buckets in microseconds; one more bucket has no bound.
LATENCY_BOUNDS_US = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 500000, 1000000]


def commandstats(ops: DataFrame) -> DataFrame:
    """INFO commandstats and errorstats by command."""
    return ops.groupBy("cmd").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("usec").alias("usec"), F.count_if(F.col("err").isNotNull()).alias("failed")
    )


def latency_bucket(usec) -> Column:
    """Upper bound of the bucket that a latency falls in; null for the last."""
    out = F.lit(None).cast("bigint")
    for bound in reversed(LATENCY_BOUNDS_US):
        out = F.when(col(usec) <= bound, F.lit(bound).cast("bigint")).otherwise(out)
    return out


def latency_histogram(ops: DataFrame) -> DataFrame:
    """Cumulative counts by command and bucket."""
    got = ops.groupBy("cmd", latency_bucket("usec").alias("le")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cmd").orderBy(F.col("le").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn("cumulative", F.sum("n").over(w))


def slowlog(ops: DataFrame, threshold_us: int, length: int = 128) -> DataFrame:
    """SLOWLOG GET: the latest commands over a threshold."""
    return ops.where(F.col("usec") >= threshold_us).orderBy(F.col("seq").desc()).limit(length)


def latency_monitor(samples: DataFrame) -> DataFrame:
    """LATENCY LATEST: of each event its last sample and its largest."""
    return samples.groupBy("event").agg(F.max_by("ms", "ts").alias("last_ms"), F.max("ms").alias("max_ms"), F.max("ts").alias("last_ts"))


def hotkeys(ops: DataFrame, weight: str, k: int) -> DataFrame:
    """HOTKEYS GET, exactly: keys of the largest summed weight."""
    return ops.groupBy("key").agg(F.sum(weight).alias("weight")).orderBy(F.col("weight").desc(), "key").limit(k)


def hotkeys_approx(ops: DataFrame, k: int, tracked: int = 10_000) -> DataFrame:
    """HOTKEYS by a mergeable top-k sketch: bounded state for any number of keys."""
    top = ops.agg(F.expr(f"approx_top_k(key, {k}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"), F.col("t.count").alias("n"))


def hotkeys_counted(ops: DataFrame, k: int, tracked: int = 10_000, buckets: int = 65_536) -> DataFrame:
    """HOTKEYS named by the sketch and counted exactly, for any number of keys.

    The least count among the keys that the sketch names bounds that of the k-th from below, and the rows of a
    key's hash bucket bound its own from above: only keys of buckets that reach the bound are counted.
    Where few keys are hot that is little; where none is, it is every key.
    """
    rows = ops.select("key", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    named = hotkeys_approx(ops, k, tracked).select(F.col("key").alias("named"))
    counted = rows.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("named")), "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = counted.agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).otherwise(0).alias("least"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= least.scalar())
    got = rows.join(F.broadcast(full.select("bucket")), "bucket", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return got.orderBy(F.col("n").desc(), "key").limit(k)


def count_min(ops: DataFrame, eps: float = 0.001, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """Count-min sketch of keys as bytes."""
    return ops.agg(F.count_min_sketch("key", F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def aged_counts(ops: DataFrame, period: int, top: int = 15) -> DataFrame:
    """Frequency of each key under ageing: counts are halved after every ``period`` operations and end at ``top``.

    One aggregation counts by key and period; the halvings are folded in the row.
    """
    n = F.floor(F.col("seq") / period).cast("int")
    counted = ops.groupBy("key", n.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    last = ops.agg(F.max(n).alias("last"))  # one row
    by_key = counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    step = lambda m: lambda a, p: F.least(F.lit(top).cast("bigint"), F.floor(a / 2) + F.coalesce(F.try_element_at(m, p), F.lit(0)))
    folded = F.aggregate(F.sequence(F.lit(0), F.col("last")), F.lit(0).cast("bigint"), step(F.col("m")))
    return by_key.join(F.broadcast(last)).select("key", folded.alias("freq"))


def tinylfu_admit(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """W-TinyLFU admission: a candidate that leaves the window replaces the main area's victim if it is used more.

    ``pairs`` is (candidate, victim), ``freq`` (key, freq); a key without a count counts as 0, a tie keeps
    the victim.
    """
    f = lambda name: freq.select(F.col("key").alias(name), F.col("freq").alias(f"{name}_freq"))
    got = pairs.join(f("candidate"), "candidate", "left").join(f("victim"), "victim", "left")
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("candidate_freq", "victim_freq")})
    return got.withColumn("admitted", F.col("candidate_freq") > F.col("victim_freq"))


def ops_rate(ops: DataFrame, every: str) -> DataFrame:
    """Commands a second in tumbling windows."""
    got = ops.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return got.select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def range_query(series: DataFrame, step: str) -> DataFrame:
    """History query: the last value of each label in each step."""
    got = series.groupBy("label", F.window("ts", step).alias("w")).agg(F.max_by("value", "ts").alias("value"))
    return got.select("label", F.col("w.start").alias("step_start"), "value")


def evict(entries: DataFrame, budget: int, policy: str = "allkeys-lfu", seed: int = 0) -> DataFrame:
    """Victims that bring the keyspace under ``budget`` bytes.

    ``entries`` has (db, key, bytes, freq, idle_ms, expire_at).  The policy sets the order in which keys go:
    least frequent, longest idle, nearest deadline, or random; ``volatile-`` ones take only keys with a
    deadline; ``noeviction`` takes none.  The running total is taken over a range partitioning, so no task
    sees all keys.
    """
    scope, _, how = policy.partition("-")
    if policy == "noeviction":
        return entries.limit(0).withColumn("freed", F.lit(0).cast("bigint"))
    if scope == "volatile":
        pool = entries.where("expire_at is not null")
    else:
        pool = entries
    order = {
        "lfu": F.col("freq").cast("double"), "lru": -F.col("idle_ms").cast("double"), "ttl": F.col("expire_at").cast("double"),
        "random": F.xxhash64(F.lit(seed), "key").cast("double"),
    }[how]
    pool = pool.withColumn("ord", order)
    over = entries.agg(F.sum("bytes")).first()[0] or 0
    need = over - budget
    if need <= 0:
        return pool.limit(0).drop("ord").withColumn("freed", F.lit(0).cast("bigint"))
    got = total_order(pool, ["ord", "key"], "bytes").withColumnRenamed("upto", "freed")
    return got.where(F.col("freed") - F.col("bytes") < need).drop("ord", "ix")


#: Event class letters by command, as keyspace notifications name them.
EVENT_CLASSES = {
    "$": "set setrange incrby incrbyfloat append getset setex psetex getdel",
    "g": "del expire persist rename copy move restore",
    "l": "lpush rpush lpop rpop lset linsert lrem ltrim lmove",
    "s": "sadd srem spop smove sinterstore sunionstore sdiffstore",
    "h": "hset hdel hincrby hincrbyfloat hexpire hpersist",
    "z": "zadd zincr zrem zpopmin zpopmax zunionstore zinterstore zdiffstore",
    "x": "expired",
    "e": "evicted",
}


def keyspace_events(ops: DataFrame, flags: str = "KEA", classes: dict[str, str] | None = None) -> DataFrame:
    """Notifications: channel and payload of each change that the flags let through.

    ``K`` and ``E`` choose the keyspace and keyevent channels, ``A`` stands for all classes.
    """
    of = {e: c for c, names in (classes or EVENT_CLASSES).items() for e in names.split()}
    letters = of.values() if "A" in flags else flags
    lookup = F.create_map(*(F.lit(x) for e, c in of.items() if c in set(letters) for x in (e, c)))
    event = F.lower("cmd")
    rows = ops.withColumn("event", event).withColumn("class", F.try_element_at(lookup, event)).where("class is not null")
    at = F.col("db").cast("string")
    kinds = []
    if "K" in flags:
        kinds.append(F.struct(F.concat(F.lit("__keyspace@"), at, F.lit("__:"), F.col("key").cast("string")).alias("channel"), F.col("event").alias("payload")))
    if "E" in flags:
        kinds.append(F.struct(F.concat(F.lit("__keyevent@"), at, F.lit("__:"), F.col("event")).alias("channel"), F.col("key").cast("string").alias("payload")))
    return rows.withColumn("n", F.explode(F.array(*kinds))).select("seq", "n.channel", "n.payload")


def publish(messages: DataFrame, subs: DataFrame, patterns: list[tuple[int, str]] = ()) -> DataFrame:
    """PUBLISH: a row for each receiver, by exact channel and by pattern.

    ``subs`` is (conn, channel); patterns are an argument list, folded into the row, so no pair of every
    message with every pattern is ever made.
    """
    from keyloom.functions.exprs import glob_match

    exact = messages.join(subs, "channel").select("seq", "channel", "conn", F.lit("exact").alias("kind"))
    if not patterns:
        return exact
    hits = F.array(*(F.when(glob_match("channel", p), F.lit(c)) for c, p in patterns))
    found = messages.withColumn("conn", F.explode(F.array_compact(hits)))
    return exact.unionByName(found.select("seq", "channel", "conn", F.lit("pattern").alias("kind")))


def numsub(subs: DataFrame) -> DataFrame:
    """PUBSUB NUMSUB: subscribers of each channel; CHANNELS are its keys."""
    return subs.groupBy("channel").agg(F.countDistinct("conn").alias("n"))


def numpat(patterns: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: how many distinct patterns are subscribed to."""
    return patterns.agg(F.countDistinct("pattern").alias("n"))


def shard_publish(messages: DataFrame, subs: DataFrame, shards: int) -> DataFrame:
    """SPUBLISH: receivers of messages on sharded channels, and the shard that owns each channel's slot.

    Sharded channels have a name space of their own: ``subs`` are SSUBSCRIBE rows (conn, channel).
    """
    from keyloom.functions.exprs import key_slot, slot_to_shard

    got = messages.join(subs, "channel")
    return got.withColumn("shard", slot_to_shard(key_slot("channel"), shards)).select("seq", "channel", "conn", "shard")
