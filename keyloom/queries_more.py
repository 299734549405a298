"""More registered queries: single forms of commands, blocking commands, routing, and what a server keeps of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.catalog import catalog_rows
from keyloom.functions import exprs as X
from keyloom.operators import bitmaps, generic, hashes, hll, lists, sets, strings, ttl, zsets
from keyloom.plans import fold, persist, ranges, routing, session, stats
from keyloom.queries import NOW, query
from keyloom.sources import rdb
from keyloom.sources.model import KEY, probe, shaped

def _strs(t):
    """Strings of customers: the segment, with a deadline for every third."""
    c = t.raw("customer")
    at = F.when(F.col("c_custkey") % 3 == 0, F.lit(NOW + 60000))
    return shaped(c, key=F.concat(F.lit("customer:"), F.col("c_custkey")), value="c_mktsegment", expire_at=at, n="c_custkey")


_STRS = f"(SELECT 'customer:' || c_custkey AS key, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN {NOW + 60000} END AS expire_at, c_custkey AS n FROM customer)"

# strings


@query("q_getdel", f"SELECT 'read' AS part, key, value FROM {_STRS} WHERE n % 4 = 1 UNION ALL SELECT 'left', key, value FROM {_STRS} WHERE n % 4 <> 1")
def _(t):
    s = _strs(t)
    asked = s.where("n % 4 = 1").select(*KEY, F.col("n").alias("pos"))
    read, left = strings.getdel(s.select(*KEY, "value"), asked)
    return read.select(F.lit("read").alias("part"), "key", "value").unionByName(left.select(F.lit("left").alias("part"), "key", "value"))


@query("q_getex", f"SELECT key, value, CASE WHEN n % 2 = 0 THEN {NOW + 5} ELSE expire_at END AS expire_at FROM {_STRS}")
def _(t):
    s = _strs(t)
    asked = s.where("n % 2 = 0").select(*KEY, F.col("n").alias("pos"))
    return strings.getex(s, asked, NOW, NOW + 5)[1].select("key", "value", "expire_at")


@query("q_getex_past", f"SELECT 'read' AS part, key, value FROM {_STRS} WHERE n % 5 = 0 UNION ALL SELECT 'left', key, value FROM {_STRS} WHERE n % 5 <> 0")
def _(t):
    s = _strs(t)
    read, left = strings.getex(s, s.where("n % 5 = 0").select(*KEY, F.col("n").alias("pos")), NOW, NOW)
    return read.select(F.lit("read").alias("part"), "key", "value").unionByName(left.select(F.lit("left").alias("part"), "key", "value"))


@query("q_getex_persist", f"SELECT key, CASE WHEN n % 2 = 1 THEN expire_at END AS expire_at FROM {_STRS}")
def _(t):
    s = _strs(t)
    return strings.getex(s, s.where("n % 2 = 0").select(*KEY, F.col("n").alias("pos")), NOW, persist=True)[1].select("key", "expire_at")


def _sets(t):
    """Commands that set every second customer, and as many keys that don't exist."""
    s = _strs(t)
    there = s.where("n % 2 = 0").select(*KEY, F.lit("new").alias("value"), F.lit(None).cast("bigint").alias("expire_at"), F.lit("BUILDING").alias("expected"))
    return s, there.unionByName(there.withColumn("key", F.concat(F.lit("no:"), "key")))


_SET_ROWS = f"(SELECT key, TRUE AS there, value AS old, expire_at FROM {_STRS} WHERE n % 2 = 0 UNION ALL SELECT 'no:' || key, FALSE, NULL, NULL FROM {_STRS} WHERE n % 2 = 0)"


for _when, _ok in {"nx": "NOT there", "xx": "there", "ifeq": "coalesce(old = 'BUILDING', FALSE)", "ifne": "old IS NULL OR old <> 'BUILDING'"}.items():

    @query(f"q_set_{_when}", f"SELECT key, applied, old AS old_value, CASE WHEN applied THEN 'new' ELSE old END AS value, CASE WHEN NOT applied THEN expire_at END AS expire_at FROM (SELECT *, {_ok} AS applied FROM {_SET_ROWS})")
    def _(t, when=_when):
        s, writes = _sets(t)
        got = strings.conditional_set(s.select(*KEY, "value", "expire_at"), writes, when)
        return got.select("key", "applied", "old_value", "value", "expire_at")


@query("q_set_keepttl", f"SELECT key, 'new' AS value, expire_at FROM {_SET_ROWS}")
def _(t):
    s, writes = _sets(t)
    return strings.conditional_set(s.select(*KEY, "value", "expire_at"), writes, keepttl=True).select("key", "value", "expire_at")


@query("q_msetex", f"SELECT key, CASE WHEN n % 10 < 2 THEN 'v' ELSE value END AS value, CASE WHEN n % 10 < 2 THEN {NOW + 9} ELSE expire_at END AS expire_at FROM {_STRS}")
def _(t):
    s = _strs(t)
    # each command sets two neighbours; those of the third class also name a key that doesn't exist, so XX holds them back
    pair = s.where("n % 10 in (0, 1, 4)").select(F.floor(F.col("n") / 10).alias("ten"), *KEY, "n")
    rows = pair.select(F.when(F.col("n") % 10 == 4, -F.col("ten") - 1).otherwise(F.col("ten")).alias("seq"), *KEY, "n")
    rows = rows.unionByName(rows.where("n % 10 = 4").withColumn("key", F.concat(F.lit("no:"), "key")))
    rows = rows.select("seq", *KEY, F.lit("v").alias("value"), F.lit(NOW + 9).alias("expire_at"))
    return strings.msetex(s.select(*KEY, "value", "expire_at"), rows, "xx").select("key", "value", "expire_at")


# keyspace


@query("q_rename_self", "SELECT key, member FROM segs")
def _(t):
    return generic.rename(t.segs(), "BUILDING", "BUILDING").select("key", "member")


@query("q_renamenx", "SELECT 'taken' AS form, key, member FROM segs UNION ALL SELECT 'free', CASE key WHEN 'BUILDING' THEN 'HOUSES' ELSE key END, member FROM segs")
def _(t):
    taken, free = generic.rename(t.segs(), "BUILDING", "MACHINERY", nx=True), generic.rename(t.segs(), "BUILDING", "HOUSES", nx=True)
    return taken.select(F.lit("taken").alias("form"), "key", "member").unionByName(free.select(F.lit("free").alias("form"), "key", "member"))


@query("q_move", "SELECT CAST(CASE WHEN key = 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS db, key, member FROM segs UNION ALL SELECT 1, 'MACHINERY', 'x'")
def _(t):
    df = t.segs().unionByName(t.asked([(1, "MACHINERY", "x")], "db int, key string, member string"))
    return generic.move(generic.move(df, "BUILDING", 0, 1), "MACHINERY", 0, 1).select("db", "key", "member")


@query("q_flushdb", "SELECT CAST(0 AS BIGINT) AS db, key, member FROM segs WHERE key <> 'BUILDING'")
def _(t):
    df = t.segs().withColumn("db", F.when(F.col("key") == "BUILDING", 3).otherwise(0))
    return generic.flushdb(df, 3).select("db", "key", "member")


@query("q_flushall", "SELECT key, member FROM segs WHERE FALSE")
def _(t):
    df = t.segs()
    for r in df.select("db").distinct().collect():  # databases are few
        df = generic.flushdb(df, r.db)
    return df.select("key", "member")


@query("q_dump_binary", "SELECT key, 'hash' AS kind, field, value FROM chash")
def _(t):
    back = rdb.restore_binary(rdb.dump_binary(t.chash(), "hash"))
    pairs = back.groupBy("key", "kind", F.floor(F.col("nth") / 2).alias("pair")).agg(
        F.max(F.when(F.col("nth") % 2 == 0, F.col("item").cast("string"))).alias("field"), F.max(F.when(F.col("nth") % 2 == 1, F.col("item").cast("string"))).alias("value")
    )
    return pairs.select("key", "kind", "field", "value")


@query("q_dump_binary_zset", "SELECT key, member, score FROM board")
def _(t):
    back = rdb.restore_binary(rdb.dump_binary(t.board(), "zset"))
    return back.select("key", F.col("item").cast("string").alias("member"), "score")


_CRC = (
    "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, strlen({k}) + 1), lambda i: CAST(ord(substr({k}, CAST(i AS INT), 1)) AS BIGINT))), "
    "lambda c, b: xor(xor(xor((c << 8) & 65535, (xor(xor(c >> 8, b), xor(c >> 8, b) >> 4) << 12) & 65535), (xor(xor(c >> 8, b), xor(c >> 8, b) >> 4) << 5) & 65535), xor(xor(c >> 8, b), xor(c >> 8, b) >> 4))) % 16384"
)


@query("q_slot_histogram", f"SELECT CAST(slot * 8 // 16384 AS BIGINT) AS shard, count(*) AS n, count(DISTINCT slot) AS slots FROM (SELECT {_CRC.format(k='key')} AS slot FROM keys) GROUP BY 1")
def _(t):
    return persist.reshard(t.keys(), 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"))


@query("q_count_keys_in_slot", f"SELECT slot, count(*) AS n FROM (SELECT CAST({_CRC.format(k='key')} AS BIGINT) AS slot FROM keys) GROUP BY slot")
def _(t):
    return generic.count_keys_in_slot(t.keys())


@query("q_get_keys_in_slot", f"SELECT key FROM (SELECT '{{t' || event_id % 40 || '}}:' || event_id AS key, {_CRC.format(k=chr(40) + chr(39) + 't' + chr(39) + ' || event_id % 40' + chr(41))} AS slot FROM events) WHERE slot = (SELECT {_CRC.format(k=chr(39) + 't7' + chr(39))}) ORDER BY key LIMIT 20")
def _(t):
    keys = shaped(t.raw("events"), key=F.format_string("{t%d}:%d", F.col("event_id") % 40, F.col("event_id")))
    slot = t.spark.range(1).select(X.key_slot(F.lit("{t7}")).alias("s")).first().s
    return generic.keys_in_slot(keys, slot, 20)


@query("q_fnv1a", "SELECT key, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: CAST(ord(substr(key, CAST(i AS INT), 1)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 1000003 AS h FROM (SELECT DISTINCT key FROM chash)".replace("% 1000003 AS h", "").replace(" FROM (SELECT", "::VARCHAR AS h FROM (SELECT"))
def _(t):
    h = X.fnv1a("key")
    unsigned = F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)"))
    return t.chash().select("key").distinct().select("key", unsigned.cast("decimal(20,0)").cast("string").alias("h"))


# lists


@query("q_rpush", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM elist")
def _(t):
    return lists.push(t.elist().select(*KEY, F.col("pos").alias("seq"), F.lit(0).alias("arg"), "value"), left=False).select("key", "pos", "value")


_EXTRA = "(SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer)"


def _extra(t):
    return shaped(t.raw("customer"), key=F.col("c_custkey").cast("string"), seq="c_custkey", arg=F.lit(0), value="c_mktsegment")


for _name, _left, _edge in (("q_lpushx", True, "min(pos) - 1"), ("q_rpushx", False, "max(pos) + 1")):

    @query(_name, f"SELECT key, pos, value FROM elist UNION ALL SELECT key, p AS pos, value FROM {_EXTRA} JOIN (SELECT key, {_edge} AS p FROM elist GROUP BY key) USING (key)")
    def _(t, left=_left):
        return lists.push(_extra(t), left, t.elist(), only_existing=True).select("key", "pos", "value")


# hashes


def _fields(t):
    """For each customer a field that is there and one that isn't."""
    keys = t.chash().select(*KEY).distinct()
    return keys.withColumn("field", F.explode(F.array(F.lit("segment"), F.lit("zip"))))


_ASKED = "(SELECT key, field, value FROM (SELECT DISTINCT key FROM chash) CROSS JOIN (VALUES ('segment'), ('zip')) f(field) LEFT JOIN chash USING (key, field))"


@query("q_hexists", f"SELECT key, field, CAST(value IS NOT NULL AS BIGINT) AS reply FROM {_ASKED}")
def _(t):
    return hashes.hexists(t.chash(), _fields(t)).select("key", "field", "reply")


@query("q_hstrlen", f"SELECT key, field, CAST(coalesce(strlen(value), 0) AS BIGINT) AS n FROM {_ASKED}")
def _(t):
    return hashes.hstrlen(t.chash(), _fields(t)).select("key", "field", "n")


@query("q_hgetdel", f"SELECT 'read' AS part, key, field, value FROM {_ASKED} UNION ALL SELECT 'left', key, field, value FROM chash WHERE field <> 'segment'")
def _(t):
    read, left = hashes.hgetdel(t.chash(), _fields(t))
    return read.select(F.lit("read").alias("part"), "key", "field", "value").unionByName(left.select(F.lit("left").alias("part"), "key", "field", "value"))


@query("q_hgetex", f"SELECT key, field, value, CASE WHEN field = 'segment' THEN {NOW + 7} END AS field_expire_at FROM chash")
def _(t):
    return hashes.hgetex(t.chash(), _fields(t), NOW, NOW + 7)[1].select("key", "field", "value", "field_expire_at")


@query("q_hincrby_overflow", "SELECT key, field, CASE WHEN s BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(s AS BIGINT) END AS value, CASE WHEN s BETWEEN -9223372036854775808 AND 9223372036854775807 THEN NULL ELSE 'ERR increment or decrement would overflow' END AS err FROM (SELECT key, cmd AS field, sum(cents::HUGEINT * 40000000000000::HUGEINT) AS s FROM log GROUP BY 1, 2)")
def _(t):
    big = t.log().withColumns({"field": F.col("cmd"), "by": F.col("cents").cast("decimal(20,0)") * F.lit(40000000000000).cast("decimal(18,0)")})
    return hashes.hincrby(big).select("key", "field", "value", "err")


@query("q_hincrbyfloat", "SELECT key, cmd AS field, CASE WHEN cmd = 'error' THEN NULL ELSE round(sum(value), 2) END AS value, CASE WHEN cmd = 'error' THEN 'ERR increment would produce NaN or Infinity' END AS err FROM log GROUP BY 1, 2")
def _(t):
    log = t.log().withColumns({"field": F.col("cmd"), "by": F.when(F.col("cmd") == "error", F.lit(float("inf"))).otherwise(F.col("value"))})
    return hashes.hincrbyfloat(log).select("key", "field", F.round("value", 2).alias("value"), "err")


@query("q_hrandfield", "SELECT key, least(count(*), 2) AS n, least(count(*), 2) AS n_distinct, TRUE AS members FROM chash GROUP BY key")
def _(t):
    got = generic.random_members(t.chash(), "field", 2, seed=5).select(*KEY, "field")
    there = got.join(t.chash().select(*KEY, "field").withColumn("there", F.lit(True)), [*KEY, "field"], "left")
    return there.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("field").alias("n_distinct"), F.bool_and(F.coalesce("there", F.lit(False))).alias("members"))


@query("q_hscan", "SELECT field FROM (SELECT DISTINCT key AS field FROM log WHERE cmd = 'view') WHERE field >= '2' ORDER BY field LIMIT 15")
def _(t):
    fields = t.log().where("cmd = 'view'").select("db", F.col("cmd").alias("key"), F.col("key").alias("field")).distinct()
    return generic.scan(fields, "field", "2", 15, order=F.col("field")).select("field")


@query("q_hsetex", f"SELECT key, field, CASE WHEN field = 'name' THEN 'x' ELSE value END AS value, CASE WHEN field = 'name' THEN {NOW + 3} END AS field_expire_at FROM chash")
def _(t):
    keys = t.chash().select(*KEY).distinct().withColumn("n", F.substring("key", 10, 20).cast("bigint"))
    # the command of the first kind names fields that exist, that of the second also one that doesn't: FXX lets the first through
    one = keys.select(*KEY, (F.col("n") * 2).alias("seq"), F.lit(0).alias("arg"), F.lit("name").alias("field"), F.lit("x").alias("value"))
    two = keys.select(*KEY, (F.col("n") * 2 + 1).alias("seq"), F.explode(F.array(F.lit("nation"), F.lit("zip"))).alias("field")).select(*KEY, "seq", F.lit(1).alias("arg"), "field", F.lit("y").alias("value"))
    return hashes.hsetex(one.unionByName(two), t.chash(), NOW + 3, "fxx").select("key", "field", "value", "field_expire_at")


def _timed_fields(t):
    n = F.substring("key", 10, 20).cast("bigint")
    return t.chash().withColumn("field_expire_at", F.when(F.col("field") == "name", F.lit(NOW) + n * 777).when(F.col("field") == "segment", F.lit(NOW + 400)))


_TIMED = f"(SELECT key, field, CASE field WHEN 'name' THEN {NOW} + CAST(substr(key, 10) AS BIGINT) * 777 WHEN 'segment' THEN {NOW + 400} END AS e FROM chash)"


@query("q_httl", f"SELECT key, field, CASE WHEN e IS NULL THEN -1 ELSE (e - {NOW} + 500) // 1000 END AS httl, CASE WHEN e IS NULL THEN -1 ELSE e - {NOW} END AS hpttl, CASE WHEN e IS NULL THEN -1 ELSE (e + 500) // 1000 END AS hexpiretime, coalesce(e, -1) AS hpexpiretime FROM {_TIMED}")
def _(t):
    at = "field_expire_at"
    return _timed_fields(t).select(
        "key", "field", ttl.ttl(at, NOW).alias("httl"), ttl.pttl(at, NOW).alias("hpttl"),
        ttl.expiretime(at).alias("hexpiretime"), ttl.pexpiretime(at).alias("hpexpiretime"),
    )


@query("q_hpersist", f"SELECT key, field, CAST(e IS NOT NULL AS BIGINT) AS reply, CAST(NULL AS BIGINT) AS field_expire_at FROM {_TIMED}")
def _(t):
    return ttl.persist(_timed_fields(t), "field_expire_at").select("key", "field", "reply", "field_expire_at")


# sets


@query("q_srem", "SELECT key, member FROM users WHERE CAST(member AS BIGINT) % 2 = 0")
def _(t):
    return sets.srem(t.users(), t.users().where("cast(member as bigint) % 2 = 1")).select("key", "member")


@query("q_smembers", "SELECT key, list_sort(list(member)) AS members FROM users GROUP BY key".replace("list_sort(list(member))", "array_to_string(list_sort(list(member)), ',')"))
def _(t):
    return sets.smembers(t.users()).select("key", F.array_join("members", ",").alias("members"))


@query("q_spop", "SELECT key, least(count(*), 7) AS n_popped, count(*) - least(count(*), 7) AS n_left, count(*) AS n_both FROM users GROUP BY key")
def _(t):
    popped, left = generic.random_pop(t.users(), "member", 7, seed=3)
    both = popped.unionByName(left).groupBy(*KEY).agg(F.countDistinct("member").alias("n_both"))
    n = lambda df, name: df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    return both.join(n(popped, "n_popped"), KEY).join(n(left, "n_left"), KEY).select("key", "n_popped", "n_left", "n_both")


@query("q_srandmember", "SELECT key, least(count(*), 12) AS n, TRUE AS members FROM users GROUP BY key")
def _(t):
    got = generic.random_members(t.users(), "member", 12, seed=9).join(t.users().withColumn("there", F.lit(True)), [*KEY, "member"], "left")
    return got.groupBy("key").agg(F.countDistinct("member").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("members"))


@query("q_srandmember_repeats", "SELECT key, CAST(400 AS BIGINT) AS n, TRUE AS members FROM users GROUP BY key")
def _(t):
    got = generic.random_repeats(t.users(), "member", 400, seed=2).join(t.users().withColumn("there", F.lit(True)), [*KEY, "member"], "left")
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("members"))


@query("q_sinterstore", "SELECT key, member FROM users UNION ALL SELECT 'both', member FROM (SELECT member FROM users WHERE key = 'click' INTERSECT SELECT member FROM users WHERE key = 'error')")
def _(t):
    return sets.store(t.users(), "both", sets.sinter(t.users(), ["click", "error"])).select("key", "member")


@query("q_sdiffstore", "SELECT key, member FROM segs WHERE key <> 'BUILDING' UNION ALL SELECT 'BUILDING', member FROM (SELECT member FROM segs WHERE key = 'MACHINERY' EXCEPT SELECT member FROM segs WHERE key = 'HOUSEHOLD')")
def _(t):
    return sets.store(t.segs(), "BUILDING", sets.sdiff(t.segs(), ["MACHINERY", "HOUSEHOLD"])).select("key", "member")


@query("q_sdiffstore_empty", "SELECT key, member FROM segs WHERE key <> 'BUILDING'")
def _(t):
    return sets.store(t.segs(), "BUILDING", sets.sdiff(t.segs(), ["MACHINERY", "MACHINERY"])).select("key", "member")


@query("q_sscan", "SELECT member FROM users WHERE key = 'click' AND member >= '3' ORDER BY member LIMIT 20")
def _(t):
    return generic.scan(t.users().where("key = 'click'"), "member", "3", 20, order=F.col("member")).select("member")


# sorted sets

_RANK = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS back, count(*) OVER (PARTITION BY key) AS n FROM board"


@query("q_zincrby", "SELECT cmd AS key, key AS member, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS score FROM log GROUP BY 1, 2")
def _(t):
    log = t.log().select("db", F.col("cmd").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"), "seq")
    got = zsets.zadd(log.where("seq >= 100"), "incr", zsets.zadd(log.where("seq < 100"), "incr"))
    return got.select("key", "member", F.round("score", 2).alias("score"))


@query("q_zrem", "SELECT key, member, score FROM board WHERE member NOT IN ('3', '5', '8')")
def _(t):
    return zsets.zrem(t.board(), t.board().where("member in ('3', '5', '8')")).select("key", "member", "score")


@query("q_zcard", "SELECT key, count(*) AS n FROM board GROUP BY key")
def _(t):
    return zsets.zcard(t.board()).select("key", "n")


@query("q_zrevrank", f"SELECT key, member, score, back AS rank FROM ({_RANK}) WHERE member IN ('7', '42')")
def _(t):
    keys = t.board().select(*KEY).distinct()
    asked = keys.withColumn("member", F.explode(F.array(F.lit("7"), F.lit("42"), F.lit("none"))))
    return zsets.zrank(t.board(), asked, reverse=True).select("key", "member", "score", "rank")


@query("q_zrevrangebylex", "SELECT 'lex' AS key, member FROM (SELECT DISTINCT member FROM board) WHERE member > '12' AND member <= '4' ORDER BY member DESC LIMIT 9 OFFSET 2")
def _(t):
    z = t.board().select("db", F.lit("lex").alias("key"), "member", F.lit(0.0).alias("score")).distinct()
    return zsets.zrangebylex(z, "(12", "[4", reverse=True, offset=2, count=9).select("key", "member")


@query("q_zremrangebylex", "SELECT key, member FROM board WHERE NOT (member >= '2' AND member < '5')")
def _(t):
    return zsets.zremrangebylex(t.board(), "[2", "(5").select("key", "member")


@query("q_zmpop", f"SELECT key, member, score FROM ({_RANK}) WHERE key = 'view' AND back < 4")
def _(t):
    first = lists.first_nonempty(t.board(), probe(t.spark, ["nope", "view", "click"]))
    return zsets.zpop(first, 4, largest=True)[0].select("key", "member", "score")


@query("q_zpop_left", f"SELECT key, member, score FROM ({_RANK}) WHERE back >= 5")
def _(t):
    return zsets.zpop(t.board(), 5, largest=True)[1].select("key", "member", "score")


@query("q_zrandmember", "SELECT key, least(count(*), 6) AS n, TRUE AS scores FROM board GROUP BY key")
def _(t):
    got = generic.random_members(t.board(), "member", 6, seed=4).join(t.board().withColumnRenamed("score", "own"), [*KEY, "member"], "left")
    return got.groupBy("key").agg(F.countDistinct("member").alias("n"), F.bool_and(F.col("own").eqNullSafe(F.col("score"))).alias("scores"))


@query("q_zscan", "SELECT member, score FROM board WHERE key = 'click' AND member >= '5' ORDER BY member LIMIT 20")
def _(t):
    return generic.scan(t.board().where("key = 'click'"), "member", "5", 20, order=F.col("member")).select("member", "score")


@query("q_zrangestore", f"SELECT key, member, score FROM board UNION ALL SELECT 'top', member, score FROM ({_RANK}) WHERE key = 'click' AND back <= 9")
def _(t):
    top = zsets.zrange(t.board().where("key = 'click'"), 0, 9, reverse=True).select("member", "score")
    return sets.store(t.board(), "top", top).select("key", "member", "score")


_STORED = {
    "q_zunionstore": ("union", "SELECT member, round(sum(score), 2) AS score FROM board WHERE key IN ('click', 'view') GROUP BY member"),
    "q_zinterstore": ("inter", "SELECT member, round(sum(score), 2) AS score FROM board WHERE key IN ('click', 'view') GROUP BY member HAVING count(*) = 2"),
    "q_zdiffstore": ("diff", "SELECT member, round(score, 2) AS score FROM board WHERE key = 'click' AND member NOT IN (SELECT member FROM board WHERE key = 'view')"),
}
for _name, (_how, _sql) in _STORED.items():

    @query(_name, f"SELECT key, member, round(score, 2) AS score FROM board WHERE key <> 'error' UNION ALL SELECT 'error', member, score FROM ({_sql})")
    def _(t, how=_how):
        return sets.store(t.board(), "error", zsets.combine(t.board(), ["click", "view"], how)).select("key", "member", F.round("score", 2).alias("score"))


# bitmaps and sketches


@query("q_setbit", "SELECT key, bit FROM (SELECT cmd AS key, seq % 700 AS bit, arg_max(cents % 2, seq) AS is_on FROM log GROUP BY 1, 2) WHERE is_on = 1")
def _(t):
    writes = t.log().select("db", F.col("cmd").alias("key"), (F.col("seq") % 700).alias("bit"), (F.col("cents") % 2).alias("on"), "seq")
    return bitmaps.setbit(writes).select("key", "bit")


@query("q_getbit", "SELECT k.key, CAST(d.bit AS BIGINT) AS bit, CAST(b.bit IS NOT NULL AS BIGINT) AS is_on FROM (SELECT DISTINCT key FROM bits) k CROSS JOIN (VALUES (0), (3), (900)) d(bit) LEFT JOIN bits b ON b.key = k.key AND b.bit = d.bit")
def _(t):
    asked = t.bits().select(*KEY).distinct().withColumn("bit", F.explode(F.array(*(F.lit(b).cast("bigint") for b in (0, 3, 900)))))
    return bitmaps.getbit(t.bits(), asked).select("key", "bit", F.col("on").alias("is_on"))


@query("q_bitfield_set", "SELECT key, bit FROM bits WHERE bit NOT BETWEEN 4 AND 8 UNION ALL SELECT key, d FROM (SELECT DISTINCT key FROM bits) CROSS JOIN (VALUES (5), (7), (8)) v(d)")
def _(t):
    return bitmaps.bitfield_set(t.bits(), 5, 4, 0b01011).select("key", "bit")


def _registers(t):
    e = t.raw("events")
    return shaped(e, key="event_type", idx=(F.col("user_id") * 37 % 16384).cast("int"), rho=(F.col("event_id") % 49 + 1).cast("int"))


@query("q_pfmerge", "SELECT 'all' AS key, user_id * 37 % 16384 AS idx, max(event_id % 49 + 1) AS rho FROM events GROUP BY 2")
def _(t):
    return hll.merge(_registers(t), "all").select("key", "idx", "rho")


@query("q_pfdebug_getreg", "SELECT k.key, r.idx, coalesce(rho, 0) AS rho FROM (SELECT DISTINCT event_type AS key FROM events) k CROSS JOIN (SELECT range AS idx FROM range(16384)) r LEFT JOIN (SELECT event_type AS key, user_id * 37 % 16384 AS idx, max(event_id % 49 + 1) AS rho FROM events GROUP BY 1, 2) m ON m.key = k.key AND m.idx = r.idx")
def _(t):
    return hll.dense_registers(hll.merge(_registers(t))).select("key", "idx", "rho")


# transactions, locks and blocking commands


@query("q_txn_discard", "SELECT event_id // 10 AS txn, CASE WHEN bool_or(event_type = 'signup') THEN 'discarded' ELSE 'done' END AS fate FROM events GROUP BY 1")
def _(t):
    ops = t.raw("events").select(F.floor(F.col("event_id") / 10).alias("txn"), "ts", F.lit(False).alias("queue_err"), (F.col("event_type") == "signup").alias("discard"))
    return fold.exec_transactions(ops).select("txn", "fate")


@query("q_unwatch", "SELECT w.event_id AS txn, count(x.event_id) > 0 AS dirty FROM (SELECT * FROM events WHERE event_type = 'view' AND event_id % 2 = 0) w LEFT JOIN events x ON x.user_id = w.user_id AND x.event_type = 'purchase' AND x.event_id > w.event_id AND x.event_id < w.event_id + 200 GROUP BY 1")
def _(t):
    e = t.log()
    forgot = F.when(F.col("seq") % 2 == 1, F.col("seq") + 50)
    watches = e.where("cmd = 'view'").select(F.col("seq").alias("txn"), *KEY, "seq", (F.col("seq") + 200).alias("exec_seq"), forgot.alias("unwatch_seq"))
    return fold.watch_dirty(watches, e.where("cmd = 'purchase'")).select("txn", "dirty")


def _blocking_events(t, place):
    e = t.log().where("cmd in ('view', 'click')")
    return e.select(
        *KEY, "seq", F.when(F.col("cmd") == "view", "wait").otherwise("push").alias("kind"), (F.col("seq") % 13).alias("conn"),
        F.when(F.col("seq") % 3 != 0, F.col("seq") + 600).alias("deadline"), F.col(place).cast("double").alias("place"), F.col("seq").cast("string").alias("value"),
    )


def _blocking_sql(place: str, last: bool, count: int) -> str:
    """A replay in SQL: one step for each event of a key, with its waiters and its elements as lists."""
    cut = f"array_slice(items, greatest(len(items) - {count - 1}, 1), len(items))" if last else f"array_slice(items, 1, least({count}, len(items)))"
    rest = f"array_slice(items, 1, greatest(len(items) - {count}, 0))" if last else f"array_slice(items, {count + 1}, len(items))"
    return f"""SELECT key, w AS seq, p.s AS push_seq FROM (WITH RECURSIVE
e AS (SELECT key, seq, cmd = 'click' AS is_push, CASE WHEN seq % 3 <> 0 THEN seq + 600 ELSE 1000000000000 END AS deadline, {place} AS place,
  row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM log WHERE cmd IN ('view', 'click')),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(w BIGINT, d BIGINT)[]) AS waiting, CAST([] AS STRUCT(o DOUBLE, s BIGINT)[]) AS items,
  CAST(NULL AS BIGINT) AS w, CAST([] AS STRUCT(o DOUBLE, s BIGINT)[]) AS got FROM e
UNION ALL
SELECT key, k, CASE WHEN served THEN (CASE WHEN is_push THEN live[2:] ELSE live END) WHEN is_push THEN live ELSE list_append(live, {{'w': seq, 'd': deadline}}) END,
  CASE WHEN served THEN {rest} ELSE items END, CASE WHEN served THEN (CASE WHEN is_push THEN live[1].w ELSE seq END) END, CASE WHEN served THEN {cut} ELSE [] END
FROM (SELECT key, k, seq, deadline, is_push, live, items, len(items) > 0 AND (NOT is_push OR len(live) > 0) AS served
  FROM (SELECT r.key, e.k, e.seq, e.deadline, e.is_push, list_filter(r.waiting, lambda x: x.d >= e.seq) AS live,
    CASE WHEN e.is_push THEN list_sort(list_append(r.items, {{'o': CAST(e.place AS DOUBLE), 's': e.seq}})) ELSE r.items END AS items
    FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)))
SELECT key, w, unnest(got) AS p FROM r WHERE w IS NOT NULL)"""


for _name, _by, _last, _count in (
    ("q_blpop", "seq", False, 1), ("q_brpop", "seq", True, 1), ("q_blmpop", "seq", False, 2),
    ("q_bzpopmin", "value", False, 1), ("q_bzpopmax", "value", True, 1), ("q_bzmpop", "value", True, 3),
):

    @query(_name, _blocking_sql(_by, _last, _count))
    def _(t, by=_by, last=_last, count=_count):
        return fold.blocking(_blocking_events(t, by), last, count).select("key", "seq", "push_seq")


for _name, _last, _to_left in (("q_blmove", False, False), ("q_brpoplpush", True, True)):
    _order = "greatest(seq, push_seq), seq"

    @query(_name, f"SELECT key, push_seq::VARCHAR AS value, {'-' if _to_left else ''}row_number() OVER (ORDER BY {_order}){'' if _to_left else ' - 1'} AS pos FROM (SELECT 'moved' AS key, seq, push_seq FROM ({_blocking_sql('seq', _last, 1)}) WHERE key = '7')")
    def _(t, last=_last, to_left=_to_left):
        events = _blocking_events(t, "seq").where("key = '7'")  # the one source list of the command
        return fold.blocking_move(events, "moved", not last, to_left).select("key", "value", "pos")


@query("q_wait", "SELECT event_type AS shard, count(*) FILTER (acked >= 9000) AS replicas, count(*) FILTER (acked >= 9000) >= 2 AS enough FROM (SELECT event_type, user_id % 3 AS node, max(event_id) - 400 * (user_id % 3) AS acked FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    acks = t.raw("events").groupBy(F.col("event_type").alias("shard"), (F.col("user_id") % 3).alias("node")).agg(F.max("event_id").alias("top"))
    acks = acks.select("shard", "node", (F.col("top") - 400 * F.col("node")).alias("acked"))
    asked = acks.select("shard").distinct().select("shard", F.lit(9000).alias("off"), F.lit(2).alias("want"))
    return persist.wait_acks(acks, asked).select("shard", "replicas", "enough")


_TRACKED = "SELECT r.event_id AS seq, {conn} AS conn, min(w.event_id) AS write_seq FROM events r JOIN events w ON w.user_id = r.user_id AND w.event_type = 'purchase' AND w.event_id > r.event_id WHERE r.event_type = 'view'{where} GROUP BY 1, 2"


@query("q_tracking_optin", _TRACKED.format(conn="r.user_id % 7", where=" AND r.event_id % 3 = 0"))
def _(t):
    e = t.log().withColumn("conn", F.col("key").cast("bigint") % 7).withColumn("caching", F.when(F.col("seq") % 3 == 0, True))
    return fold.invalidations(e.where("cmd = 'view'"), e.where("cmd = 'purchase'"), mode="optin").select("seq", "conn", "write_seq")


@query("q_tracking_optout", _TRACKED.format(conn="r.user_id % 7", where=" AND r.event_id % 3 <> 0"))
def _(t):
    e = t.log().withColumn("conn", F.col("key").cast("bigint") % 7).withColumn("caching", F.when(F.col("seq") % 3 == 0, False))
    return fold.invalidations(e.where("cmd = 'view'"), e.where("cmd = 'purchase'"), mode="optout").select("seq", "conn", "write_seq")


@query("q_tracking_redirect", _TRACKED.format(conn="CASE WHEN r.user_id % 2 = 0 THEN 99 ELSE r.user_id % 7 END", where=""))
def _(t):
    e = t.log().withColumn("conn", F.col("key").cast("bigint") % 7)
    reads = e.where("cmd = 'view'").withColumn("redirect", F.when(F.col("key").cast("bigint") % 2 == 0, F.lit(99).cast("bigint")))
    return fold.invalidations(reads, e.where("cmd = 'purchase'")).select("seq", "conn", "write_seq")


# connections and settings

_SESSION = """(SELECT event_id AS seq, user_id AS conn, CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'PING' WHEN 'purchase' THEN (CASE event_id % 4 WHEN 0 THEN 'READONLY' WHEN 1 THEN 'READWRITE' WHEN 2 THEN 'MULTI' ELSE 'EXEC' END)
  WHEN 'signup' THEN 'ECHO' ELSE (CASE event_id % 9 WHEN 0 THEN 'QUIT' WHEN 1 THEN 'RESET' ELSE 'GET' END) END AS cmd,
  CASE event_type WHEN 'click' THEN CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 18 AS VARCHAR) END WHEN 'signup' THEN 'e' || event_id END AS arg FROM events)"""
_STATE = f"""(SELECT *, coalesce(last_value(CASE cmd WHEN 'SELECT' THEN TRY_CAST(arg AS BIGINT) WHEN 'RESET' THEN 0 END IGNORE NULLS) OVER w, 0) AS session_db,
  coalesce(last_value(CASE WHEN cmd = 'READONLY' THEN TRUE WHEN cmd IN ('READWRITE', 'RESET') THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS readonly,
  coalesce(last_value(CASE WHEN cmd = 'MULTI' THEN TRUE WHEN cmd IN ('EXEC', 'DISCARD', 'RESET') THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS queued,
  coalesce(bool_or(cmd = 'QUIT') OVER w, FALSE) AS closed FROM {_SESSION} WINDOW w AS (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _session(t):
    e, kind, i = t.raw("events"), F.col("event_type"), F.col("event_id")
    pick = lambda by, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (by + 1).cast("int"))
    cmd = (
        F.when(kind == "click", "SELECT").when(kind == "view", "PING").when(kind == "purchase", pick(i % 4, "READONLY", "READWRITE", "MULTI", "EXEC"))
        .when(kind == "signup", "ECHO").when(i % 9 == 0, "QUIT").when(i % 9 == 1, "RESET").otherwise("GET")
    )
    arg = F.when(kind == "click", F.when(i % 11 == 0, "x").otherwise((i % 18).cast("string"))).when(kind == "signup", F.concat(F.lit("e"), i))
    return e.select(F.col("user_id").alias("conn"), i.alias("seq"), cmd.alias("cmd"), arg.alias("arg"))


@query("q_session_state", f"SELECT seq, session_db, readonly, queued, closed FROM {_STATE}")
def _(t):
    return session.session_state(_session(t)).select("seq", "session_db", "readonly", "queued", "closed")


@query("q_session_replies", f"""SELECT seq, cmd, CASE WHEN closed THEN NULL WHEN cmd = 'RESET' THEN 'RESET' WHEN cmd = 'QUIT' THEN 'OK' WHEN queued AND cmd IN ('PING', 'ECHO', 'SELECT', 'READONLY', 'READWRITE') THEN 'QUEUED'
  WHEN cmd = 'PING' THEN coalesce(arg, 'PONG') WHEN cmd = 'ECHO' THEN arg WHEN cmd = 'SELECT' AND arg = 'x' THEN 'ERR value is not an integer or out of range' WHEN cmd = 'SELECT' AND arg IN ('16', '17') THEN 'ERR DB index is out of range'
  WHEN cmd IN ('SELECT', 'READONLY', 'READWRITE') THEN 'OK' END AS reply FROM {_STATE}""")
def _(t):
    return session.session_replies(_session(t)).select("seq", "cmd", "reply")


_SETTINGS = "(SELECT lower(p_brand) || '-' || p_size AS name, max(p_type) AS value FROM part GROUP BY 1)"


def _settings(t):
    name = F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_size"))
    return t.raw("part").groupBy(name.alias("name")).agg(F.max("p_type").alias("value"))


@query("q_config_get", f"SELECT name, value FROM {_SETTINGS} WHERE name GLOB 'brand#1?-*' OR name GLOB '*-7'")
def _(t):
    return session.config_get(_settings(t), "BRAND#1?-*", "*-7")


@query("q_config_set", f"SELECT name, CASE WHEN name IN (SELECT lower(p_brand) || '-' || p_size FROM part WHERE p_size = 3 AND p_partkey % 2 = 0) THEN 'set' ELSE value END AS value FROM {_SETTINGS}")
def _(t):
    rows = t.raw("part").where("p_size = 3").select(F.col("p_partkey").alias("seq"), F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size")).alias("name"), F.lit("set").alias("value"))
    # commands of odd numbers also name a setting that doesn't exist
    return session.config_set(_settings(t), rows.unionByName(rows.where("seq % 2 = 1").withColumn("name", F.lit("none"))))


# routing, publication, persistence, statistics


@query("q_key_extraction", """SELECT seq, cmd, CAST(k.i - 1 AS BIGINT) AS nth, keys[k.i] AS key FROM (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'MSET' WHEN 'view' THEN 'ZUNIONSTORE' WHEN 'purchase' THEN 'SORT'
  WHEN 'signup' THEN 'BITOP' ELSE 'MSETEX' END AS cmd, CASE event_type WHEN 'click' THEN (CASE WHEN event_id % 2 = 0 THEN ['a' || user_id, 'b'] ELSE [] END)
  WHEN 'view' THEN ['d' || user_id, 'x', 'y'] WHEN 'purchase' THEN ['l' || user_id, 'out'] WHEN 'signup' THEN ['d', 's' || user_id, 's2']
  ELSE (CASE WHEN event_id % 2 = 0 THEN ['m' || user_id, 'n'] ELSE [] END) END AS keys FROM events), (SELECT unnest([1, 2, 3]) AS i) k WHERE k.i <= len(keys)""")
def _(t):
    u, even = F.col("user_id").cast("string"), F.col("event_id") % 2 == 0
    arr = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    e = t.raw("events")
    kind = F.col("event_type")
    cmd = F.when(kind == "click", "mset").when(kind == "view", "ZUNIONSTORE").when(kind == "purchase", "Sort").when(kind == "signup", "BITOP").otherwise("MSETEX")
    args = (
        F.when(kind == "click", F.when(even, arr(F.concat(F.lit("a"), u), "1", "b", "2")).otherwise(arr(F.concat(F.lit("a"), u), "1", "b")))
        .when(kind == "view", arr(F.concat(F.lit("d"), u), "2", "x", "y", "WEIGHTS", "2", "3"))
        .when(kind == "purchase", arr(F.concat(F.lit("l"), u), "BY", "w_*", "store", "out"))
        .when(kind == "signup", arr("AND", "d", F.concat(F.lit("s"), u), "s2"))
        .otherwise(F.when(even, arr("2", F.concat(F.lit("m"), u), "v", "n", "v", "NX")).otherwise(arr("3", F.concat(F.lit("m"), u), "v", "n", "v")))
    )
    ops = e.select(F.col("event_id").alias("seq"), cmd.alias("cmd"), args.alias("args"))
    return routing.routed(ops).select("seq", F.upper("cmd").alias("cmd"), "nth", "key")


@query("q_spublish", f"SELECT seq, channel, conn, CAST({_CRC.format(k='channel')} * 4 // 16384 AS BIGINT) AS shard FROM (SELECT event_id AS seq, 'user:' || user_id AS channel FROM events) JOIN (SELECT c_custkey AS conn, 'user:' || c_custkey % 500 AS channel FROM customer) USING (channel)")
def _(t):
    messages = t.raw("events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), t.user).alias("channel"))
    subs = t.raw("customer").select(F.col("c_custkey").alias("conn"), F.concat(F.lit("user:"), F.col("c_custkey") % 500).alias("channel"))
    return stats.shard_publish(messages, subs, 4)


@query("q_numpat", "SELECT count(DISTINCT c_mktsegment || '*') AS n FROM customer")
def _(t):
    return stats.numpat(t.raw("customer").select(F.col("c_custkey").alias("conn"), F.concat("c_mktsegment", F.lit("*")).alias("pattern")))


@query("q_shardnumsub", "SELECT 'user:' || c_custkey % 500 AS channel, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return stats.numsub(t.raw("customer").select(F.col("c_custkey").alias("conn"), F.concat(F.lit("user:"), F.col("c_custkey") % 500).alias("channel")))


@query("q_save_load", "SELECT 'sets' AS tab, count(*) AS n, CAST(sum(strlen(member)) AS BIGINT) AS bytes FROM users UNION ALL SELECT 'hash', count(*), CAST(sum(strlen(value)) AS BIGINT) FROM chash")
def _(t):
    path = ranges.shared_path(t.spark)
    persist.save({"sets": t.users(), "hash": t.chash()}, path, NOW)
    got = persist.load(t.spark, path)
    one = lambda name, c: got[name].agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(c)).alias("bytes")).select(F.lit(name).alias("tab"), "n", "bytes")
    return one("sets", "member").unionByName(one("hash", "value"))


@query("q_lastsave", f"SELECT CAST({NOW} AS BIGINT) AS saved_at")
def _(t):
    manifest = t.asked([("sets", 1, NOW - 5), ("hash", 2, NOW)], "table string, n_rows bigint, saved_at bigint")
    return persist.lastsave(manifest)


@query("q_snapshot_mode", "SELECT * FROM (VALUES (0, 'base'), (1, 'delta'), (2, 'base'), (3, 'base')) v(i, mode)".replace("(VALUES (0,", "(VALUES (CAST(0 AS BIGINT),"))
def _(t):
    cases = [(0, 10, 0), (100, 10, 2), (100, 10, 8), (100, 60, 1)]
    return t.asked([(i, persist.snapshot_mode(*c)) for i, c in enumerate(cases)], "i bigint, mode string")


@query("q_promotion", "SELECT shard, arg_min(node, (lag, node)) AS node FROM (SELECT event_type AS shard, user_id % 5 AS node, (SELECT max(event_id) FROM events) - max(event_id) AS lag, user_id % 5 <> 2 AS up FROM events GROUP BY 1, 2, 4) WHERE up AND lag <= 2000 GROUP BY 1")
def _(t):
    e = t.raw("events")
    head = e.agg(F.max("event_id").alias("head"))  # one row
    acks = e.groupBy(F.col("event_type").alias("shard"), (F.col("user_id") % 5).alias("node")).agg(F.max("event_id").alias("acked"))
    heads = acks.select("shard").distinct().join(F.broadcast(head))
    lags = persist.lag(heads, acks).withColumn("link_up", F.col("node") != 2)
    return persist.promotable(lags, 2000)


@query("q_backlog", "SELECT event_id AS off, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click' AND event_id > 4321")
def _(t):
    path = ranges.shared_path(t.spark)
    log = t.raw("events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("off"), t.user.alias("key"))
    persist.spill(log, path, 1000)
    return persist.ops_after(t.spark, path, "click", 4321, 1000).select("off", "key")


@query("q_backlog_prune", "SELECT shard, segment FROM (SELECT DISTINCT event_type AS shard, event_id // 1000 AS segment, (SELECT max(x.event_id) FROM events x WHERE x.event_type = events.event_type) AS head FROM events) WHERE (segment + 1) * 1000 <= head - 2500")
def _(t):
    log = t.raw("events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("off"))
    return persist.prune(log, 2500, 1000)


@query("q_latency_latest", "SELECT cmd AS event, arg_max(usec, seq) AS last_ms, max(usec) AS max_ms, max(seq) AS last_ts FROM ops GROUP BY 1")
def _(t):
    return stats.latency_monitor(t.ops().select(F.col("cmd").alias("event"), F.col("usec").alias("ms"), F.col("seq").alias("ts")))


_AGED = "(SELECT key, list_reduce(list_prepend(CAST(0 AS BIGINT), list(n ORDER BY p)), lambda a, x: least(15, a // 2 + x)) AS freq FROM (SELECT k.key, p.p, count(o.seq) AS n FROM (SELECT DISTINCT key FROM ops) k CROSS JOIN (SELECT DISTINCT seq // 1000 AS p FROM ops) p LEFT JOIN ops o ON o.key = k.key AND o.seq // 1000 = p.p GROUP BY 1, 2) GROUP BY key)"


@query("q_aged_counts", f"SELECT key, freq FROM {_AGED}")
def _(t):
    return stats.aged_counts(t.ops(), 1000)


@query("q_tinylfu_admit", f"WITH_AGED SELECT c_custkey::VARCHAR AS candidate, (c_custkey % 20)::VARCHAR AS victim, coalesce(a.freq, 0) > coalesce(b.freq, 0) AS admitted FROM customer LEFT JOIN {_AGED} a ON a.key = c_custkey::VARCHAR LEFT JOIN {_AGED} b ON b.key = (c_custkey % 20)::VARCHAR".replace("WITH_AGED ", ""))
def _(t):
    pairs = t.raw("customer").select(F.col("c_custkey").cast("string").alias("candidate"), (F.col("c_custkey") % 20).cast("string").alias("victim"))
    return stats.tinylfu_admit(pairs, stats.aged_counts(t.ops(), 1000)).select("candidate", "victim", "admitted")


_quoted = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


@query("q_command_catalog", "SELECT name, family, CAST(arity AS BIGINT) AS arity, exact, class, writes, may_grow, module FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in catalog_rows()) + ") v(name, family, arity, exact, class, writes, may_grow, module)")
def _(t):
    from keyloom.catalog import catalog

    return catalog(t.spark)
