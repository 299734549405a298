"""Keyspace commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import canonical_int, glob_match, key_slot
from keyloom.sources.model import KEY

#: Default limits of the small encodings (entries, bytes of the longest element).
HASH_SMALL, SET_SMALL, ZSET_SMALL, INTSET, LIST_BYTES, EMBSTR = (512, 64), (128, 64), (128, 64), 512, 8192, 44


def delete(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """DEL and UNLINK: keys (or rows of any table) without those asked for."""
    return keys.join(asked.select(*KEY), KEY, "left_anti")


def exists(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """EXISTS and TOUCH: how many arguments exist, repeats counted."""
    return asked.join(keys.select(*KEY).distinct(), KEY, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def type_of(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """TYPE of each argument, ``none`` if it is missing."""
    got = asked.join(keys.select(*KEY, "type"), KEY, "left")
    return got.select("pos", "key", F.coalesce("type", F.lit("none")).alias("type"))


def keys_like(keys: DataFrame, pattern: str) -> DataFrame:
    """KEYS pattern."""
    return keys.where(glob_match("key", pattern))


def scan(df: DataFrame, by: str, cursor, count: int, order: Column | None = None) -> DataFrame:
    """SCAN, HSCAN, SSCAN and ZSCAN: one page of keyset pagination.

    Rows are walked in a stable order (``order`` of ``by``, a 64-bit hash unless given); the page holds the
    ``count`` rows from ``cursor`` on and all that tie with the last.  The next cursor is the largest
    order value plus one.  MATCH and TYPE filter the page afterwards, as COUNT bounds what is examined.
    """
    order = F.xxhash64(by) if order is None else order
    walked = df.withColumn("cursor", order)
    if cursor is not None:
        walked = walked.where(F.col("cursor") >= cursor)
    edge = walked.select("cursor").orderBy("cursor").limit(count).agg(F.max("cursor").alias("edge"))
    return walked.join(F.broadcast(edge), F.col("cursor") <= F.col("edge")).drop("edge")  # edge is one row


def dbsize(keys: DataFrame) -> DataFrame:
    """DBSIZE by database."""
    return keys.groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def random_rows(df: DataFrame, by: str, n: int = 1, seed: int = 0) -> DataFrame:
    """RANDOMKEY: distinct rows of the whole table in a seeded random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), by), by).limit(n)


def random_members(df: DataFrame, by: str, n: int = 1, seed: int = 0) -> DataFrame:
    """SRANDMEMBER, HRANDFIELD and ZRANDMEMBER with a positive count: up to ``n`` distinct rows of each key.

    The rank filter lets Spark cut every key to ``n`` rows before it shuffles.
    """
    w = Window.partitionBy(*KEY).orderBy(F.xxhash64(F.lit(seed), "key", by), by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def random_pop(df: DataFrame, by: str, n: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """SPOP: up to ``n`` members of each key, and the rows that are left."""
    popped = random_members(df, by, n, seed)
    return popped, df.join(popped.select(*KEY, by), [*KEY, by], "left_anti")


def random_repeats(df: DataFrame, by: str, n: int, seed: int = 0) -> DataFrame:
    """The forms with a negative count: ``n`` draws with repeats from the rows of each key."""
    w = Window.partitionBy(*KEY).orderBy(by)
    ranked = df.withColumn("i", F.row_number().over(w) - 1)
    sizes = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.col("size")).cast("int"))
    return draws.join(ranked, [*KEY, "i"]).drop("i", "size")


def rename(df: DataFrame, source: str, target: str, nx: bool = False) -> DataFrame:
    """RENAME and RENAMENX of one key in any table: it takes the place of the target.

    With ``nx`` nothing changes where the target exists.  A key renamed to itself stays as it is.
    """
    if source == target:
        return df
    if nx:
        taken = df.where(F.col("key") == target).select("db").distinct().withColumn("taken", F.lit(True))
        df = df.join(taken, "db", "left")
        go = F.col("taken").isNull()
        return df.withColumn("key", F.when(go & (F.col("key") == source), F.lit(target)).otherwise(F.col("key"))).drop("taken")
    present = df.where(F.col("key") == source).select("db").distinct()
    gone = df.join(present.withColumn("key", F.lit(target)), KEY, "left_anti")
    return gone.withColumn("key", F.when(F.col("key") == source, F.lit(target)).otherwise(F.col("key")))


def copy(df: DataFrame, source: str, target: str, db: int | None = None, replace: bool = False) -> DataFrame:
    """COPY of one key to another name or database."""
    copied = df.where(F.col("key") == source).withColumn("key", F.lit(target))
    copied = copied if db is None else copied.withColumn("db", F.lit(db))
    taken = copied.select(*KEY).distinct()
    if replace:
        return df.join(taken, KEY, "left_anti").unionByName(copied)
    return df.unionByName(copied.join(df.select(*KEY).distinct(), KEY, "left_anti"))


def move(df: DataFrame, key: str, source: int, target: int) -> DataFrame:
    """MOVE of a key to another database where it isn't there yet."""
    taken = df.where((F.col("db") == target) & (F.col("key") == key)).select("key").distinct().withColumn("taken", F.lit(True))
    go = (F.col("db") == source) & (F.col("key") == key) & F.col("taken").isNull()
    return df.join(taken, "key", "left").withColumn("db", F.when(go, F.lit(target)).otherwise(F.col("db"))).select(*df.columns)


def swapdb(df: DataFrame, a: int, b: int) -> DataFrame:
    """SWAPDB."""
    return df.withColumn("db", F.when(F.col("db") == a, F.lit(b)).when(F.col("db") == b, F.lit(a)).otherwise(F.col("db")))


def flushdb(df: DataFrame, db: int) -> DataFrame:
    """FLUSHDB; FLUSHALL is an empty table."""
    return df.where(F.col("db") != db)


def encoding_of_string(value) -> Column:
    """OBJECT ENCODING of a string."""
    return F.when(canonical_int(value).isNotNull(), "int").when(F.octet_length(value) <= EMBSTR, "embstr").otherwise("raw")


def encoding_of_collection(kind: str, n, longest, all_ints=None, field_ttl=None, size=None) -> Column:
    """OBJECT ENCODING of a collection from its entries, longest element and, for a list, its bytes."""
    small = lambda limits: (n <= limits[0]) & (longest <= limits[1])
    if kind == "list":
        return F.when(size <= LIST_BYTES, "listpack").otherwise("quicklist")
    if kind == "set":
        ints = all_ints if all_ints is not None else F.lit(False)
        return F.when(ints & (n <= INTSET), "intset").when(small(SET_SMALL), "listpack").otherwise("hashtable")
    if kind == "zset":
        return F.when(small(ZSET_SMALL), "listpack").otherwise("skiplist")
    packed = F.when(field_ttl, "listpackex").otherwise("listpack") if field_ttl is not None else F.lit("listpack")
    return F.when(small(HASH_SMALL), packed).otherwise("hashtable")


def dump(df: DataFrame, *columns: str) -> DataFrame:
    """DUMP: a canonical serialised value for each key, with a checksum that RESTORE verifies."""
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    blob = df.groupBy(*KEY).agg(F.to_json(rows).alias("payload"))
    return blob.withColumn("checksum", F.crc32("payload"))


def restore(dumped: DataFrame, schema: str, existing: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """RESTORE: rows from dumped values whose checksum holds; keys that exist are left out unless replaced."""
    good = dumped.where(F.crc32("payload") == F.col("checksum"))
    if existing is not None and not replace:
        good = good.join(existing.select(*KEY).distinct(), KEY, "left_anti")
    rows = good.select(*KEY, F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r"))
    return rows.select(*KEY, "r.*")


def memory_usage(df: DataFrame, *columns: str, overhead: int = 56) -> DataFrame:
    """MEMORY USAGE: bytes of the key and its elements plus an overhead for each."""
    own = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    got = df.groupBy(*KEY).agg(F.sum(own + overhead).alias("b"))
    return got.select(*KEY, (F.col("b") + F.octet_length("key")).alias("bytes"))


def count_keys_in_slot(keys: DataFrame) -> DataFrame:
    """CLUSTER COUNTKEYSINSLOT for every slot that has keys."""
    return keys.withColumn("slot", key_slot("key")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def keys_in_slot(keys: DataFrame, slot: int, count: int) -> DataFrame:
    """CLUSTER GETKEYSINSLOT: the first ``count`` keys of a slot."""
    return keys.where(key_slot("key") == slot).select("key").orderBy("key").limit(count)
