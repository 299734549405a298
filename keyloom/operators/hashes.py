"""Hashes, in long form: rows (db, key, field, value, field_expire_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import I64_MAX, I64_MIN
from keyloom.sources.model import KEY

FIELD = [*KEY, "field"]


def hset(writes: DataFrame, existing: DataFrame | None = None, order=("seq", "arg")) -> DataFrame:
    """HSET, HMSET: the last write of a field wins and clears its deadline."""
    new = writes.groupBy(*FIELD).agg(F.max_by("value", F.struct(*order)).alias("value"))
    new = new.withColumn("field_expire_at", F.lit(None).cast("bigint"))
    return new if existing is None else existing.join(new, FIELD, "left_anti").unionByName(new)


def new_fields(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """What HSET replies: fields of each key that weren't there."""
    fresh = writes.select(*FIELD).distinct().join(existing, FIELD, "left_anti")
    return fresh.groupBy(*KEY).agg(F.count(F.lit(1)).alias("added"))


def hsetnx(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """HSETNX: the first write of a field that wasn't there."""
    new = writes.join(existing, FIELD, "left_anti").groupBy(*FIELD).agg(F.min_by("value", "seq").alias("value"))
    return existing.unionByName(new.withColumn("field_expire_at", F.lit(None).cast("bigint")))


def hmget(hash_: DataFrame, fields: DataFrame) -> DataFrame:
    """HGET and HMGET for every key: (pos, field) in argument order, null for a missing field.

    The argument list goes into the plan, so one aggregation by key answers all of it.
    """
    asked = sorted((r.pos, r.field) for r in fields.collect())
    wanted = F.col("field").isin([f for _, f in asked])
    got = hash_.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.when(wanted, F.struct("field", "value")))).alias("m"))
    places = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(f).alias("field")) for p, f in asked))
    got = got.select(*KEY, "m", F.explode(places).alias("a"))
    return got.select(*KEY, "a.pos", "a.field", F.try_element_at("m", F.col("a.field")).alias("value"))


def hexists(hash_: DataFrame, asked: DataFrame) -> DataFrame:
    """HEXISTS of (db, key, field) rows: 0 or 1."""
    there = hash_.select(*FIELD).withColumn("there", F.lit(1))
    return asked.join(there, FIELD, "left").select(*FIELD, F.coalesce("there", F.lit(0)).alias("reply"))


def hstrlen(hash_: DataFrame, asked: DataFrame) -> DataFrame:
    """HSTRLEN of (db, key, field) rows: bytes of the value, 0 for a missing field."""
    got = asked.join(hash_.select(*FIELD, "value"), FIELD, "left")
    return got.select(*FIELD, F.coalesce(F.octet_length("value"), F.lit(0)).alias("n"))


def hgetall(hash_: DataFrame) -> DataFrame:
    """HGETALL as one map for each key; HKEYS and HVALS are its keys and values."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return hash_.groupBy(*KEY).agg(F.map_from_entries(entries).alias("entries"))


def hlen(hash_: DataFrame) -> DataFrame:
    """HLEN."""
    return hash_.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def hdel(hash_: DataFrame, fields: DataFrame) -> DataFrame:
    """HDEL, and what HGETDEL leaves, for (db, key, field) rows."""
    return hash_.join(fields.select(*FIELD), FIELD, "left_anti")


def hgetdel(hash_: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HGETDEL of (db, key, field) rows: the values read, null where there is none, and the fields that are left."""
    read = fields.select(*FIELD).join(hash_.select(*FIELD, "value"), FIELD, "left")
    return read, hdel(hash_, fields)


def hgetex(hash_: DataFrame, fields: DataFrame, now_ms, deadline=None, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """HGETEX of (db, key, field) rows: the values read, and the fields with their deadlines afterwards.

    A deadline that is past deletes the fields after the read.
    """
    read = fields.select(*FIELD).join(hash_.select(*FIELD, "value"), FIELD, "left")
    hit = hash_.join(fields.select(*FIELD).distinct().withColumn("asked", F.lit(True)), FIELD, "left")
    mine = F.coalesce("asked", F.lit(False))
    if persist:
        hit = hit.withColumn("field_expire_at", F.when(~mine, F.col("field_expire_at")))
    elif deadline is not None:
        at = F.lit(deadline).cast("bigint")
        hit = hit.where(~(mine & (at <= F.lit(now_ms)))).withColumn("field_expire_at", F.when(mine, at).otherwise(F.col("field_expire_at")))
    return read, hit.drop("asked")


def hincrby(log: DataFrame, by: str = "by") -> DataFrame:
    """HINCRBY: the sum of each field, with an error where it leaves 64 bits."""
    got = log.groupBy(*FIELD).agg(F.sum(F.col(by).cast("decimal(38,0)")).alias("t"))
    fits = F.col("t").between(I64_MIN, I64_MAX)
    return got.select(
        *FIELD, F.when(fits, F.col("t")).cast("bigint").alias("value"),
        F.when(~fits, "ERR increment or decrement would overflow").alias("err"),
    )


def hincrbyfloat(log: DataFrame, by: str = "by") -> DataFrame:
    """HINCRBYFLOAT: the sum of each field, with an error where it isn't finite."""
    got = log.groupBy(*FIELD).agg(F.sum(F.col(by).cast("double")).alias("t"))
    bad = F.isnan("t") | F.abs("t").isin(float("inf"))
    return got.select(*FIELD, F.when(~bad, F.col("t")).alias("value"), F.when(bad, "ERR increment would produce NaN or Infinity").alias("err"))


def hsetex(writes: DataFrame, existing: DataFrame, deadline, when: str | None = None) -> DataFrame:
    """HSETEX: a command's fields are set with a shared deadline if none (``fnx``) or all (``fxx``) exist."""
    if when:
        marked = writes.join(existing.select(*FIELD).withColumn("there", F.lit(True)), FIELD, "left")
        there = F.coalesce("there", F.lit(False))
        ok = marked.groupBy("seq").agg((F.bool_and(~there) if when == "fnx" else F.bool_and(there)).alias("ok"))
        writes = writes.join(ok.where("ok").drop("ok"), "seq", "left_semi")
    new = hset(writes).withColumn("field_expire_at", F.lit(deadline).cast("bigint"))
    return existing.join(new, FIELD, "left_anti").unionByName(new)
