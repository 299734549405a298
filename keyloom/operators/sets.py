"""Sets: rows (db, key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.sources.model import KEY


def sadd(members: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SADD: distinct members."""
    both = members if existing is None else existing.unionByName(members)
    return both.dropDuplicates([*KEY, "member"])


def added(members: DataFrame, existing: DataFrame) -> DataFrame:
    """What SADD replies for each key."""
    new = members.dropDuplicates([*KEY, "member"]).join(existing, [*KEY, "member"], "left_anti")
    return new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("added"))


def srem(sets: DataFrame, members: DataFrame) -> DataFrame:
    """SREM."""
    return sets.join(members.select(*KEY, "member"), [*KEY, "member"], "left_anti")


def scard(sets: DataFrame) -> DataFrame:
    """SCARD."""
    return sets.groupBy(*KEY).agg(F.countDistinct("member").alias("n"))


def smembers(sets: DataFrame) -> DataFrame:
    """SMEMBERS as a sorted array for each key."""
    return sets.groupBy(*KEY).agg(F.array_sort(F.collect_set("member")).alias("members"))


def smismember(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """SISMEMBER and SMISMEMBER: (db, key, pos, member) with 0 or 1."""
    there = sets.select(*KEY, "member").distinct().withColumn("there", F.lit(1))
    got = asked.join(there, [*KEY, "member"], "left")
    return got.select(*KEY, "pos", "member", F.coalesce("there", F.lit(0)).alias("is_member"))


def smove(sets: DataFrame, source: str, target: str, member) -> DataFrame:
    """SMOVE of a member between two sets."""
    moved = (F.col("key") == source) & (F.col("member") == member)
    return sets.withColumn("key", F.when(moved, F.lit(target)).otherwise(F.col("key"))).dropDuplicates([*KEY, "member"])


def _sources(sets: DataFrame, keys: list) -> DataFrame:
    """Members with the places that their key has among the arguments; a key may stand there twice."""
    places = sets.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, ix int")
    return sets.select("key", "member").distinct().join(F.broadcast(places), "key")  # an argument list


def sinter(sets: DataFrame, keys: list) -> DataFrame:
    """SINTER: one shuffle, by member; an empty source leaves nothing."""
    got = _sources(sets, keys).groupBy("member").agg(F.countDistinct("ix").alias("c"))
    return got.where(F.col("c") == len(keys)).select("member")


def sunion(sets: DataFrame, keys: list) -> DataFrame:
    """SUNION."""
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(sets: DataFrame, keys: list) -> DataFrame:
    """SDIFF: the first without the others."""
    got = _sources(sets, keys).groupBy("member").agg(F.max(F.col("ix")).alias("last"), F.min("ix").alias("first"))
    return got.where("first = 0 and last = 0").select("member")


def sintercard(sets: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    """SINTERCARD, capped at ``limit`` unless it is 0."""
    got = sinter(sets, keys)
    return (got.limit(limit) if limit else got).agg(F.count(F.lit(1)).alias("n"))


def store(table: DataFrame, target: str, result: DataFrame, db: int = 0) -> DataFrame:
    """The STORE forms: the result replaces the target; an empty one deletes it."""
    rest = table.where(~((F.col("db") == db) & (F.col("key") == target)))
    return rest.unionByName(result.select(F.lit(db).alias("db"), F.lit(target).alias("key"), *result.columns))
