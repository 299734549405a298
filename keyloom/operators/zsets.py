"""Sorted sets: rows (db, key, member, score), ordered by score and then by the bytes of the member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import lex_within, resolve_range, score_within
from keyloom.plans.ranges import rank_in_keys
from keyloom.sources.model import KEY

MEMBER = [*KEY, "member"]


def zadd(writes: DataFrame, mode: str = "last", existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """ZADD folds of a log: ``last``, ``nx`` (first), ``gt``, ``lt`` and ``incr``; NaN scores are left out.

    ``gt`` and ``lt`` still insert members that are missing, so they are the largest and smallest score.
    """
    fold = {
        "last": F.max_by("score", order), "nx": F.min_by("score", order), "gt": F.max("score"),
        "lt": F.min("score"), "incr": F.sum("score"),
    }[mode]
    good = writes.where(~F.isnan("score")).select(*MEMBER, "score", order)
    if existing is not None:
        good = existing.select(*MEMBER, "score", F.lit(-1).cast(writes.schema[order].dataType).alias(order)).unionByName(good)
    return good.groupBy(*MEMBER).agg(fold.alias("score"))


def zadd_changes(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """What ZADD CH replies: members added or with another score, by key."""
    new = zadd(writes).withColumnRenamed("score", "new_score")
    both = new.join(existing, MEMBER, "left")
    changed = F.col("score").isNull() | (F.col("score") != F.col("new_score"))
    return both.groupBy(*KEY).agg(F.count_if(F.col("score").isNull()).alias("added"), F.count_if(changed).alias("changed"))


def ranked(zset: DataFrame, reverse: bool = False, hot: bool = False) -> DataFrame:
    """Add ``rank`` from 0, ascending or descending in both score and member.

    A window ranks each key in one task, and Spark limits it early for the first ranks; with ``hot``, keys
    of any size are ranked over a range partitioning instead.
    """
    if hot:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("score", "member")]
        return rank_in_keys(zset, KEY, order)
    way = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    return zset.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(way("score"), way("member"))) - 1)


def zrank(zset: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """ZRANK and ZREVRANK WITHSCORE of (db, key, member) rows.

    Ranks of a few members need no sort: the rows of their keys before each of them are counted.
    """
    wanted = asked.select(*MEMBER).distinct().join(zset, MEMBER).select(*KEY, F.struct("score", "member").alias("w"))
    places = wanted.groupBy(*KEY).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    own = F.struct("score", "member")
    hits = F.filter("ws", lambda w: (own > w) if reverse else (own < w))
    before = zset.join(places, KEY).select(*KEY, F.explode(hits).alias("w")).groupBy(*KEY, "w").agg(F.count(F.lit(1)).alias("rank"))
    got = wanted.join(before, [*KEY, "w"], "left")
    return got.select(*KEY, F.col("w.member").alias("member"), F.col("w.score").alias("score"), F.coalesce("rank", F.lit(0)).alias("rank"))


def zmscore(zset: DataFrame, asked: DataFrame) -> DataFrame:
    """ZSCORE and ZMSCORE in argument order, null for what is missing."""
    return asked.join(zset, MEMBER, "left").select(*KEY, "pos", "member", "score")


def zcard(zset: DataFrame) -> DataFrame:
    """ZCARD."""
    return zset.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def zrange(zset: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE and ZREVRANGE by rank.

    A range from the front keeps the ranking filter plain, so that Spark limits every group before it
    sorts; others need the size of each key.
    """
    got = ranked(zset, reverse)
    if start >= 0 and stop >= 0:
        return got.where((F.col("rank") >= start) & (F.col("rank") <= stop))
    got = got.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    lo, hi = resolve_range(start, stop, "n")
    return got.where((F.col("rank") >= lo) & (F.col("rank") <= hi)).drop("n")


def _limited(rows: DataFrame, reverse: bool, offset: int, count: int | None) -> DataFrame:
    got = ranked(rows, reverse)
    got = got.where(F.col("rank") >= offset)
    return got if count is None or count < 0 else got.where(F.col("rank") < offset + count)


def zrangebyscore(zset, low, high, reverse=False, offset=0, count=None) -> DataFrame:
    """ZRANGEBYSCORE and ZREVRANGEBYSCORE (bounds as low, high), with LIMIT."""
    return _limited(zset.where(score_within("score", low, high)), reverse, offset, count)


def zrangebylex(zset, low, high, reverse=False, offset=0, count=None) -> DataFrame:
    """ZRANGEBYLEX and ZREVRANGEBYLEX (bounds as low, high), with LIMIT."""
    return _limited(zset.where(lex_within("member", low, high)), reverse, offset, count)


def zcount(zset: DataFrame, low, high) -> DataFrame:
    """ZCOUNT."""
    return zset.where(score_within("score", low, high)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def zlexcount(zset: DataFrame, low: str, high: str) -> DataFrame:
    """ZLEXCOUNT."""
    return zset.where(lex_within("member", low, high)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def zrem(zset: DataFrame, members: DataFrame) -> DataFrame:
    """ZREM."""
    return zset.join(members.select(*MEMBER), MEMBER, "left_anti")


def zremrangebyrank(zset: DataFrame, start: int, stop: int) -> DataFrame:
    """ZREMRANGEBYRANK: what is left."""
    return zset.join(zrange(zset, start, stop).select(*MEMBER), MEMBER, "left_anti")


def zremrangebyscore(zset: DataFrame, low, high) -> DataFrame:
    """ZREMRANGEBYSCORE: what is left."""
    return zset.where(~score_within("score", low, high))


def zremrangebylex(zset: DataFrame, low: str, high: str) -> DataFrame:
    """ZREMRANGEBYLEX: what is left."""
    return zset.where(~lex_within("member", low, high))


def zpop(zset: DataFrame, count: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN and ZPOPMAX: what is popped, and what is left."""
    got = ranked(zset, largest)
    return got.where(F.col("rank") < count), got.where(F.col("rank") >= count).drop("rank")


def combine(zset: DataFrame, keys: list, how: str = "union", weights: list | None = None, aggregate: str = "sum", plain: DataFrame | None = None) -> DataFrame:
    """ZUNION, ZINTER and ZDIFF with WEIGHTS and AGGREGATE, as (member, score).

    ``plain`` are sets, whose members count with score 1.  A key given twice is two sources; a product or
    sum that isn't a number is 0.
    """
    weights = weights or [1.0] * len(keys)
    places = zset.sparkSession.createDataFrame(
        [(k, i, float(w)) for i, (k, w) in enumerate(zip(keys, weights, strict=True))], "key string, ix int, w double"
    )
    rows = zset.select("key", "member", "score")
    if plain is not None:
        rows = rows.unionByName(plain.select("key", "member", F.lit(1.0).alias("score")))
    number = lambda c: F.when(F.isnan(c), F.lit(0.0)).otherwise(c)
    rows = rows.join(F.broadcast(places), "key").withColumn("score", number(F.col("score") * F.col("w")))  # an argument list
    if how == "diff":
        got = rows.groupBy("member").agg(F.max("ix").alias("last"), F.min("ix").alias("first"), F.max("score").alias("score"))
        return got.where("first = 0 and last = 0").select("member", "score")
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]("score")
    got = rows.groupBy("member").agg(number(fold).alias("score"), F.count(F.lit(1)).alias("c"))
    return (got.where(F.col("c") == len(keys)) if how == "inter" else got).select("member", "score")


def zintercard(zset: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    """ZINTERCARD, capped at ``limit`` unless it is 0."""
    got = combine(zset, keys, "inter")
    return (got.limit(limit) if limit else got).agg(F.count(F.lit(1)).alias("n"))
