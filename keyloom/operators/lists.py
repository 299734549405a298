"""Lists, in long form: rows (db, key, pos, value) where only the order of ``pos`` counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import col, resolve_range
from keyloom.plans.ranges import rank_in_keys
from keyloom.sources.model import KEY


def indexed(lst: DataFrame, hot: bool = False) -> DataFrame:
    """Add ``i``, the index from the head, and ``n``, the length.

    A window numbers each list in one task; with ``hot``, lists of any size are numbered over a range
    partitioning instead.
    """
    if hot:
        numbered = rank_in_keys(lst, KEY, ["pos"]).withColumn("i", F.col("rank").cast("int")).drop("rank")
        return numbered.join(llen(lst), KEY)
    of_key = Window.partitionBy(*KEY)
    numbered = lst.withColumn("i", F.row_number().over(of_key.orderBy("pos")) - 1)
    return numbered.withColumn("n", F.count(F.lit(1)).over(of_key))


def push(pushes: DataFrame, left: bool, existing: DataFrame | None = None, only_existing: bool = False) -> DataFrame:
    """LPUSH and RPUSH of (db, key, seq, arg, value); the X forms push only onto lists that exist.

    Left pushes count down from the head that is there, right pushes up from the tail.
    """
    if only_existing:
        pushes = pushes.join(existing.select(*KEY).distinct(), KEY, "left_semi")
    k = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", "arg")).cast("bigint")
    new = pushes.withColumn("k", k)
    if existing is None:
        return new.select(*KEY, (-F.col("k") if left else F.col("k") - 1).alias("pos"), "value")
    edge = existing.groupBy(*KEY).agg((F.min("pos") if left else F.max("pos")).alias("edge"))
    base = F.coalesce("edge", F.lit(0 if left else -1))
    new = new.join(edge, KEY, "left").select(*KEY, (base - F.col("k") if left else base + F.col("k")).alias("pos"), "value")
    return existing.unionByName(new)


def pop(lst: DataFrame, count: int, left: bool, hot: bool = False) -> tuple[DataFrame, DataFrame]:
    """LPOP and RPOP: what is popped, and what is left."""
    at = F.col("i") if left else F.col("n") - 1 - F.col("i")
    marked = indexed(lst, hot).withColumn("taken", at)
    return marked.where(F.col("taken") < count).drop("i", "n"), marked.where(F.col("taken") >= count).drop("i", "n", "taken")


def llen(lst: DataFrame) -> DataFrame:
    """LLEN."""
    return lst.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def lrange(lst: DataFrame, start: int, stop: int, hot: bool = False) -> DataFrame:
    """LRANGE, and what LTRIM keeps."""
    lo, hi = resolve_range(start, stop, "n")
    return indexed(lst, hot).where((F.col("i") >= lo) & (F.col("i") <= hi)).drop("n")


def lindex(lst: DataFrame, i: int, hot: bool = False) -> DataFrame:
    """LINDEX; no row where the index is outside."""
    return indexed(lst, hot).where(F.col("i") == (F.lit(i) if i >= 0 else F.col("n") + i)).select(*KEY, "value")


def lset(lst: DataFrame, i: int, value, hot: bool = False) -> DataFrame:
    """LSET where the index is inside."""
    at = F.col("i") == (F.lit(i) if i >= 0 else F.col("n") + i)
    return indexed(lst, hot).withColumn("value", F.when(at, F.lit(value)).otherwise(F.col("value"))).drop("i", "n")


def linsert(lst: DataFrame, pivot, value, after: bool = False) -> DataFrame:
    """LINSERT at the first pivot: positions double, so a new one fits between."""
    spaced = indexed(lst).withColumn("pos", (F.col("i") * 2).cast("bigint")).drop("i", "n")
    first = spaced.where(F.col("value") == pivot).groupBy(*KEY).agg(F.min("pos").alias("pos"))
    new = first.select(*KEY, (F.col("pos") + (1 if after else -1)).alias("pos"), F.lit(value).alias("value"))
    return spaced.unionByName(new)


def lrem(lst: DataFrame, count: int, value) -> DataFrame:
    """LREM: without the first (count > 0), last (< 0) or all (0) equal elements."""
    same = F.col("value") == value
    if count == 0:
        return lst.where(~same)
    order = F.col("pos").asc() if count > 0 else F.col("pos").desc()
    nth = F.row_number().over(Window.partitionBy(*KEY, "value").orderBy(order))
    return lst.withColumn("nth", nth).where(~same | (F.col("nth") > abs(count))).drop("nth")


def lpos(lst: DataFrame, value, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """LPOS: indices of matches from the ``rank``-th on; one without ``count``, all with 0."""
    scanned = indexed(lst)
    from_end = F.col("n") - 1 - F.col("i")
    if maxlen:
        scanned = scanned.where((F.col("i") if rank > 0 else from_end) < maxlen)
    hits = scanned.where(F.col("value") == value)
    order = F.col("i").asc() if rank > 0 else F.col("i").desc()
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    hits = hits.withColumn("nth", nth - (abs(rank) - 1)).where(F.col("nth") >= 1)
    most = 1 if count is None else count
    hits = hits.where(F.col("nth") <= most) if most else hits
    return hits.select(*KEY, "nth", F.col("i").cast("bigint").alias("i"))


def lmove(lst: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """LMOVE and RPOPLPUSH between two keys; with one key it rotates."""
    own = lst.where(F.col("key") == source)
    taken, _ = pop(own, 1, from_left)
    rest = lst.join(taken.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    moved = taken.select("db", F.lit(target).alias("key"), F.lit(0).alias("seq"), F.lit(0).alias("arg"), "value")
    return push(moved, to_left, rest)


def first_nonempty(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """LMPOP and ZMPOP: rows of the first key in argument order that has any."""
    there = asked.join(rows.select(*KEY).distinct(), KEY, "left_semi")
    first = there.groupBy("db").agg(F.min_by("key", "pos").alias("key"))
    return rows.join(F.broadcast(first), KEY)  # one row for each database


def compact(lst: DataFrame, value=None) -> DataFrame:
    """Positions counted anew from 0."""
    return indexed(lst).select(*KEY, F.col("i").cast("bigint").alias("pos"), col(value or "value").alias("value"))
