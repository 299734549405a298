"""Bitmaps in sparse form: rows (db, key, bit) for the bits that are 1; bit 0 is the first byte's highest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import col, resolve_range
from keyloom.sources.model import KEY


def setbit(writes: DataFrame, order: str = "seq") -> DataFrame:
    """SETBIT: bits whose last write is 1, of (db, key, bit, on, seq)."""
    last = writes.groupBy(*KEY, "bit").agg(F.max_by("on", order).alias("on"))
    return last.where(F.col("on") == 1).drop("on")


def getbit(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """GETBIT of (db, key, bit) rows: 0 past the end."""
    got = asked.join(bits.select(*KEY, "bit").distinct().withColumn("on", F.lit(1)), [*KEY, "bit"], "left")
    return got.withColumn("on", F.coalesce("on", F.lit(0)))


def byte_length(bits: DataFrame) -> DataFrame:
    """Bytes of each bitmap, as far as its last 1."""
    return bits.groupBy(*KEY).agg((F.floor(F.max("bit") / 8) + 1).cast("bigint").alias("bytes"))


def bitcount(bits: DataFrame, start: int | None = None, stop: int = -1, unit: str = "byte") -> DataFrame:
    """BITCOUNT, over a signed inclusive range of bytes or bits."""
    bits = bits.select(*KEY, "bit").distinct()
    if start is not None:
        width = 8 if unit == "byte" else 1
        sized = bits.join(byte_length(bits), KEY)
        lo, hi = resolve_range(start, stop, F.col("bytes") * (8 // width))
        at = F.floor(F.col("bit") / width)
        bits = sized.where((at >= lo) & (at <= hi))
    return bits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def bitpos(bits: DataFrame, value: int) -> DataFrame:
    """BITPOS: the first 1, or the first 0, which may be the bit past the end."""
    bits = bits.select(*KEY, "bit").distinct()
    if value:
        return bits.groupBy(*KEY).agg(F.min("bit").alias("pos"))
    run = F.row_number().over(Window.partitionBy(*KEY).orderBy("bit")) - 1
    # bits that are still in step with their number form the first run of ones
    marked = bits.withColumn("in_step", F.col("bit") == run)
    return marked.groupBy(*KEY).agg(F.count_if("in_step").alias("pos"))


def bitop(bits: DataFrame, op: str, keys: list, length: int | None = None) -> DataFrame:
    """BITOP: AND, OR, XOR, NOT, DIFF, DIFF1, ANDOR and ONE over source keys, as the bits of the result.

    A key given twice counts as two sources.  NOT complements the whole bytes of its one source.
    """
    op = op.upper()
    if op == "NOT":
        own = bits.where(F.col("key") == keys[0]).select("bit").distinct()
        end = own.agg(F.coalesce((F.floor(F.max("bit") / 8) + 1) * 8, F.lit(0)).alias("n")) if length is None else None
        every = (
            own.sparkSession.range(8 * length).withColumnRenamed("id", "bit")
            if length is not None
            else end.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("bit"))
        )
        return every.join(own, "bit", "left_anti")
    places = bits.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, ix int")
    rows = bits.select("key", "bit").distinct().join(F.broadcast(places), "key")  # an argument list
    got = rows.groupBy("bit").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("ix") == 0).cast("int")).alias("f"))
    n, f = F.col("n"), F.col("f")
    keep = {
        "AND": n == len(keys), "OR": n >= 1, "XOR": n % 2 == 1, "ONE": n == 1, "DIFF": (f == 1) & (n == 1),
        "DIFF1": f == 0, "ANDOR": (f == 1) & (n > 1),
    }[op]
    return got.where(keep).select("bit")


def field_limits(width: int, signed: bool) -> tuple[int, int]:
    """Smallest and largest value of a BITFIELD type."""
    if not (1 <= width <= (64 if signed else 63)):
        raise ValueError("Invalid bitfield type. Use something like i16 u8.")
    return (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)


def bitfield_incr(value, by, width: int, signed: bool = True, overflow: str = "WRAP") -> Column:
    """BITFIELD INCRBY: the new value under WRAP, SAT or FAIL (null)."""
    low, high = field_limits(width, signed)
    wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    total = col(value).cast("decimal(38,0)") + col(by).cast("decimal(38,0)")
    inside = (total >= wide(low)) & (total <= wide(high))
    if overflow == "FAIL":
        out = F.when(inside, total)
    elif overflow == "SAT":
        out = F.least(F.greatest(total, wide(low)), wide(high))
    else:
        out = F.when(inside, total).otherwise(F.pmod(total - wide(low), wide(high - low + 1)) + wide(low))
    return out.cast("bigint")


def bitfield_get(bits: DataFrame, width: int, offset: int, signed: bool = True) -> DataFrame:
    """BITFIELD GET of a field at a bit offset, for every key."""
    power = F.expr(f"shiftleft(1L, cast({offset + width - 1} - bit as int))")
    own = (F.col("bit") >= offset) & (F.col("bit") < offset + width)
    got = bits.select(*KEY, "bit").distinct().groupBy(*KEY).agg(F.coalesce(F.sum(F.when(own, power)), F.lit(0)).alias("u"))
    if signed and width < 64:
        return got.select(*KEY, F.when(F.col("u") >= (1 << (width - 1)), F.col("u") - (1 << width)).otherwise(F.col("u")).alias("value"))
    return got.select(*KEY, F.col("u").alias("value"))


def bitfield_set(bits: DataFrame, width: int, offset: int, value: int) -> DataFrame:
    """BITFIELD SET of a field, for every key: its bits are replaced."""
    rest = bits.where((F.col("bit") < offset) | (F.col("bit") >= offset + width))
    on = [offset + i for i in range(width) if value >> (width - 1 - i) & 1]
    if not on:
        return rest
    new = bits.select(*KEY).distinct().withColumn("bit", F.explode(F.array(*(F.lit(b).cast("bigint") for b in on))))
    return rest.unionByName(new)
