"""Strings and numerics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import I64_MAX, I64_MIN, canonical_int, col, parse_score, string_range
from keyloom.plans.ranges import total_order
from keyloom.sources.model import KEY


def mget(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """Values in argument order, null for what is missing; GET is a list of one."""
    return asked.join(strings, KEY, "left").select("pos", "key", "value").orderBy("pos")


def strlen(value) -> Column:
    """Bytes of a value; 0 without one."""
    return F.coalesce(F.octet_length(col(value)), F.lit(0))


def getrange(value, start: int, stop: int) -> Column:
    """Bytes of an inclusive signed range; SUBSTR is the same."""
    value = F.coalesce(col(value).cast("binary"), F.lit(b""))
    lo, hi = string_range(start, stop, F.octet_length(value))
    return F.substring(value, lo + 1, F.greatest(hi - lo + 1, F.lit(0))).cast("binary")


def setrange(value, offset: int, patch: str | bytes) -> Column:
    """Bytes overwritten from an offset, with zeros in a gap; an empty patch changes nothing."""
    patch = patch.encode() if isinstance(patch, str) else patch
    old = F.coalesce(col(value).cast("binary"), F.lit(b""))
    if not patch:
        return old
    n = F.octet_length(old)
    pad = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - n, F.lit(0))))
    head = F.concat(F.substring(old, 1, offset), pad) if offset else F.lit(b"")
    return F.concat(head, F.lit(patch), F.substring(old, F.lit(offset + len(patch) + 1), F.lit(2**31 - 1)))


def last_write(writes: DataFrame, value: str = "value", order=("seq",)) -> DataFrame:
    """SET, MSET and SETEX: the last write of each key wins, deadline included."""
    cols = [c for c in (value, "expire_at") if c in writes.columns]
    got = writes.groupBy(*KEY).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("w"))
    return got.select(*KEY, *(F.col(f"w.{c}").alias(c) for c in cols))


def first_write(writes: DataFrame, value: str = "value", order=("seq",), existing: DataFrame | None = None) -> DataFrame:
    """SETNX: the first write of a key that wasn't there."""
    if existing is not None:
        writes = writes.join(existing.select(*KEY), KEY, "left_anti")
    return writes.groupBy(*KEY).agg(F.min_by(value, F.struct(*order)).alias(value))


def previous(writes: DataFrame, value: str = "value", order: str = "seq", hot: bool = False) -> DataFrame:
    """GETSET: each write with the value it replaced.

    With ``hot``, a key may hold most writes: they are numbered over a range partitioning and joined with the
    one before.
    """
    if not hot:
        return writes.withColumn("old_value", F.lag(value).over(Window.partitionBy(*KEY).orderBy(order)))
    placed = total_order(writes, [*KEY, order]).drop("upto")
    before = placed.select(*KEY, (F.col("ix") + 1).alias("ix"), F.col(value).alias("old_value"))
    return placed.join(before, [*KEY, "ix"], "left").drop("ix")


def all_or_nothing(commands: DataFrame, existing: DataFrame, when: str = "nx") -> DataFrame:
    """MSETNX and MSETEX: (seq, db, key, value) grouped by ``seq``; a command is kept only if none (``nx``)
    or all (``xx``) of its keys exist.  Adds ``applied``."""
    marked = commands.join(existing.select(*KEY).distinct().withColumn("there", F.lit(True)), KEY, "left")
    there = F.coalesce("there", F.lit(False))
    gate = F.bool_and(~there) if when == "nx" else F.bool_and(there)
    return commands.join(marked.groupBy("seq").agg(gate.alias("applied")), "seq")


def append(writes: DataFrame, value: str = "value", order: str = "seq") -> DataFrame:
    """APPEND: the parts of each key in order, one after the other, and the length that is reached."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    got = writes.groupBy(*KEY).agg(parts.alias("p"))
    whole = F.aggregate("p", F.lit("").cast(writes.schema[value].dataType), lambda a, x: F.concat(a, x[value]))
    return got.select(*KEY, whole.alias("value")).withColumn("length", F.octet_length("value"))


def incr_total(log: DataFrame, by="by") -> DataFrame:
    """INCRBY and DECRBY: the sum of each key, with an error where it leaves 64 bits."""
    total = F.sum(col(by).cast("decimal(38,0)"))
    got = log.groupBy(*KEY).agg(total.alias("t"))
    fits = F.col("t").between(I64_MIN, I64_MAX)
    return got.select(
        *KEY, F.when(fits, F.col("t")).cast("bigint").alias("value"),
        F.when(~fits, "ERR increment or decrement would overflow").alias("err"),
    )


def incr_running(log: DataFrame, by="by", order: str = "seq", hot: bool = False) -> DataFrame:
    """INCRBY: the reply to each command of the log.

    With ``hot``, a key may hold most commands: sums run over a range partitioning, less what is before the key.
    """
    if hot:
        placed = total_order(log.withColumn("__by", col(by)), [*KEY, order], "__by")
        start = placed.groupBy(*KEY).agg(F.min_by(F.col("upto") - F.col("__by"), "ix").alias("__start"))
        got = placed.join(start, KEY).withColumn("value", F.col("upto") - F.col("__start"))
        return got.drop("__by", "__start", "upto", "ix")
    w = Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("value", F.sum(col(by)).over(w))


def incr_float(log: DataFrame, by="by") -> DataFrame:
    """INCRBYFLOAT: the sum of each key; an error where it isn't finite."""
    got = log.groupBy(*KEY).agg(F.sum(col(by).cast("double")).alias("t"))
    bad = F.isnan("t") | F.abs("t").isin(float("inf"))
    return got.select(*KEY, F.when(~bad, F.col("t")).alias("value"), F.when(bad, "ERR increment would produce NaN or Infinity").alias("err"))


def integer_or_error(value) -> tuple[Column, Column]:
    """A stored string as the integer that INCR sees, and the error if it isn't one."""
    n = canonical_int(value)
    return n, F.when(n.isNull() & col(value).isNotNull(), "ERR value is not an integer or out of range")


def float_or_error(value) -> tuple[Column, Column]:
    """A stored string as the number that INCRBYFLOAT sees, and the error if it isn't one."""
    x = parse_score(value)
    return x, F.when(x.isNull() & col(value).isNotNull(), "ERR value is not a valid float")


def delete_if_equal(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """DELIFEQ: strings without those whose value is the one that was asked for."""
    return strings.join(asked.select(*KEY, "value"), [*KEY, "value"], "left_anti")


def getdel(strings: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETDEL: the values read, and the strings that are left."""
    return mget(strings, asked), strings.join(asked.select(*KEY), KEY, "left_anti")


def getex(strings: DataFrame, asked: DataFrame, now_ms, deadline=None, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """GETEX: the values read, and the strings with their deadlines afterwards.

    ``deadline`` is absolute; one that is past deletes the key after the read.  Without ``deadline`` and
    ``persist`` nothing changes.
    """
    read = mget(strings.select(*KEY, "value"), asked)
    hit = strings.join(asked.select(*KEY).distinct().withColumn("asked", F.lit(True)), KEY, "left")
    mine = F.coalesce("asked", F.lit(False))
    if persist:
        hit = hit.withColumn("expire_at", F.when(~mine, F.col("expire_at")))
    elif deadline is not None:
        at = F.lit(deadline).cast("bigint")
        hit = hit.where(~(mine & (at <= col(now_ms)))).withColumn("expire_at", F.when(mine, at).otherwise(F.col("expire_at")))
    return read, hit.drop("asked")


def conditional_set(existing: DataFrame, writes: DataFrame, when: str = "always", keepttl: bool = False) -> DataFrame:
    """SET with NX, XX, IFEQ, IFNE, GET and KEEPTTL, one command for each key.

    ``existing`` and ``writes`` are (db, key, value, expire_at); ``writes`` has ``expected`` for IFEQ and IFNE.
    Returns for each command ``applied``, ``old_value`` (what GET replies) and the ``value`` and ``expire_at``
    after it.  IFEQ needs a value that is equal, IFNE one that differs or none.
    """
    now = existing.select(*KEY, F.col("value").alias("old_value"), F.col("expire_at").alias("old_expire_at"), F.lit(True).alias("there"))
    both = writes.join(now, KEY, "left")
    there = F.coalesce("there", F.lit(False))
    same = F.col("old_value").eqNullSafe(F.col("expected")) if "expected" in writes.columns else F.lit(False)
    ok = {"always": F.lit(True), "nx": ~there, "xx": there, "ifeq": there & same, "ifne": ~there | ~same}[when]
    deadline = F.col("old_expire_at") if keepttl else F.col("expire_at")
    return both.select(
        *KEY, ok.alias("applied"), "old_value", F.when(ok, F.col("value")).otherwise(F.col("old_value")).alias("value"),
        F.when(ok, deadline).otherwise(F.col("old_expire_at")).alias("expire_at"),
    )


def msetex(existing: DataFrame, commands: DataFrame, when: str | None = None, keepttl: bool = False) -> DataFrame:
    """MSETEX: the strings after commands of several keys (seq, db, key, value, expire_at), all of them or none.

    A command's gate (``nx``: none of its keys exist, ``xx``: all do) is judged on ``existing``; of commands
    that set the same key the last counts.
    """
    if when:
        commands = all_or_nothing(commands, existing, when).where("applied").drop("applied")
    new = last_write(commands)
    if keepttl:
        kept = existing.select(*KEY, F.col("expire_at").alias("old"))
        new = new.join(kept, KEY, "left").withColumn("expire_at", F.col("old")).drop("old")
    return existing.join(new.select(*KEY), KEY, "left_anti").select(*KEY, "value", "expire_at").unionByName(new.select(*KEY, "value", "expire_at"))
