"""Deadlines of keys and of hash fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import col


def gate(current, new, nx=False, xx=False, gt=False, lt=False) -> Column:
    """Whether NX, XX, GT and LT let a new deadline through; without one a key lasts forever."""
    current, new = col(current), col(new)
    ok = F.lit(True)
    if nx:
        ok = ok & current.isNull()
    if xx:
        ok = ok & current.isNotNull()
    if gt:
        ok = ok & current.isNotNull() & (new > current)
    if lt:
        ok = ok & (current.isNull() | (new < current))
    return ok


def expire(keys: DataFrame, new, now_ms, column: str = "expire_at", **flags) -> DataFrame:
    """EXPIRE, PEXPIRE, EXPIREAT, PEXPIREAT (and their field forms) to the absolute deadline ``new`` in ms.

    Adds ``reply``: 0 where the gate held it back, 1 where it was set, 2 where the deadline is past; those
    rows are ``deleted`` (EXPIRE then replies 1, the field forms 2).
    """
    go = gate(column, new, **flags)
    past = go & (col(new) <= col(now_ms))
    return keys.withColumns(
        {
            "reply": F.when(~go, 0).when(past, 2).otherwise(1),
            "deleted": past,
            column: F.when(go, col(new)).otherwise(F.col(column)),
        }
    )


def ttl(deadline, now_ms, there=True) -> Column:
    """TTL: seconds left, rounded; -1 without deadline, -2 without key."""
    left = F.floor((col(deadline) - col(now_ms) + 500) / 1000).cast("bigint")
    return F.when(~col(there), -2).when(col(deadline).isNull(), -1).otherwise(left)


def pttl(deadline, now_ms, there=True) -> Column:
    """PTTL: milliseconds left."""
    return F.when(~col(there), -2).when(col(deadline).isNull(), -1).otherwise(col(deadline) - col(now_ms))


def expiretime(deadline, there=True) -> Column:
    """EXPIRETIME: absolute seconds, rounded."""
    return F.when(~col(there), -2).when(col(deadline).isNull(), -1).otherwise(F.floor((col(deadline) + 500) / 1000).cast("bigint"))


def pexpiretime(deadline, there=True) -> Column:
    """PEXPIRETIME: absolute milliseconds."""
    return F.when(~col(there), -2).otherwise(F.coalesce(col(deadline), F.lit(-1)))


def persist(keys: DataFrame, column: str = "expire_at") -> DataFrame:
    """PERSIST and HPERSIST: 1 where a deadline went, else 0 (-1 in the field form)."""
    return keys.withColumn("reply", F.col(column).isNotNull().cast("int")).withColumn(column, F.lit(None).cast("bigint"))


def due(keys: DataFrame, now_ms, limit: int | None = None) -> DataFrame:
    """Active expiry: keys past their deadline, earliest first, at most ``limit`` in a cycle."""
    gone = keys.where(F.col("expire_at") < col(now_ms)).orderBy("expire_at", "key")
    return gone if limit is None else gone.limit(limit)
