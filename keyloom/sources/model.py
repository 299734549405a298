"""Schemas of the keyspace tables, and loaders that shape any DataFrame into one of them.

One long-form table for each data type; ``keys`` says of every key which type it has and when it expires.
Keys, members and values are STRING or BINARY; both compare by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.exprs import col

SCHEMAS = {
    "keys": "db int, key binary, type string, expire_at bigint, version bigint",
    "str": "db int, key binary, value binary",
    "hash": "db int, key binary, field binary, value binary, field_expire_at bigint",
    "lst": "db int, key binary, pos bigint, value binary",
    "sets": "db int, key binary, member binary",
    "zset": "db int, key binary, member binary, score double",
    "bits": "db int, key binary, bit bigint",
    "hll": "db int, key binary, idx int, rho int",
    "ops": "seq bigint, ts timestamp, conn bigint, txn bigint, db int, cmd string, args array<binary>, usec bigint, err string",
}
KEY = ["db", "key"]


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table of the model without rows."""
    return spark.createDataFrame([], SCHEMAS[table])


def shaped(df: DataFrame, db: int = 0, **columns) -> DataFrame:
    """Rows of a table from any DataFrame: each column by name or expression."""
    return df.select(F.lit(db).alias("db"), *(col(c).alias(n) for n, c in columns.items()))


def is_live(now_ms, deadline="expire_at") -> Column:
    """A key is still there when its deadline is now, and gone after it."""
    d = col(deadline)
    return d.isNull() | (d >= col(now_ms))


def live(keys: DataFrame, now_ms) -> DataFrame:
    """Keys that haven't expired."""
    return keys.where(is_live(now_ms))


def of_type(keys: DataFrame, kind: str) -> DataFrame:
    """Keys of one type."""
    return keys.where(F.col("type") == kind)


def wrong_type(keys: DataFrame, kind: str) -> Column:
    """Error text for keys that hold another type; errors are values and never stop a plan."""
    message = "WRONGTYPE Operation against a key holding the wrong kind of value"
    return F.when(F.col("type").isNotNull() & (F.col("type") != kind), message)


def probe(spark: SparkSession, keys: list, db: int = 0) -> DataFrame:
    """An argument list as rows (db, pos, key)."""
    return spark.createDataFrame([(db, i, k) for i, k in enumerate(keys)], "db int, pos int, key string")
