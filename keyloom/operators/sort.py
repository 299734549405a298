"""SORT: members by weights that other keys hold, with values fetched from other keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import parse_score


def _fetched(rows: DataFrame, pattern: str, strings: DataFrame, hashes: DataFrame | None, name: str) -> DataFrame:
    """Add ``name``: what the key made from a member by ``pattern`` holds; ``#`` is the member itself."""
    if pattern == "#":
        return rows.withColumn(name, F.col("member").cast("string"))
    key, _, field = pattern.partition("->")
    if "*" not in key:
        return rows.withColumn(name, F.lit(None).cast("string"))
    head, _, tail = key.partition("*")
    made = F.concat(F.lit(head), F.col("member").cast("string"), F.lit(tail))
    other = hashes.where(F.col("field") == field) if field else strings
    other = other.select(F.col("key").alias("__k"), F.col("value").cast("string").alias(name))
    return rows.withColumn("__made", made).join(other, F.col("__made") == F.col("__k"), "left").drop("__made", "__k")


def sort(
    members: DataFrame,
    strings: DataFrame | None = None,
    hashes: DataFrame | None = None,
    by: str | None = None,
    get: tuple[str, ...] = (),
    alpha: bool = False,
    reverse: bool = False,
    offset: int = 0,
    count: int | None = None,
) -> DataFrame:
    """Rows (ord, member) of one key in sorted order, with ``get_0``... for the GET patterns.

    Weights that are missing count as 0; a weight that isn't a number makes ``err`` say so.  Ties keep
    ``ord``, then the member.  A pattern without ``*`` doesn't sort.  LIMIT applies after the sort.
    """
    rows = members.select("ord", "member")
    if by is not None and "*" not in by:
        rows = rows.withColumns({"err": F.lit(None).cast("string"), "__by": F.col("ord")})
        reverse, ties = False, []
    else:
        rows = _fetched(rows, by or "#", strings, hashes, "weight")
        if alpha:
            key = F.coalesce("weight", F.lit(""))
            rows = rows.withColumn("err", F.lit(None).cast("string"))
        else:
            number = parse_score("weight")
            wrong = F.col("weight").isNotNull() & number.isNull()
            rows = rows.withColumn("err", F.when(wrong, "ERR One or more scores can't be converted into double"))
            key = F.coalesce(number, F.lit(0.0))
        rows, ties = rows.withColumn("__by", key), ["ord", "member"]
    order = [F.col("__by").desc() if reverse else F.col("__by").asc(), *ties]
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    if count is not None:
        rows = rows.limit(count)
    for i, pattern in enumerate(get):
        rows = _fetched(rows, pattern, strings, hashes, f"get_{i}")
    return (rows.orderBy(*order) if get else rows).drop("__by")  # lookups don't keep an order
