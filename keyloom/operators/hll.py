"""HyperLogLog with 16384 registers: rows (db, key, idx, rho), and the library sketch for plain counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.exprs import murmur64
from keyloom.sources.model import KEY
from keyloom.sources.shipping import ship

BITS = 14
REGISTERS = 1 << BITS
TOP = 64 - BITS + 1


def register_of(data: bytes) -> tuple[int, int]:
    """Register and rank of an element: low bits choose, the run of zeros above ranks."""
    h = murmur64(data)
    rest = (h >> BITS) | (1 << (64 - BITS))
    return h & (REGISTERS - 1), (rest & -rest).bit_length()


def pfadd(elements: DataFrame, column: str = "element", existing: DataFrame | None = None) -> DataFrame:
    """PFADD: registers of each key.  Elements are made distinct first, so Python sees each once."""
    ship(elements.sparkSession)
    out = T.StructType.fromDDL("idx int, rho int")

    @F.pandas_udf(out)
    def registers(x: pd.Series) -> pd.DataFrame:
        got = [register_of(v if isinstance(v, bytes) else str(v).encode()) for v in x]
        return pd.DataFrame(got, columns=["idx", "rho"], dtype=np.int32)

    rows = elements.select(*KEY, column).where(F.col(column).isNotNull()).distinct().withColumn("r", registers(column))
    rows = rows.select(*KEY, "r.idx", "r.rho")
    return merge(rows if existing is None else existing.select(*KEY, "idx", "rho").unionByName(rows))


def merge(registers: DataFrame, target: str | None = None) -> DataFrame:
    """PFMERGE: the largest rank of each register; with ``target``, of all keys together."""
    if target is not None:
        registers = registers.withColumn("key", F.lit(target))
    return registers.groupBy(*KEY, "idx").agg(F.max("rho").alias("rho"))


def dense_registers(registers: DataFrame) -> DataFrame:
    """PFDEBUG GETREG: all registers of each key, zeros included, in order."""
    got = registers.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("idx", "rho"))).alias("m"))
    every = F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1)))
    return got.select(*KEY, "m", every.alias("idx")).select(*KEY, "idx", F.coalesce(F.try_element_at("m", F.col("idx")), F.lit(0)).alias("rho"))


def pfcount(registers: DataFrame) -> DataFrame:
    """PFCOUNT: the improved raw estimate (Ertl 2017) from the histogram of ranks."""
    ship(registers.sparkSession)
    histogram = registers.groupBy(*KEY, "rho").agg(F.count(F.lit(1)).alias("c")).groupBy(*KEY)
    got = histogram.agg(F.map_from_entries(F.collect_list(F.struct("rho", "c"))).alias("h"))

    @F.pandas_udf("bigint")
    def estimate(h: pd.Series) -> pd.Series:
        return pd.Series([round(ertl(dict(x))) for x in h], dtype="int64")

    return got.select(*KEY, estimate("h").alias("n"))


def ertl(counts: dict[int, int]) -> float:
    """Estimate of the number of elements from the number of registers of each rank."""
    counts = counts | {0: REGISTERS - sum(c for r, c in counts.items() if r)}
    share = counts[0] / REGISTERS
    if share == 1:
        return 0.0
    # tau of the saturated registers, then from the top rank down, then sigma of the empty ones
    x = 1 - counts.get(TOP, 0) / REGISTERS
    z, y = 0.0, 1.0
    if 0 < x < 1:
        z, before = 1 - x, None
        while z != before:
            x, before, y = x**0.5, z, y / 2
            z -= (1 - x) ** 2 * y
        z /= 3
    z *= REGISTERS
    for r in range(TOP - 1, 0, -1):
        z = 0.5 * (z + counts.get(r, 0))
    total, y, before, x = share, 1.0, None, share
    while total != before:
        x, before = x * x, total
        total += x * y
        y += y
    return REGISTERS**2 / (2 * np.log(2) * (z + REGISTERS * total))


def library_sketch(elements: DataFrame, column: str = "element") -> DataFrame:
    """Sketches in the JVM, for counts that needn't agree register by register."""
    return elements.groupBy(*KEY).agg(F.hll_sketch_agg(column, BITS).alias("sketch"))


def library_count(sketches: DataFrame) -> DataFrame:
    """Estimate of the union of library sketches by key."""
    return sketches.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
