"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form an indivisible group.  Large groups and bundles of small ones are the
atoms; their number is bounded.  Differencing starts with one partial partition for each atom and
repeatedly combines the two of largest spread, the heaviest part of the one with the lightest of the
other, until one partition is left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Bundles of small groups; also bounds the number of large groups (total / BUNDLES bytes and up).
BUNDLES = 4096


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each atom by k-way Karmarkar-Karp differencing; ties go by position."""
    if not sizes:
        return []
    # a partial partition: parts in falling order of size, each (size, atoms as a linked pair tree)
    heap = []
    for i, s in enumerate(sizes):
        parts = [(s, (i,))] + [(0, ())] * (shards - 1)
        heap.append((-s, i, parts))
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = [(x + y, (s, t)) for (x, s), (y, t) in zip(a, reversed(b), strict=True)]
        parts.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], mark, parts))
        mark += 1
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            for x in stack.pop():
                if isinstance(x, tuple):
                    stack.append(x)
                else:
                    out[x] = shard
    return out


def balance(docs: DataFrame, shards: int = 16, text_col: str = "text") -> DataFrame:
    """Put documents into shards of nearly equal bytes; equal texts stay together.

    Returns ``doc_id``, ``size`` (UTF-8 bytes plus one), ``text_crc32``, ``shard`` and ``slot``
    (gapless from 0 in each shard, by ``doc_id``).  Null counts as the empty text; repeated rows each get
    a slot; an empty table gives no rows; other columns are ignored.  A group larger than a shard's share
    has a shard nearly to itself.  What reaches the driver doesn't grow with the rows: at most ``BUNDLES``
    bundles, ``BUNDLES`` large groups and a count for each shard in each shuffle partition.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("grp"),
    )
    rows = spool(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    floor = max((total or 0) // BUNDLES, 1)
    bundle = F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("int")
    large = [(bytes(r.grp), r.bytes) for r in groups.where(F.col("bytes") > floor).collect()]
    large.sort(key=lambda g: (-g[1], g[0]))
    small = groups.where(F.col("bytes") <= floor).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    small = sorted((r.bundle, r.bytes) for r in small.collect())
    placed = differencing([b for _, b in large] + [b for _, b in small], shards)
    by_group = spark.createDataFrame(
        [(bytearray(g), s) for (g, _), s in zip(large, placed, strict=False)], "grp binary, own_shard int"
    )
    by_bundle = spark.createDataFrame(
        [(b, s) for (b, _), s in zip(small, placed[len(large) :], strict=True)], "bundle int, bundle_shard int"
    )
    # both tables have at most BUNDLES rows
    put = rows.withColumn("bundle", bundle).join(F.broadcast(by_group), "grp", "left")
    put = put.join(F.broadcast(by_bundle), "bundle", "left").withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    # numbered over a range partitioning, in which no shard, id or text has to stay in one task
    order = ["shard", "doc_id", "text_crc32", "row"]
    put = put.select("doc_id", "size", "text_crc32", "shard", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    put = spool(put.withColumn("m", F.monotonically_increasing_id()).drop("row"))
    put = put.withColumn("part", F.shiftright("m", 33)).withColumn("ix", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = put.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ix").alias("low")).collect()
    starts, at = [], {}
    for r in sorted(counts, key=lambda r: (r.shard, r.part)):
        starts.append((r.shard, r.part, at.get(r.shard, 0) - r.low))
        at[r.shard] = at.get(r.shard, 0) + r.n
    starts = spark.createDataFrame(starts, "shard int, part long, start long")
    return put.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("ix")).alias("slot")
    )
