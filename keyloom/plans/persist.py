"""Snapshots, change logs, replication and slots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import SLOTS
from keyloom.sources.model import KEY


def save(tables: dict[str, DataFrame], path: str, saved_at: int) -> DataFrame:
    """SAVE and BGSAVE: every table as Parquet, then the manifest, whose presence makes it count.

    Rows are counted as they are written.
    """
    rows = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, seen.get["n"], saved_at))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, "table string, n_rows bigint, saved_at bigint")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a saved snapshot, checked against its manifest."""
    out = {}
    for r in spark.read.parquet(f"{path}/_manifest").collect():
        out[r.table] = spark.read.parquet(f"{path}/{r.table}")
        if out[r.table].count() != r.n_rows:
            raise ValueError(f"snapshot table {r.table} doesn't match its manifest")
    return out


def lastsave(manifest: DataFrame) -> DataFrame:
    """LASTSAVE."""
    return manifest.agg(F.max("saved_at").alias("saved_at"))


def fold_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """A base (db, key, value) with a chain of changes: the last record of a key wins, tombstones remove.

    One aggregation over base and changes together, so neither side is joined.
    """
    rows = base.select(*KEY, "value", F.lit(-1).alias("delta_no"), F.lit(0).cast("bigint").alias("rec_no"), F.lit("put").alias("op"))
    rows = rows.unionByName(deltas.select(*KEY, "value", F.col("delta_no").cast("int"), F.col("rec_no").cast("bigint"), "op"))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), F.struct("delta_no", "rec_no")).alias("r"))
    return last.where("r.op = 'put'").select(*KEY, F.col("r.value").alias("value"))


def snapshot_mode(base_bytes: int, delta_bytes: int, n_deltas: int, max_deltas: int = 8, ratio: float = 0.5) -> str:
    """Whether the next save writes a base or a delta."""
    return "base" if base_bytes == 0 or n_deltas >= max_deltas or delta_bytes > ratio * base_bytes else "delta"


def reshard(keys: DataFrame, shards: int) -> DataFrame:
    """Shard of each key when slots are dealt out evenly to ``shards``."""
    from keyloom.functions.exprs import key_slot, slot_to_shard

    return keys.withColumn("slot", key_slot("key")).withColumn("shard", slot_to_shard("slot", shards))


def gaps(log: DataFrame) -> DataFrame:
    """Replication: offsets after which one or more are missing, by shard; a replica must resync there."""
    w = Window.partitionBy("shard").orderBy("off")
    seen = log.select("shard", "off").distinct().withColumn("prev", F.lag("off").over(w))
    return seen.where(F.col("off") - F.col("prev") > 1)


def apply_log(log: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Replica apply: duplicates (offset at or below the applied one) are skipped, the last write wins."""
    rows = log.dropDuplicates(["shard", "off"])
    if applied is not None:
        rows = rows.join(F.broadcast(applied), "shard", "left").where("applied is null or off > applied")  # a row per shard
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), F.col("off")).alias("r"))
    return last.where("r.op = 'put'").select(*KEY, F.col("r.value").alias("value"))


def lag(heads: DataFrame, acks: DataFrame) -> DataFrame:
    """Replica lag: how far each node's acknowledged offset is behind the head."""
    got = acks.join(heads, "shard")
    return got.withColumn("lag", F.greatest(F.col("head") - F.col("acked"), F.lit(0)))


def wait_acks(acks: DataFrame, asked: DataFrame) -> DataFrame:
    """WAIT: of each shard the replicas that acknowledged the offset ``off`` that is asked for, by ``want`` or more.

    ``acks`` is (shard, node, acked), ``asked`` (shard, off, want), a row for each shard.
    """
    got = asked.join(acks, "shard", "left").groupBy("shard", "off", "want").agg(F.count_if(F.col("acked") >= F.col("off")).alias("replicas"))
    return got.withColumn("enough", F.col("replicas") >= F.col("want"))


def spill(log: DataFrame, path: str, segment_ops: int = 10_000) -> None:
    """Disk backlog: appends (shard, off, ...) rows, partitioned by shard and segment of offsets."""
    placed = log.withColumn("segment", F.floor(F.col("off") / segment_ops).cast("bigint"))
    placed.write.mode("append").partitionBy("shard", "segment").parquet(path)


def ops_after(spark: SparkSession, path: str, shard, off: int, segment_ops: int = 10_000) -> DataFrame:
    """What a replica at offset ``off`` lacks; only segments from that offset on are read."""
    rows = spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("segment") >= off // segment_ops))
    return rows.where(F.col("off") > off).drop("segment")


def prune(backlog: DataFrame, keep: int, segment_ops: int = 10_000) -> DataFrame:
    """Segments that may go: those wholly below the last ``keep`` operations of their shard."""
    head = backlog.groupBy("shard").agg(F.max("off").alias("head"))
    old = backlog.select("shard", F.floor(F.col("off") / segment_ops).cast("bigint").alias("segment")).distinct().join(head, "shard")
    return old.where((F.col("segment") + 1) * segment_ops <= F.col("head") - keep).select("shard", "segment")


def promotable(lags: DataFrame, bound: int) -> DataFrame:
    """Failover: of each shard the linked replica of least lag within a bound."""
    good = lags.where(F.col("link_up") & (F.col("lag") <= bound))
    return good.groupBy("shard").agg(F.min_by("node", F.struct("lag", "node")).alias("node"))


def slot_ranges(owners: DataFrame) -> DataFrame:
    """CLUSTER SLOTS: (slot, node) rows as contiguous ranges of each node."""
    island = F.col("slot") - F.row_number().over(Window.partitionBy("node").orderBy("slot"))
    got = owners.withColumn("island", island).groupBy("node", "island")
    return got.agg(F.min("slot").alias("first"), F.max("slot").alias("last")).drop("island")


def rebalance_moves(owners: DataFrame, nodes: int) -> DataFrame:
    """CLUSTER REBALANCE: the fewest slots that must move so that each node owns an even share.

    Of each node the slots beyond its target leave, and fill the nodes below theirs in order.  Slots are
    16384 at most, whatever the data.
    """
    spark = owners.sparkSession
    share = [SLOTS // nodes + (i < SLOTS % nodes) for i in range(nodes)]
    total = owners.count()
    if total != SLOTS:
        share = [total // nodes + (i < total % nodes) for i in range(nodes)]
    targets = spark.createDataFrame(list(enumerate(share)), "node int, target int")
    counts = owners.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    have = targets.join(counts, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("slot"))
    surplus = owners.withColumn("nth", nth).join(have.select("node", "target"), "node").where("nth > target")
    surplus = surplus.withColumn("k", F.row_number().over(Window.orderBy("slot")))
    holes = have.where("n < target").select("node", F.explode(F.sequence(F.lit(1), F.col("target") - F.col("n"))).alias("j"))
    holes = holes.withColumn("k", F.row_number().over(Window.orderBy("node", "j"))).select("k", F.col("node").alias("to_node"))
    return surplus.join(holes, "k").select("slot", F.col("node").alias("from_node"), "to_node")


def zipf_workload(spark: SparkSession, n: int, keys: int, theta: float = 0.99, read_ratio: float = 0.9, value_bytes: int = 128, seed: int = 42) -> DataFrame:
    """Load generator: a log of reads and writes whose keys follow a Zipf law, by inverse distribution."""
    a = 1 - theta
    zeta = sum(1 / i**theta for i in range(1, min(keys, 10_000) + 1))
    if keys > 10_000:  # the tail as an integral
        zeta += ((keys + 0.5) ** a - 10_000.5**a) / a
    two = 1 + 0.5**theta
    eta = (1 - (2 / keys) ** a) / (1 - two / zeta)
    u = F.rand(seed)
    rows = spark.range(n).withColumn("u", u).withColumn("r", F.rand(seed + 1))
    uz = F.col("u") * zeta
    rank = F.when(uz < 1, 0).when(uz < two, 1).otherwise(F.floor(keys * F.pow(eta * F.col("u") - eta + 1, F.lit(1 / a))))
    return rows.select(
        F.col("id").alias("seq"), F.when(F.col("r") < read_ratio, "GET").otherwise("SET").alias("cmd"),
        F.concat(F.lit("key:"), F.least(rank, F.lit(keys - 1)).cast("string")).alias("key"),
        F.when(F.col("r") >= read_ratio, F.repeat(F.lit("x"), value_bytes)).alias("value"),
    )


def info_text(values: dict[str, int | float], prefix: str = "keyspace") -> str:
    """Metrics in Prometheus text form."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v:g}\n" for k, v in sorted(values.items()) if not math.isnan(v))
