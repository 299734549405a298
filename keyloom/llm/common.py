"""Helpers shared by the text operators: storage for cut lineage, Arrow text passes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.sources.shipping import ship

#: Rows that are worked on at once.  Spark bounds the bytes of an Arrow batch (64 MB unless set otherwise); what is
#: made of a batch in Python is bounded by taking it in slices, as texts may be long.
ARROW_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session; where that is unset and Spark runs in one process (tests)
    a temporary folder is made and set.  On a cluster a missing setting is an error, as each machine would
    write to its own disk.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", kept)
    return kept.rstrip("/")


def spool(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there.

    A lost executor costs no recomputation of what was spooled.  Files stay until the application's
    folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and three that tell its texts apart, also where ids are null or repeated.

    ``__d`` and ``__h`` are the id (0 for null) and a hash of the text that also differs for null ids;
    ``__z`` is true for a null id.  Rows that agree in all three are copies of one text under one id.
    """
    null_id = F.col("doc_id").isNull()
    return docs.withColumns(
        {
            "__z": null_id,
            "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
            "__h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), null_id),
        }
    )


KEY = ["__d", "__h"]


def map_arrow(
    df: DataFrame,
    columns: list[str],
    out: T.StructType,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    rows: int = ARROW_ROWS,
) -> DataFrame:
    """``mapInArrow`` over only ``columns``; ``work`` gets slices of ``rows`` rows, so that long texts fit in memory.

    No setting of the session is touched, so frames that are executed later behave alike.
    """
    ship(df.sparkSession)

    def sliced(batches):
        return work(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.select(*columns).mapInArrow(sliced, out)


def text_rows(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def record(batch_cols: list, schema: T.StructType) -> pa.RecordBatch:
    """A record batch of the given columns in the order of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(batch_cols, fields, strict=True)],
        schema=fields,
    )


def held_out(col: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder modulo five."""
    return (F.crc32(F.col(col).cast("string")) % 5) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, extra=None) -> DataFrame:
    """At most ``rows`` labelled documents in hash order of the id (the documented bound of a fit).

    Null ids and labels are left out; of repeated ids the largest label counts.  The chosen ids are
    at most ``rows``, which bounds what the join broadcasts.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if extra is not None:
        picked = picked.where(extra)
    picked = picked.groupBy("doc_id").agg(F.max(label).alias("__y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b); returns (node, root).

    Root is the smallest node of a component.  Large-star and small-star rounds alternate; every
    round is two aggregations by node, and the edges stay distributed in the shared folder.  An empty
    graph gives no rows.  Repeated edges and loops are harmless.
    """
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is hung on the smallest one
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node and its smaller neighbours are hung on the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = spool(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
