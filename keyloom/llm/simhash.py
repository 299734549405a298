"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits and two of them link when at most three bits differ.  Cut in two halves, one
half differs in at most one bit; so each half is indexed 32 times, each time with one bit wiped out.
Fingerprints that share a variant are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, components, keyed, map_arrow, record, spool, text_rows

DISTANCE = 3
#: Fingerprints of one signature that are compared pair by pair; larger groups take ``_ball_edges``.
PAIRWISE = 1024


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 values of word shingles, as an unsigned integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    values = np.array([h(g, seed) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65536):  # in blocks, for long texts
        part = values[at : at + 65536].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def signatures(fps: DataFrame) -> DataFrame:
    """(fp, sig): the 64 one-wildcard variants of the two halves of each fingerprint."""
    # a half with one of its 32 bits wiped, and above it the number of half and bit
    variant = F.expr(
        "transform(sequence(0, 63), k -> (shiftrightunsigned(fp, 32 * (k div 32)) & 4294967295L "
        "& ~shiftleft(1L, k % 32)) | shiftleft(cast(k as bigint), 32))"
    )
    return fps.select("fp", F.explode(variant).alias("sig"))


def forest(values: list[int], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect what links at ``distance`` or less among a few fingerprints."""
    left = np.array(values, dtype=np.int64).view(np.uint64)
    edges = []
    rest = np.arange(len(left))
    while len(rest) > 1:
        near, rest = rest[:1], rest[1:]
        while len(near) and len(rest):
            # everything linked to what was reached last joins the tree
            diff = np.bitwise_count(left[near][:, None] ^ left[rest][None, :])
            hit = diff.min(axis=0) <= distance
            by = near[diff.argmin(axis=0)]
            edges += zip(left[by[hit]].view(np.int64).tolist(), left[rest[hit]].view(np.int64).tolist(), strict=True)
            near, rest = rest[hit], rest[~hit]
    return edges


def _ball_edges(fps: DataFrame) -> DataFrame:
    """Exact links of fingerprints in crowded signatures, without pairs.

    Two fingerprints within three bits share a word that is within one bit of the one and within two
    bits of the other.  Whatever is within two bits of a word links to anything within one bit of it,
    so per word one member within one bit is the hub of all others: the rows grow with the members.
    """
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    flips = np.array(flips, dtype=np.uint64).view(np.int64).tolist()
    near = F.posexplode(F.lit(flips))
    balls = fps.select("fp", near.alias("k", "flip")).select("fp", F.expr("fp ^ flip").alias("word"), (F.col("k") <= 64).alias("one"))
    hubs = balls.groupBy("word").agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all"))
    return hubs.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within three bits; ``fps`` is distinct.

    Signatures are dealt out by value and sorted, so that the members of one come in a row: up to
    ``PAIRWISE`` of them are compared in memory; of a larger group every member is passed on (b is null)
    to ``_ball_edges``, so no task holds a group of unbounded size.
    """
    out = T.StructType.fromDDL("a long, b long")

    def work(batches):
        sig, held, crowded = None, [], False
        for batch in batches:
            sigs, members = batch.column("sig").to_numpy(), batch.column("fp").to_numpy()
            starts = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else []
            ends = [*starts[1:], len(sigs)] if len(sigs) else []
            edges = []
            # only runs of two or more, and the first and last of a batch, can matter
            lone = np.asarray(ends) - np.asarray(starts) == 1
            for i in [i for i in range(len(starts)) if not lone[i] or i in (0, len(starts) - 1)]:
                group = members[starts[i] : ends[i]].tolist()
                if sigs[starts[i]] != sig:
                    edges += [] if crowded else forest(held)
                    sig, held, crowded = sigs[starts[i]], [], False
                if crowded or len(held) + len(group) > PAIRWISE:
                    edges += [(x, None) for x in held + group]
                    held, crowded = [], True
                else:
                    held = held + group
            yield record([[e[0] for e in edges], [e[1] for e in edges]], out)
        edges = [] if crowded else forest(held)
        yield record([[e[0] for e in edges], [e[1] for e in edges]], out)

    dealt = signatures(fps).repartition("sig").sortWithinPartitions("sig", "fp")
    found = spool(map_arrow(dealt, ["sig", "fp"], out, work, rows=50_000))
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    edges = found.where("b is not null")
    return edges.union(_ball_edges(crowded)) if crowded.limit(1).count() else edges


def _marked(docs: DataFrame, columns: list[str], shingle: int, text_col: str) -> DataFrame:
    """``columns`` of every row and ``fp``, the bits of its fingerprint as a signed long."""
    out = T.StructType([*(docs.schema[c] for c in columns), T.StructField("fp", T.LongType())])

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in text_rows(batch, text_col)], dtype=np.uint64)
            yield record([*(batch.column(c) for c in columns), pa.array(fps.view(np.int64))], out)

    return spool(map_arrow(docs, [*columns, text_col], out, work))


def _named(marked: DataFrame, least) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of every fingerprint, and (root, least) with the smallest ``least`` of each component."""
    nodes = spool(marked.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.select("fp", "root"), named.groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    ``component_id`` is the smallest ``doc_id`` reachable over links.  Equal fingerprints are one node,
    so copies never make pairs.  A null or empty text has fingerprint zero and links like any other; a
    text of fewer words than a shingle is one shingle; repeated rows come out as often as they go in; a
    null ``doc_id`` is never a component's name unless there is no other.  Other columns are ignored.
    """
    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], shingle, "text")
    roots, names = _named(marked, F.col("doc_id"))
    by_fp = roots.join(names, "root").select("fp", F.col("least").alias("component_id"))
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns.

    It is the one of smallest ``doc_id``, null ids last, and of the smallest text hash where different texts
    share that id.  Rows with null ids or repeated ids are documents of their own: they go only if their
    group has another.  Of rows that repeat both id and text one stays.  Null and empty texts are one group.
    An empty table gives no rows.
    """
    rows = keyed(docs, text_col)
    marked = _marked(rows.select("__z", *KEY, F.col(text_col).alias("text")), ["__z", *KEY], shingle, "text")
    _, first = _named(marked, F.struct("__z", *KEY))
    # rows are dealt out once: repeated ones are reduced on the way, then the others of a group go
    return rows.dropDuplicates(KEY).join(first.select("least.*").select(*KEY), KEY, "left_semi").select(*docs.columns)
