"""Dedup of repeated byte strings by a suffix order of anchors.

Sorting every byte suffix doesn't fit a cluster's disks, so suffixes are sampled: the anchor of a window of
``length`` bytes is its rarest-hashed short string; it depends on the window alone, so equal windows have
equal anchors at equal places.  Anchors whose whole context is equal are collapsed by counting.  The rest
make sequences of names, whose suffixes the distributed difference-cover algorithm ranks: triples at two of
three places are sorted and named, their order comes from a recursion on the names, and the remaining
suffixes are merged in.  Contexts are then read in the order of the ranks, and neighbours whose prefixes agree
form blocks: only within a block are windows compared, by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keyed, map_arrow, record, spool, text_rows

#: Bytes of a repeat, and of the string that names an anchor.
LENGTH, GRAM = 400, 32
#: Symbols up to which a sequence is sorted in memory, as the end of the recursion.
IN_MEMORY = 100_000
#: Positions in a slice of a sequence when neighbours are looked up.
SLICE = 4096
#: Bytes of small blocks that are compared at once, and contexts from which a block is compared in parts.
CHUNK, CROWD = 4_000_000, 32_768
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint64)


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` bytes, by doubling; 64 bits."""
    with np.errstate(over="ignore"):
        power, have, width, part = _MULTIPLY, 0, 1, _BYTES[raw]
        out, rest = None, length
        while True:
            if rest & 1:
                if out is None:
                    out, have = part, width
                else:  # what is there, then the next part after it
                    n = len(raw) - have - width + 1
                    out = out[:n] * power + part[have : have + n]
                    have += width
            rest >>= 1
            if not rest:
                break
            n = max(len(part) - width, 0)
            part = part[:n] * power + part[width : width + n]
            power, width = power * power, width * 2
        out = out[: max(len(raw) - length + 1, 0)]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first, last, name): the anchor of all windows that start at ``first`` to ``last``."""
    n, width = len(raw), length - gram + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    view, got, bits = np.frombuffer(raw, dtype=np.uint8), [], 20
    for at in range(0, n - length + 1, 1 << 19):  # blocks, for long texts
        h = rolling(view[at : at + (1 << 19) + length - 1], gram)
        low = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
        size, rest = 1, low
        while size * 2 <= width:
            rest = np.minimum(rest[:-size], rest[size:])
            size *= 2
        if size < width:
            rest = np.minimum(rest[: len(rest) - (width - size)], rest[width - size :])
        place = (rest & np.uint64((1 << bits) - 1)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        last = np.r_[first[1:] - 1, len(place) - 1]
        got.append((place[first] + at, first + at, last + at, h[place[first]].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def numbered(df: DataFrame, order: list[str], flag: Column | None = None) -> DataFrame:
    """Add ``ix``, the place in the total order by ``order``, and ``before``, flagged rows before a row.

    A range partitioning sorts; what crosses partitions is one count for each of them.
    """
    df = df.withColumn("flagged", (flag if flag is not None else F.lit(False)).cast("int"))
    put = spool(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    put = put.withColumn("part", F.shiftright("m", 33))
    sizes = sorted(put.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("flagged").alias("f")).collect())
    starts, n, f = [], 0, 0
    for r in sizes:
        starts.append((r.part, n, f))
        n, f = n + r.n, f + r.f
    starts = df.sparkSession.createDataFrame(starts, "part long, n0 long, f0 long")
    put = put.join(F.broadcast(starts), "part")  # a row for each partition
    run = Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("f0") + F.coalesce(F.sum("flagged").over(run), F.lit(0)) if flag is not None else F.lit(0)
    return put.withColumn("before", before).withColumn("ix", F.col("n0") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop(
        "part", "m", "n0", "f0", "flagged"
    )


def neighbours(df: DataFrame, place: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns of the rows that stand up to two places on; ``place`` counts without gaps.

    Rows are dealt out in slices, each with the first two rows of the next one; past the end stands null.
    """
    slice_of = F.floor(F.col(place) / SLICE)
    spread = F.when((F.col(place) % SLICE < 2) & (slice_of > 0), F.array(slice_of, slice_of - 1)).otherwise(F.array(slice_of))
    dealt = df.withColumn("slice", F.explode(spread))
    order = Window.partitionBy("slice").orderBy(place)
    for name, (col, k) in columns.items():
        dealt = dealt.withColumn(name, F.lead(col, k).over(order))
    return dealt.where(F.col("slice") == slice_of).drop("slice")


def _ranks_in_memory(seq: DataFrame) -> DataFrame:
    rows = seq.select("pos", "sym").toArrow()
    pos, sym = rows.column("pos").to_numpy(), rows.column("sym").to_numpy()
    s = sym[np.argsort(pos)]
    rank = np.unique(s, return_inverse=True)[1] + 1
    k = 1
    while len(rank) and rank.max() < len(rank):
        ahead = np.r_[rank[k:], np.zeros(min(k, len(rank)), dtype=rank.dtype)]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1] + 1
        k *= 2
    table = pa.table({"pos": np.arange(len(rank), dtype=np.int64), "rank": rank.astype(np.int64)})
    return seq.sparkSession.createDataFrame(table)


def suffix_ranks(seq: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """(pos, rank) with ranks from 1 of all suffixes of a sequence (pos, sym).

    Positions count from 0 without gaps, symbols are positive, and the last one is unique.
    """
    n = seq.count()
    if n <= max(in_memory, 3):
        return _ranks_in_memory(seq)
    zero = F.lit(0).cast("long")
    t = neighbours(seq.select("pos", F.col("sym").alias("s0")), "pos", {"s1": ("s0", 1), "s2": ("s0", 2)})
    t = spool(t.select("pos", "s0", F.coalesce("s1", zero).alias("s1"), F.coalesce("s2", zero).alias("s2")))
    # sorted and named triples at the positions that aren't divisible by three
    sampled = t.where("pos % 3 <> 0")
    dummy = n % 3 == 1  # the empty suffix then counts as sampled, as the last suffix leads to it
    if dummy:
        sampled = sampled.union(seq.sparkSession.range(n, n + 1).select(F.col("id"), zero, zero, zero))
    names = numbered(sampled.select("s0", "s1", "s2").distinct(), ["s0", "s1", "s2"])
    names = names.select("s0", "s1", "s2", (F.col("ix") + 1).alias("name"))
    named = spool(sampled.join(names, ["s0", "s1", "s2"]).select("pos", "name"))
    n1 = (n + 1) // 3 + dummy
    size = n1 + n // 3
    if named.agg(F.max("name")).first()[0] < size:
        third = F.floor(F.col("pos") / 3)
        shorter = named.select(F.when(F.col("pos") % 3 == 1, third).otherwise(third + n1).alias("pos"), F.col("name").alias("sym"))
        inner = suffix_ranks(spool(shorter), in_memory)
        back = F.when(F.col("pos") < n1, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - n1) + 2)
        ranks = spool(inner.select(back.alias("pos"), F.col("rank").alias("r")))
    else:
        ranks = named.select("pos", F.col("name").alias("r"))
    # each suffix with the ranks of its own place and the next two
    none = F.lit(None).cast("long")
    parts = t.select("pos", "s0", "s1", none.alias("r0"), none.alias("r1"), none.alias("r2"))
    for k in range(3):
        own = [F.col("r") if j == k else none for j in range(3)]
        parts = parts.union(ranks.select(F.col("pos") - k, none, none, *own))
    full = parts.groupBy("pos").agg(*(F.max(c).alias(c) for c in ("s0", "s1", "r0", "r1", "r2")))
    full = spool(full.where("s0 is not null").select("pos", "s0", "s1", "r0", *(F.coalesce(c, zero).alias(c) for c in ("r1", "r2"))))
    # merging: two sorts tell for each suffix how many of the other kinds come before it
    rest = F.col("pos") % 3 == 0
    a = numbered(full.where("pos % 3 <> 2").select("pos", "s0", "r0", "r1"), ["s0", "r1"], rest)
    b = numbered(full.where("pos % 3 <> 1").select("pos", "s0", "s1", "r0", "r2"), ["s0", "s1", "r2"], rest)
    of_sampled = F.col("r0") - int(dummy) + F.col("before")
    one = a.where("pos % 3 = 1").select("pos", of_sampled.alias("rank"))
    two = b.where("pos % 3 = 2").select("pos", of_sampled.alias("rank"))
    three = a.where(rest).select("pos", "ix", "before").join(b.where(rest).select("pos", F.col("ix").alias("jx")), "pos")
    three = three.select("pos", (F.col("ix") + F.col("jx") - F.col("before") + 1).alias("rank"))
    return spool(one.union(two).union(three))


def _blocks(reps: DataFrame, in_memory: int) -> DataFrame:
    """Rows (d, h, k, name, n, ...) with the ``rank`` of the suffix of anchor names that starts at each, and its ``block``.

    Neighbouring anchors of a text make a run of the sequence, and a symbol of its own ends every run.  A
    block is a stretch of neighbours in suffix order whose prefixes start with the same name; ``part`` cuts
    up blocks of over ``CROWD`` rows.
    """
    order = Window.partitionBy("d", "h").orderBy("k")
    ends = F.coalesce(F.lead("k").over(order) != F.col("k") + 1, F.lit(True))
    rows = reps.withColumn("ends", ends).withColumn("mark", F.explode(F.when(F.col("ends"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = numbered(rows.drop("ends"), ["d", "h", "k", "mark"])
    # names are odd and positive, ends are even
    symbol = F.when(F.col("mark") == 0, F.shiftrightunsigned("name", 2) * 2 + 1).otherwise(F.col("ix") * 2 + 2)
    seq = spool(placed.withColumn("sym", symbol).withColumnRenamed("ix", "pos").drop("before"))
    ranks = suffix_ranks(seq.select("pos", "sym"), in_memory)
    ranked = seq.join(ranks.select("pos", (F.col("rank") - 1).alias("rank")), "pos").drop("pos")
    beside = neighbours(ranked, "rank", {"next": ("sym", 1)})
    blocks = numbered(beside, ["rank"], ~F.col("sym").eqNullSafe(F.col("next")))
    part = F.when(F.col("n") > CROWD, F.floor(F.col("rank") / CROWD)).otherwise(0)
    return blocks.where("mark = 0").withColumn("part", part).withColumnRenamed("before", "block").drop("sym", "mark", "next", "ix")


def _compare(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, h, a, b, w): ranges covered by windows found twice; with w, a window of hash w still to be counted.

    ``contexts`` come in suffix order, and windows are looked for within a block, where a context shares
    ``gram`` bytes from its anchor on with the one before.  Parts of a block of over ``CROWD`` contexts report
    the windows they saw, each hash once.
    """
    out = T.StructType.fromDDL("d long, h long, a int, b int, w long")

    def covered(rows, report):
        joined = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        hashes = rolling(joined, length)
        sizes = np.array([len(r[3]) for r in rows])
        starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        own = np.concatenate([hashes[s : s + c] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)])
        values, one, inverse, seen = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        hit, at, cols = seen[inverse] > 1, 0, [[] for _ in range(5)]
        for (d, h, first, _), c in zip(rows, counts.tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.r_[0, hit[at : at + c].astype(np.int8), 0]))
            at += c
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for col, v in zip(cols, (d, h, first + a, first + b - 1 + length, None), strict=True):
                    col.append(v)
        ranges = record(cols, out)
        if not report:
            return [ranges]
        of = np.searchsorted(np.cumsum(counts), one, side="right")
        begin = np.array([r[2] for r in rows])[of] + one - (np.cumsum(counts) - counts)[of]
        ids = [pa.array([rows[i][k] for i in of.tolist()], type=pa.int64()) for k in (0, 1)]
        return [ranges, record([*ids, pa.array(begin.astype(np.int32)), pa.array((begin + length).astype(np.int32)), pa.array(values.view(np.int64))], out)]

    def work(batches):
        ready, waiting, held, last, prefix, crowded = [], 0, [], None, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "part", "n", "d", "h", "at", "first", "bytes")]
            for block, part, n, d, h, at, first, raw in zip(*columns, strict=True):
                own = raw[at : at + gram]
                if (block, part) != last or own != prefix:  # compared with the neighbour in suffix order
                    if crowded and held:
                        yield from covered(held, True)
                    elif len(held) > 1:  # a lone context repeats nothing
                        ready += held
                        waiting += sum(len(r[3]) for r in held)
                        if waiting > CHUNK:
                            yield from covered(ready, False)
                            ready, waiting = [], 0
                    held, last, prefix, crowded = [], (block, part), own, n > CROWD
                held.append((d, h, first, raw))
        if crowded and held:
            yield from covered(held, True)
        elif len(held) > 1:
            ready += held
        if ready:
            yield from covered(ready, False)

    dealt = contexts.repartitionByRange("block", "part").sortWithinPartitions("block", "part", "rank")
    return map_arrow(dealt, ["block", "part", "n", "d", "h", "at", "first", "bytes"], out, work, rows=2048)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, in_memory: int | None = None) -> DataFrame:
    """(d, h, a, b): byte ranges covered by ``length`` bytes that also start anywhere else, of ``texts`` (d, h, text)."""
    gram = min(GRAM, length)
    texts = texts.where(F.octet_length("text") >= length).select("d", "h", "text")
    out = T.StructType.fromDDL("d long, h long, k int, place int, first int, last int, name long, context long")

    def find(batches):
        for batch in batches:
            cols = [[] for _ in range(8)]
            for d, h, text in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), text_rows(batch), strict=True):
                raw = text.encode()
                p, a, b, name = anchors(raw, length, gram)
                if not len(p):
                    continue
                keys = zip((p - a).tolist(), a.tolist(), b.tolist(), strict=True)
                # the windows of an anchor as one string, with its place in them
                seen = [xxhash.xxh64_intdigest(raw[f : t + length], n) for n, f, t in keys]
                for c, v in zip(cols, (np.full(len(p), d), np.full(len(p), h), np.arange(len(p)), p, a, b, name), strict=False):
                    c.append(v)
                cols[7].append(np.array(seen, dtype=np.uint64).view(np.int64))
            types = [np.int64] * 2 + [np.int32] * 4 + [np.int64] * 2
            yield record([pa.array(np.concatenate(c or [[]]).astype(t)) for c, t in zip(cols, types, strict=True)], out)

    found = spool(map_arrow(texts, ["d", "h", "text"], out, find))
    # equal contexts: all their windows stand twice, and one of them speaks for all
    rep = F.struct("d", "h", "k", "place", "first", "last")
    kinds = spool(found.groupBy("name", "context").agg(F.count(F.lit(1)).alias("n"), F.min(rep).alias("rep")))
    twice = kinds.where("n > 1").select("name", "context")
    sure = found.join(twice, ["name", "context"], "left_semi").select("d", "h", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    # a name that stands once shares no prefix with a neighbour
    several = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reps = kinds.select("name", "rep.*").join(several, "name")
    placed = _blocks(reps, IN_MEMORY if in_memory is None else in_memory)
    cut = placed.groupBy("d", "h").agg(F.collect_list(F.struct("block", "part", "n", "rank", "place", "first", "last")).alias("cut"))
    schema = T.StructType.fromDDL("block long, part long, n long, rank long, d long, h long, at int, first int, bytes binary")

    def extract(batches):
        for batch in batches:
            rows = []
            for d, h, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "cut")), strict=True):
                raw = text.encode()
                rows += [
                    (c["block"], c["part"], c["n"], c["rank"], d, h, c["place"] - c["first"], c["first"], raw[c["first"] : c["last"] + length])
                    for c in cuts
                ]
            yield record([list(c) for c in zip(*rows, strict=True)] or [[]] * 9, schema)

    contexts = spool(map_arrow(texts.join(cut, ["d", "h"]), ["d", "h", "text", "cut"], schema, extract))
    compared = spool(_compare(contexts, length, gram))
    more, reported = compared.where("w is null").select("d", "h", "a", "b"), compared.where("w is not null")
    if reported.limit(1).count():
        again = reported.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
        more = more.union(reported.join(again, "w", "left_semi").select("d", "h", "a", "b"))
    return sure.union(more)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, in_memory: int | None = None, text_col: str = "text") -> DataFrame:
    """Texts without the bytes of any string of ``length`` bytes that stands twice or more.

    Returns ``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges, maximal) and ``kept`` (the bytes that
    are left), a row for each row of ``docs``.  All occurrences go, the first included, and strings are
    judged on the input.  A null text is empty; a text shorter than ``length`` stays.  Every row is a text of
    its own, whatever its ``doc_id``: rows with null ids are compared like others, different texts under one
    id keep apart, and repeated rows are copies.  An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = keyed(texts).select("doc_id", "text", F.col("__d").alias("d"), F.col("__h").alias("h"))
    ranges = repeated_ranges(texts, length, in_memory).groupBy("d", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    joined = texts.join(ranges, ["d", "h"], "left")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")

    def work(batches):
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), text_rows(batch), batch.column("ranges").to_pylist(), strict=True):
                raw, spans = text.encode(), []
                for a, b in sorted((r["a"], r["b"]) for r in found or ()):
                    if spans and a <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(b, spans[-1]["stop"])
                    else:
                        spans.append({"start": a, "stop": b})
                kept, at = [], 0
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["stop"]
                rows.append((doc, len(raw), spans, b"".join([*kept, raw[at:]])))
            yield record([list(c) for c in zip(*rows, strict=True)] or [[]] * 4, schema)

    return map_arrow(joined, ["doc_id", "text", "ranges"], schema, work)
