"""Substring dedup by sliding sentence spans.

Runs of several consecutive sentences are hashed and joined globally; a sentence goes when any run that
covers it was seen earlier, in document order.

Passages are often copied from the middle of one sentence to the middle of another, so what counts as a
sentence here may be a part of one: besides marks and line ends, a word of the smallest hash among its
neighbours ends one (winnowing).  Whether a word ends a sentence depends on the words near it only, so copies
are cut alike wherever they stand.  Runs start at the sparser of two choices of such ends and may stop at any
of the denser one, so they are few and yet cover a passage nearly to its edges: a passage of over 50 words
always holds a whole run, while a common line or two that many texts share are too short for one.  In scripts
without spaces a character is a word that counts half.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keyed, map_arrow, record, spool, text_rows

#: A run has two sentences or more, and at least so many words.
RUN_WORDS = 30
#: So many consecutive words hold a sentence's end, and so many the start of a run.  Choices with a window of w
#: words are alike in all copies but for w - 1 words at either edge.  A run starts within 2 * START - 1 words of a
#: passage's edge, has at most RUN_WORDS - 1 + PART words, and its end must be PART - 1 words from the other edge:
#: n >= 2 * START + 2 * PART + RUN_WORDS - 3 is enough, and holds for 51 words.
PART, START = 3, 9
#: One text in so many is looked through for runs that many texts share; a run that stands so often among these
#: is dealt in so many parts.
SAMPLED, CROWD, PARTS = 64, 16, 64
#: Words whose hash a worker remembers.
REMEMBERED = 300_000
#: A word of more characters is cut by characters as well, and so many of them count as one word.
LONG_WORD, LETTERS = 64, 6
# scripts that don't set words apart: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han, and full-width marks
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?:[{_DENSE}]|[^\s{_DENSE}]+)\s*")
_DENSE_CHAR = re.compile(f"[{_DENSE}]")
_MARKS = frozenset(".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff0e\uff01\uff1f\uff61\u061f\u06d4\u0589\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u0f0d\u0f0e")
_LINE_ENDS = re.compile("[\n\r\u0085\u2028\u2029]")
_CLOSING = "\"')]}\u2019\u201d\u00bb\u300d\u300f\uff09"


class _Hashes(dict):
    """Hash of a word with the white space behind it; odd where it ends a sentence by a mark or a line end."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        bare = word.rstrip()
        ends = bare.rstrip(_CLOSING)[-1:] in _MARKS or _LINE_ENDS.search(word, len(bare)) is not None
        self[word] = h = xxhash.xxh64_intdigest(bare.lower().encode()) & ~1 | ends
        return h


_HASHES = _Hashes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _words(text: str) -> tuple[list[str], np.ndarray | None]:
    """Words with the white space behind them, and their weights in twelfths where not all count alike."""
    words, weights = _WORD.findall(text), None
    if _DENSE_CHAR.search(text):
        weights = [6 if _DENSE_CHAR.match(w) else 12 for w in words]
    if len(text) > LONG_WORD and max(map(len, words), default=0) > LONG_WORD:
        parts, own = [], []
        for w, g in zip(words, weights or [12] * len(words), strict=True):
            bare = len(w.rstrip())
            if bare > LONG_WORD:
                parts += [*w[: bare - 1], w[bare - 1 :]]
                own += [12 // LETTERS] * bare
            else:
                parts.append(w)
                own.append(g)
        words, weights = parts, own
    return words, None if weights is None else np.array(weights, dtype=np.int64)


def _lowest(order: np.ndarray, window: int) -> np.ndarray:
    """Places of the last of the smallest in each window; ``order`` ends in places counted downwards."""
    if len(order) < window:
        return np.zeros(0, dtype=np.int64)
    size, low = 1, order
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    return (np.uint64(2**32 - 1) - (low & np.uint64(2**32 - 1))).astype(np.int64)


def _cut(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with the white space behind them and their hashes; words up to each sentence's end, and their
    weight in twelfths; and the sentences at which runs start."""
    words, weights = _words(text)
    n = len(words)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    ended = (h & np.uint64(1)) > 0
    begun = ended.copy()
    order = np.where(ended, np.uint64(0), h >> np.uint64(32) << np.uint64(32)) | np.arange(2**32 - 1, 2**32 - 1 - n, -1, dtype=np.uint64)
    ended[_lowest(order, PART)] = True
    begun[_lowest(order, START)] = True  # a subset, as the lowest of a window is the lowest of any part of it
    if n:
        ended[-1] = begun[-1] = True
    ends = np.flatnonzero(ended) + 1
    reach = 12 * ends if weights is None else np.cumsum(weights)[ends - 1] if n else ends
    starts = np.flatnonzero(np.r_[True, begun[ends - 1][:-1]]) if n else ends
    return words, h & ~np.uint64(1), ends, reach, starts


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of a text's sentences; together they cover a text that has a word."""
    words, _, ends, _, _ = _cut(text)
    if not words:
        return []
    reach = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    stops = (reach[ends - 1] + (len(text) - int(reach[-1]))).tolist()  # white space in front is the first's
    return list(zip([0, *stops[:-1]], stops, strict=True))


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of each run.

    How far a run reaches depends on its own words only, so the same passage gives the same runs wherever it
    stands; case and white space don't count.  One more run ends with the text, so that copies of whole texts go
    to the last word; a text too short for a run is one as a whole, which other such texts alone can equal.
    """
    words, h, ends, reach, starts = _cut(text)
    n, least, tag = len(ends), 12 * RUN_WORDS, 0
    if not n:
        return np.zeros(0, dtype=np.uint64), ends, ends
    before, first_word = np.r_[0, reach[:-1]], np.r_[0, ends[:-1]]
    if reach[-1] < least:
        first, last, tag = np.zeros(1, dtype=np.int64), np.array([n - 1]), 1
    else:
        last = np.maximum(np.searchsorted(reach, before[starts] + least), starts + 1)
        first, last = starts[last < n], last[last < n]
        tail = starts[before[starts] + least <= reach[-1]][-1]
        if not len(first) or first[-1] != tail or last[-1] != n - 1:
            first, last = np.r_[first, tail], np.r_[last, n - 1]
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), _BASE)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), _INVERSE)])
        total = np.cumsum(np.r_[np.uint64(0), h * up[:-1]], dtype=np.uint64)
        a, b = first_word[first], ends[last]
        value = (total[b] - total[a]) * down[a] + ((b - a) * 2 + tag).astype(np.uint64)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32)), first, last - first + 1


def repeated_spans(texts: DataFrame, sampled: int = SAMPLED, crowd: int = CROWD) -> DataFrame:
    """(d, h, first, n) of every run that stands earlier as well, by null ids last, ``d``, ``h`` and sentence.

    ``texts`` has ``z``, ``d``, ``h`` and ``text``, as ``common.keyed`` makes them.  Rows that repeat all
    of them are one document with equal texts: their runs have equal places, so none of them is later than
    another.  All runs are shuffled once, by hash, and ranked by place.  A hash that many documents share
    would be one task's: its rows are dealt in ``PARTS`` parts, and the first of each part are ranked again.
    Which hashes these are is learnt from every ``sampled``-th text; that decides how rows are dealt and
    nothing else.  Runs are told apart by 64-bit hashes.
    """
    out = T.StructType.fromDDL("z boolean, d long, h long, run long, first int, n int")

    def work(batches):
        for batch in batches:
            got = [runs(t) for t in text_rows(batch)]
            of = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            run, first, n = (np.concatenate(c) for c in zip(*got, strict=True))
            yield record([*(batch.column(c).take(of) for c in ("z", "d", "h")), *map(pa.array, (run.view(np.int64), first.astype(np.int32), n.astype(np.int32)))], out)

    def found(some):
        return map_arrow(some, ["z", "d", "h", "text"], out, work)

    sample = texts.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(sampled)) == 0)
    crowded = spool(found(sample).groupBy("run").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= crowd).select("run", F.lit(True).alias("crowded")))
    # at most one in sampled * crowd runs, so few
    part = F.when(F.col("crowded"), F.pmod(F.xxhash64("d", "h", "first"), F.lit(PARTS)))
    dealt = found(texts).join(F.broadcast(crowded), "run", "left").withColumn("part", part)
    place = ["z", "d", "h", "first"]
    later = F.rank().over(Window.partitionBy("run", "part").orderBy(*place)) > 1
    # null in rows that stand earlier as well; elsewhere the run, whose parts are still to be compared
    again = dealt.withColumn("run", F.when(~later, F.col("run"))).where("run is null or part is not null").select("run", *place, "n")
    if crowded.limit(1).count() == 0:
        return again.select("d", "h", "first", "n")
    again = spool(again)
    firsts = again.where("run is not null").withColumn("r", F.rank().over(Window.partitionBy("run").orderBy(*place))).where("r > 1")
    return again.where("run is null").union(firsts.drop("r")).select("d", "h", "first", "n")


def dedup_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts without the sentences of later copies.

    Returns ``doc_id``, ``n_removed`` (sentences), ``spans`` (removed character ranges, joined where they
    touch) and ``kept`` (what is left).  The first occurrence of a passage stays.  A null or empty
    text has no sentence and gives the empty text; rows come out as often as they go in.  Null ids come last
    in document order; rows with null ids or repeated ids but other texts are documents of their own, and
    rows that repeat id and text are one, of which all stay or go.  An empty table gives no rows; other
    columns are ignored.
    """
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    texts = texts.select("doc_id", "text", F.col("__z").alias("z"), F.col("__d").alias("d"), F.col("__h").alias("h"))
    spans = repeated_spans(texts).groupBy("d", "h").agg(F.collect_set(F.struct("first", "n")).alias("hits"))
    joined = texts.join(spans, ["d", "h"], "left")
    schema = T.StructType.fromDDL(
        "doc_id long, n_removed int, spans array<struct<start:int,stop:int>>, kept string"
    )

    def work(batches):
        for batch in batches:
            rows = []
            for i, text, hits in zip(batch.column("doc_id").to_pylist(), text_rows(batch), batch.column("hits").to_pylist(), strict=True):
                if not hits:  # most texts aren't cut up again
                    rows.append((i, 0, [], text))
                    continue
                where = sentences(text)
                gone = np.zeros(len(where), dtype=bool)
                for h in hits:
                    gone[h["first"] : h["first"] + h["n"]] = True
                cut, kept, at = [], [], 0
                for k in np.flatnonzero(gone).tolist():
                    a, b = where[k]
                    if cut and cut[-1]["stop"] == a:
                        cut[-1]["stop"] = b
                    else:
                        cut.append({"start": a, "stop": b})
                for c in cut:
                    kept.append(text[at : c["start"]])
                    at = c["stop"]
                rows.append((i, int(gone.sum()), cut, "".join([*kept, text[at:]])))
            yield record([list(c) for c in zip(*rows, strict=True)] or [[]] * 4, schema)

    return map_arrow(joined, ["doc_id", "text", "hits"], schema, work)
