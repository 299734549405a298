"""Toxicity by a gapped-subsequence string kernel with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, each weighted by decay to the
power of its spread, so inserted characters only dampen a match.  A linear support vector machine works
in the space that landmark words span.  Its decision is linear in the subsequences of a word, so it
folds, exactly, into one table over subsequences.  A document is as toxic as its three worst words and the
share of its words that the machine takes for insults, weighed by a logistic fit: one ordinary word that
looks like an insult, or a few in a long text, shouldn't count as much as several in a short one.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from itertools import takewhile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, map_arrow, record, spool, text_rows
from .svm import fit_joint, fit_svm

#: Bounds of a fit unless it is given others: labelled texts, words taken for insults, ordinary words, landmarks.
SAMPLE_ROWS = 8000
POSITIVE_WORDS, NEGATIVE_WORDS = 1500, 12000
LANDMARKS = 160
HARD_ROUNDS = 2
PARTITIONS = 6
#: Log likelihood gain from which a word counts as an insult.
EVIDENCE = 6.0
DECAY, SPREAD = 0.8, 4
#: Letters of a word that are compared at once; longer words are cut into overlapping pieces.
PIECE, OVERLAP = 24, 8
SYMBOLS = 32
START, END = bytes([31]), bytes([30])
#: Distinct words in a generation of a worker's memory.
REMEMBERED = 300_000
#: Characters written in place of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "ß": "s"}
_SPELLED = regex.compile(r"(?<!\S)(?:[^\W\d_][^\p{L}\p{N}]{1,3}){3,}[^\W\d_](?!\p{L})")
_FOLDED: dict[str, int] = {}
EMPTY = -1.0
#: Words of a text whose margins count, the worst first.
WORST = 3
#: The share of insults is counted in hits for so many words, up to a limit; shorter texts count as ``FEW`` words.
PER_WORDS, MOST_HITS, FEW = 50, 3.0, 20


def _fold(c: str) -> int:
    """Letter number of a character: 1 to 26, other letters 27 to 29, 0 for what is skipped."""
    got = _FOLDED.get(c)
    if got is None:
        base = LOOKALIKES.get(c) or unicodedata.normalize("NFKD", c)[:1].lower()
        if "a" <= base <= "z":
            got = ord(base) - 96
        else:
            got = 27 + ord(base) % 3 if base.isalnum() else 0
        _FOLDED[c] = got
    return got


def letters(word: str) -> bytes:
    """Letter numbers of a word between marks of its start and end.

    Punctuation between letters is skipped, and marks around a word aren't letters.  Two letters are too
    few to tell anything.
    """
    inner = bytes(filter(None, map(_fold, word.strip("!$@.,;:?\"'()[]"))))
    return START + inner + END if len(inner) > 2 else b""


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words of a whole text, and words that were spelled out letter by letter."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(m.split()) for m in _SPELLED.findall(low))
    return found


def pieces(word: bytes) -> list[bytes]:
    """A word's letters, in overlapping pieces where it is long."""
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, subsequence, weight) of the kernel's feature vectors, normalised to length one."""
    width = max([3, *map(len, words)])
    m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
    rows, codes, weights = [], [], []
    for b in range(2, SPREAD + 1):
        if b >= width:
            break
        for a in range(1, b):
            r, k = np.nonzero(m[:, b:])
            rows.append(r)
            codes.append((m[r, k] * SYMBOLS + m[r, k + a]) * SYMBOLS + m[r, k + b])
            weights.append(np.full(len(r), DECAY ** (b + 1)))
    r, c, w = map(np.concatenate, (rows, codes, weights))
    key, at = np.unique(r * SYMBOLS**3 + c, return_inverse=True)
    w = np.bincount(at, w, len(key))
    r, c = key // SYMBOLS**3, key % SYMBOLS**3
    norm = np.sqrt(np.bincount(r, w * w, len(words)))
    return r, c, w / norm[r] if len(r) else w


def dense(words: list[bytes]) -> np.ndarray:
    """Feature vectors as a dense matrix, for a bounded number of words."""
    r, c, w = subsequences(words)
    out = np.zeros((len(words), SYMBOLS**3), dtype=np.float32)
    out[r, c] = w
    return out


@dataclass
class ToxicityModel:
    """The folded table over subsequences, bias, calibration, and a memory of scored words."""

    table: np.ndarray
    bias: float
    slopes: np.ndarray = field(default_factory=lambda: np.eye(1, WORST + 1)[0])
    offset: float = 0.0
    known: dict = field(default_factory=dict, repr=False)
    older: dict = field(default_factory=dict, repr=False)

    def margins(self, words: list[bytes]) -> np.ndarray:
        """Decision of the machine for each word."""
        if not words:
            return np.zeros(0)
        r, c, w = subsequences(words)
        return np.bincount(r, w * self.table[c], len(words)) + self.bias

    def worst(self, texts: list[str]) -> np.ndarray:
        """Decision for each text: the weighted sum of its largest margins and its share of insults."""
        return self.tops(texts) @ self.slopes

    def tops(self, texts: list[str]) -> np.ndarray:
        """The ``WORST`` largest margins among the distinct words of each text, ``EMPTY`` for those it lacks, and
        how many of ``PER_WORDS`` distinct words have a margin above zero, each counting up to one."""
        units = [words_of(t) for t in texts]
        known = self.known
        new = [w for w in set().union(*units).difference(known)]
        fresh = []
        for w in new:
            got = self.older.get(w)
            if got is None:
                fresh.append(w)
            else:
                known[w] = got
        cut, owner = [], []
        for i, w in enumerate(fresh):
            for p in pieces(letters(w)):
                if len(p) >= 3:
                    cut.append(p)
                    owner.append(i)
        best = np.full(len(fresh), EMPTY)
        for at in range(0, len(cut), 4096):
            np.maximum.at(best, owner[at : at + 4096], self.margins(cut[at : at + 4096]))
        known.update(zip(fresh, best.tolist(), strict=True))
        out = np.full((len(units), WORST + 1), EMPTY)
        for i, u in enumerate(units):
            margins = sorted(map(known.__getitem__, u), reverse=True)
            out[i, : min(WORST, len(margins))] = margins[:WORST]
            hits = sum(min(m, 1.0) for m in takewhile(lambda m: m > 0, margins))
            out[i, WORST] = min(PER_WORDS * hits / max(len(margins), FEW), MOST_HITS)
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        """Calibrated probability of label one."""
        return 1 / (1 + np.exp(-np.clip(decision + self.offset, -30, 30)))


def _with_noise(word: bytes) -> list[bytes]:
    """A word with a letter put in at two places, and with one doubled."""
    k, x = max(1, len(word) // 2), bytes([24])
    return [word[:k] + x + word[k:], word[: k - 1] + x + word[k - 1 :], word[:k] + word[k - 1 :]]


def _fit_words(bad: list[tuple[bytes, int]], good: dict[bytes, int], landmarks: int) -> tuple[np.ndarray, float]:
    """Table and bias of the machine for words with their numbers of toxic and clean documents."""
    clean = sorted(good)
    marks = [w for w, _ in bad[: landmarks * 3 // 4]]
    marks += clean[:: max(1, len(clean) * 4 // landmarks)][: landmarks - len(marks)]
    base = dense(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3))  # the Nyström map is k(word, landmarks) @ root
    project = (base.T @ root).astype(np.float32)
    noisy = [(v, n / 4) for w, n in bad[:100] for v in _with_noise(w)]
    everything = [w for w, _ in bad + noisy] + clean
    x = np.concatenate([dense(everything[i : i + 512]) @ project for i in range(0, len(everything), 512)])
    share = np.array([n for _, n in bad + noisy], float)
    other = np.sqrt([good[w] for w in clean])
    weight = np.r_[0.5 * share / share.sum(), 0.5 * other / other.sum()].astype(np.float32)
    y = np.r_[np.ones(len(share)), -np.ones(len(clean))]
    w, bias = fit_svm(x, y, cost=300.0, steps=400, weight=weight)
    return (project @ w).astype(float), bias


def _worst_words(words: DataFrame, model: ToxicityModel, limit: int) -> dict[bytes, int]:
    """The ``limit`` words of largest margin, each with its ``good``."""
    out = T.StructType.fromDDL("word binary, good long, margin double")

    def work(batches):
        for batch in batches:
            margins = model.margins(batch.column("word").to_pylist())
            yield record([batch.column("word"), batch.column("good"), pa.array(margins, type=pa.float64())], out)

    scored = map_arrow(words, ["word", "good"], out, work, rows=4096)
    return {bytes(r.word): r.good for r in scored.orderBy(F.col("margin").desc(), "word").limit(limit).collect()}


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    positive_words: int = POSITIVE_WORDS,
    negative_words: int = NEGATIVE_WORDS,
    landmarks: int = LANDMARKS,
) -> ToxicityModel:
    """Fit on at most ``rows`` labelled texts (sentences or documents) that aren't held out.

    Labels belong to texts, so words get theirs by a multiple-instance rule: a word that toxic
    texts hold far more often than others is an insult, words of clean texts aren't.  Counts per
    word are aggregated by Spark; at most ``positive_words`` insults and one and a quarter times ``negative_words``
    ordinary words reach the driver, and ``landmarks`` of them span the space of the machine.
    """
    nothing = ToxicityModel(np.zeros(SYMBOLS**3), EMPTY, offset=-5.0)
    sample = labelled_sample(docs, labels, "toxic", rows, ~held_out())
    # copies of one toxic document would make all of its words look like insults
    sample = sample.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("key")).agg(
        F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"), F.max("__y").alias("__y")
    ).drop("key")
    sample = spool(sample)
    n_bad, n_all = sample.agg(F.count_if(F.col("__y") > 0), F.count(F.lit(1))).first()
    if not n_bad or n_bad == n_all:
        return nothing
    out = T.StructType.fromDDL("word binary, y int")

    def words(batches):
        for batch in batches:
            y = batch.column("__y").to_pylist()
            got = [(p, k) for t, k in zip(text_rows(batch), y, strict=True) for p in {q for w in words_of(t) for q in pieces(letters(w)) if len(q) >= 3}]
            yield record([[a for a, _ in got], [int(b > 0) for _, b in got]], out)

    counted = map_arrow(sample, ["text", "__y"], out, words).groupBy("word").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    # a bounded table: few partitions, as each sends its own best words to the driver
    counted = spool(counted.withColumn("good", F.col("n") - F.col("bad")).coalesce(PARTITIONS))
    # how much likelier the counts of a word are at its own rate than at the overall one
    own, base = F.col("bad") / F.col("n"), n_bad / n_all
    gain = F.col("bad") * F.log(own / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - own) / (1 - base))).otherwise(0.0)
    bad = counted.where(own > max(2 * base, 0.5)).where(gain >= EVIDENCE).orderBy(gain.desc(), "word").limit(positive_words).collect()
    clean = counted.where("good >= 1 and bad <= good")
    some = clean.orderBy(F.xxhash64("word"), "word").limit(negative_words // 2).collect()
    usual = clean.orderBy(F.col("good").desc(), "word").limit(negative_words // 4).collect()
    bad = [(bytes(r.word), r.bad) for r in bad]
    good = {bytes(r.word): r.good for r in [*some, *usual]}
    if not bad or not good:
        return nothing
    table, bias = _fit_words(bad, good, landmarks)
    for _ in range(HARD_ROUNDS):  # the clean words that look worst so far are learnt from as well
        good |= _worst_words(clean.select("word", "good"), ToxicityModel(table, bias), negative_words // 4)
        table, bias = _fit_words(bad, good, landmarks)
    model = ToxicityModel(table, bias)
    got = _margins(sample.select("doc_id", "text", "__y"), model, ["__y"]).toPandas()
    model.slopes, model.offset = fit_joint(np.stack(got["margins"]), got["__y"].to_numpy())
    return model


def _margins(docs: DataFrame, model: ToxicityModel, extra: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in extra), T.StructField("margins", T.ArrayType(T.DoubleType()))])

    def work(batches):
        for batch in batches:
            rest = [batch.column(c) for c in extra]
            yield record([batch.column("doc_id").cast(pa.int64()), *rest, shared.value.tops(text_rows(batch)).tolist()], out)

    return map_arrow(docs, ["doc_id", "text", *extra], out, work)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every whole text.

    A null or empty text has the score of margins ``EMPTY``.  Rows come out as often as they go in;
    columns other than ``doc_id`` and ``text`` take no part.
    """
    decision = sum((F.lit(float(a)) * F.col("margins")[i] for i, a in enumerate(model.slopes)), F.lit(model.offset))
    score = 1 / (1 + F.exp(-decision))
    scored = _margins(docs, model, []).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
