"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a text come from one pass over its words and bytes.  The trees are fitted here, on a
bounded sample of labelled documents, with monotone constraints on chosen statistics, and flattened
into node arrays, so that a batch of documents is scored with a few numpy look-ups per level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, map_arrow, record, text_rows

SYMBOLS = "#*$%&|<>"
#: Labelled documents that a fit takes at most.
SAMPLE_ROWS = 12_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, and the direction in which the verdict may move with each
#: (-1: more of it never makes a document better, 0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "digit_ratio": -1,
    "upper_ratio": 0,
    "unique_ratio": 0,
    "words_per_line": 0,
    "stop_ratio": 0,
    "sentence_ratio": 0,
    "longest_word": 0,
}
#: Very common function words of four languages.
STOP = frozenset(
    "the of and to in a is that for it was with as on be at by are die der und das ist nicht mit von zu den "
    "le la les de des et en un une est que du pour dans el los las y se del por con para su al no".split()
)
_SPACE = bytes([32, 9, 10, 11, 12, 13])
_CLASS = np.zeros((256, 4))
_CLASS[list(SYMBOLS.encode()), 0] = 1
_CLASS[list(b"0123456789"), 1] = 1
_CLASS[list(range(65, 91)), 2] = 1
_CLASS[list(b".!?"), 3] = 1


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    cover = np.zeros(len(words), dtype=bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    symbols, digits, uppers, stops = (counts @ _CLASS).tolist()
    chars = len(text) - int(counts[list(_SPACE)].sum())
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else [text] * bool(n)
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    unique = set(words)
    per, letters = max(n, 1), max(chars, 1)
    tally = sum(w.decode() in STOP for w in unique)
    return [n, chars, int(symbols), dup, repeat], [
        float(np.log1p(n)),
        chars / per,
        symbols / letters,
        dup / max(len(lines), 1),
        repeat / per,
        digits / letters,
        uppers / letters,
        len(unique) / per,
        n / max(len(lines), 1),
        tally / max(len(unique), 1),
        stops / per,
        float(max(map(len, unique), default=0)),
    ]


@dataclass
class FlatTrees:
    """Trees of equal depth bound as node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label one for each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x, y, monotone, rounds=60, depth=4, rate=0.15, bins=48, least=12, ridge=1.0) -> FlatTrees:
    """Logistic gradient boosting on binned features.

    A split on a constrained feature is taken only if its two leaf values keep the direction, and the
    midpoint bounds all leaves below either side, so the whole tree is monotone in that feature.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    marks = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, f], marks)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    margin, nodes, roots = np.full(len(y), base), [], []

    def grow(rows, level, low, high):
        me, g, h = len(nodes), grad[rows], hess[rows]
        leaf = float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * leaf])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + ridge)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = coded[rows, f]
                gl = np.cumsum(np.bincount(k, g, len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(k, h, len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), (f, b, float(vl[b] + vr[b]) / 2))
        if best[1] is None:
            margin[rows] += rate * leaf
            return me
        f, b, middle = best[1]
        side = coded[rows, f] <= b
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[monotone[f]]
        nodes[me][:2] = [f, float(cuts[f][b])]
        nodes[me][2] = grow(rows[side], level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~side], level + 1, *bounds[1])
        return me

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    f, t, left, right, v = zip(*(nodes or [[0, np.inf, 0, 0, 0.0]]), strict=True)
    asint = lambda a: np.array(a, dtype=np.int64)
    return FlatTrees(asint(f), np.array(t), asint(left), asint(right), np.array(v), asint(roots or [0]), depth, base)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FlatTrees:
    """Fit the trees on at most ``rows`` labelled documents.

    Without labelled documents the trees keep everything.  Only statistics reach the driver.
    """
    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", "text", "__y")
    schema = T.StructType.fromDDL("features array<double>, y int")

    def work(batches):
        for batch in batches:
            feats = [statistics(x)[1] for x in text_rows(batch)]
            yield record([feats, batch.column("__y").cast(pa.int32())], schema)

    got = map_arrow(sample, ["text", "__y"], schema, work).toPandas()
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T)  # the fit doesn't depend on the order of arrival
    y = got["y"].to_numpy(dtype=float)[order]
    if not len(y):
        return fit_trees(np.zeros((0, len(FEATURES))), y, list(FEATURES.values()))
    return fit_trees(x[order], y, list(FEATURES.values()))


def quality_rules(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and the verdict ``kept`` of every whole text.

    A null or empty text has no words and fails the base rule.  Rows come out as often as they go in;
    columns other than ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType.fromDDL(
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, score double, kept boolean"
    )

    def work(batches):
        for batch in batches:
            got = [statistics(x) for x in text_rows(batch)]
            base = np.array([a for a, _ in got], dtype=np.int64).reshape(-1, len(BASE))
            score = shared.value.score(np.array([b for _, b in got]).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            cols = [pa.array(base[:, i]) for i in range(len(BASE))]
            kept = pa.array(~failed & (score >= threshold))
            yield record([batch.column("doc_id").cast(pa.int64()), *cols, pa.array(failed), pa.array(score), kept], out)

    return map_arrow(docs, ["doc_id", "text"], out, work)


def keep_good(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns; nothing is shuffled.

    Each row is judged by its text alone: null and empty texts go, as they have no words; repeated rows, null ids
    and repeated ids are judged like any other; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            got = [statistics(x) for x in text_rows(batch)]
            base = np.array([a for a, _ in got], dtype=np.int64).reshape(-1, len(BASE))
            score = shared.value.score(np.array([b for _, b in got]).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array((base[:, 0] >= 50) & (100 * base[:, 4] <= 50 * base[:, 0]) & (score >= threshold)))

    return map_arrow(docs, docs.columns, docs.schema, work)
