"""Language identification in two levels.

Linear support vector machines over byte trigrams choose the language family first; within the family,
one machine for each pair of languages votes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, map_arrow, record, text_rows
from .svm import fit_svm

#: Documents that a fit takes at most.
SAMPLE_ROWS = 4000
BUCKETS = 4096
#: Families of languages by ISO 639-1 code; any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "indic": "hi bn ur pa gu mr ne si",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of the lower-cased whole text: a unit vector."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):  # in blocks, for long texts
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        code = ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761)
        counts += np.bincount(code >> 20, minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    """Family machines (one against the rest) and, by family, the machines of its pairs."""

    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_w: dict[str, np.ndarray]
    pair_b: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score of one trigram vector."""
        sure = lambda m: float(1 / (1 + np.exp(-4 * m)))
        if not self.families:
            return "und", 0.0
        margins = self.family_w @ x + self.family_b
        k = int(margins.argmax())
        family, score = self.families[k], sure(margins[k]) if len(margins) > 1 else 1.0
        names = self.languages[family]
        if len(names) == 1:
            return names[0], score
        m = self.pair_w[family] @ x + self.pair_b[family]
        votes, least = np.zeros(len(names)), np.full(len(names), np.inf)
        for (i, j), v in zip(self.pairs[family], m, strict=True):
            votes[i] += v > 0
            votes[j] += v <= 0
            least[i], least[j] = min(least[i], v), min(least[j], -v)
        best = max(range(len(names)), key=lambda i: (votes[i], least[i]))
        return names[best], score * sure(least[best])


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``rows`` documents that aren't held out and have a language."""
    sample = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", rows, ~held_out())
    schema = T.StructType.fromDDL("doc_id long, lang string, codes binary, shares binary")

    def work(batches):
        for batch in batches:
            vectors = [trigrams(x) for x in text_rows(batch)]
            codes = [v.nonzero()[0].astype(np.uint16).tobytes() for v in vectors]
            shares = [v[v > 0].tobytes() for v in vectors]
            yield record([batch.column("doc_id").cast(pa.int64()), batch.column("__y").cast(pa.string()), codes, shares], schema)

    got = map_arrow(sample, ["doc_id", "text", "__y"], schema, work).collect()
    got.sort(key=lambda r: (r.doc_id, r.lang))
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.codes, dtype=np.uint16)] = np.frombuffer(r.shares, dtype=np.float32)
    lang = np.array([r.lang for r in got], dtype=object)
    by_family: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        by_family.setdefault(FAMILY_OF.get(name, name), []).append(name)
    families = sorted(by_family)
    of = np.array([families.index(FAMILY_OF.get(name, name)) for name in lang])
    fitted = [fit_svm(x, np.where(of == k, 1, -1)) for k in range(len(families))]
    pairs = {f: list(combinations(range(len(names)), 2)) for f, names in by_family.items()}
    pair_w, pair_b = {}, {}
    for f, names in by_family.items():
        machines = []
        for i, j in pairs[f]:
            own = (lang == names[i]) | (lang == names[j])
            machines.append(fit_svm(x[own], np.where(lang[own] == names[i], 1, -1)))
        if machines:
            pair_w[f], pair_b[f] = np.stack([w for w, _ in machines]), np.array([b for _, b in machines])
    stacked = np.stack([w for w, _ in fitted]) if fitted else np.zeros((0, BUCKETS))
    return LanguageModel(families, stacked, np.array([b for _, b in fitted]), by_family, pairs, pair_w, pair_b)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0.  Rows come out as often as they go
    in; ``lang`` and other columns take no part in a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType.fromDDL("doc_id long, lang_pred string, score double")

    def work(batches):
        for batch in batches:
            got = [shared.value.predict(trigrams(x)) if _LETTER.search(x) else ("und", 0.0) for x in text_rows(batch)]
            yield record([batch.column("doc_id").cast(pa.int64()), [a for a, _ in got], [b for _, b in got]], out)

    found = map_arrow(docs, ["doc_id", "text"], out, work)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
