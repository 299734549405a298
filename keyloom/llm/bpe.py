"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding can end with: the vocabulary
entry that is a suffix of the prefix, and that is compatible with the last token of what precedes it.
A suffix-matching automaton lists the candidates, the compatibility test is memoised, and walking the
back-pointers from the end gives the exact ids.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, record, text_rows

#: Fixed value: the pre-tokenizer's pattern, white space spelled out as the Unicode property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pieces of a generation of a worker's memory; it holds two, so frequent pieces stay.
REMEMBERED = 400_000
#: Characters of such pieces, in case they are long.
HELD_CHARS = 16_000_000
FOREVER = 1 << 40


def vocabulary() -> str:
    """Path of the default public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Encoded ids of pieces met so far; a new piece is looked up in the older generation or encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older, self.held = encode, older, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece.encode())).tobytes()
        self[piece] = ids
        self.held += len(piece)
        return ids


class PrefixBpe:
    """Encoder and decoder for a ``tokenizers`` JSON file of a byte-level BPE model."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        self.add_space = pre.get("add_prefix_space", False)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank[a, b] = r
            self.parts.setdefault(ids[self.bytes_of[a] + self.bytes_of[b]], (a, b, r))
        self.made = {pair: ids[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]] for pair in self.rank}
        self.base = [ids[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if self._is_whole(i):  # other entries of the vocabulary never come out of merging
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for x in spec.get("added_tokens", []):
            if x["lstrip"] or x["rstrip"] or x["single_word"]:
                raise ValueError("added tokens that eat their surroundings aren't supported")
            self.bytes_of[x["id"]] = x["content"].encode()
        names = sorted(self.special, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PIECES)
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.known = _Pieces(self.encode_piece, {})

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Edge tokens of ``token`` from its outer byte upwards, each with the rank that consumes it."""
        got = self.spines.get((token, right))
        if got is None:
            got, until, at = [], FOREVER, token
            while True:
                got.append((at, until))
                if at not in self.parts:
                    break
                a, b, r = self.parts[at]
                at, until = (b, r) if right else (a, r)
            got.reverse()
            self.spines[token, right] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two tokens."""
        got = self.fits.get(a << 32 | b)
        if got is None:
            left, right, i, j, got = self._spine(a, True), self._spine(b, False), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                r = self.rank.get((x, y))
                # a merge inside the left token comes first on a tie, as merges run from left to right
                if r is not None and r < x_until and r <= y_until:
                    got = False
                    break
                if x_until == FOREVER and y_until == FOREVER:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.fits[a << 32 | b] = got
        return got

    def _is_whole(self, token: int) -> bool:
        """Whether the bytes of a token, merged by rank, give the token itself."""
        seq = [self.base[b] for b in self.bytes_of[token]]
        while len(seq) > 1:
            r, k = min((self.rank.get((seq[k], seq[k + 1]), FOREVER), k) for k in range(len(seq) - 1))
            if r == FOREVER:
                break
            seq[k : k + 2] = [self.made[seq[k], seq[k + 1]]]
        return seq == [token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, fits = len(piece), self.fits
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:  # the last token of this prefix is found
                continue
            start = end - length
            if start:
                before = last[start]
                fit = fits.get(before << 32 | token)
                if not (self.compatible(before, token) if fit is None else fit):
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.added.split(text) if self.added else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if self.add_space and part and not part[0].isspace():
                part = " " + part
            out += map(self.known.__getitem__, self.pieces.findall(part))
            if len(self.known) >= REMEMBERED or self.known.held > HELD_CHARS:
                self.known.older = {}
                self.known = _Pieces(self.encode_piece, self.known)
                if len(self.fits) > 4 * REMEMBERED:
                    self.fits.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of encoded ids, added tokens included."""
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_MODELS: dict[str, PrefixBpe] = {}


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text of ``docs``.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file on the driver; its content (a few MB, a
    fixed size) is broadcast.  Returns ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit integers) and ``decoded``.  A null or empty text gives no ids and an empty text; repeated
    rows and null ids are kept; other columns are ignored.  A text is encoded piece by piece, so
    memory follows the longest text.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    out = T.StructType.fromDDL("doc_id long, n_tokens long, ids binary, decoded string")

    def work(batches):
        if vocabulary not in _MODELS:
            _MODELS[vocabulary] = PrefixBpe(shared.value)
        model = _MODELS[vocabulary]
        for batch in batches:
            ids = [model.encode(x) for x in text_rows(batch, text_col)]
            decoded = [model.decode(x) for x in ids]
            yield record([batch.column("doc_id").cast(pa.int64()), [len(x) // 4 for x in ids], ids, decoded], out)

    return map_arrow(docs, ["doc_id", text_col], out, work)


def digest(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded documents, a row for each; an empty or null text has the digests of no bytes."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
