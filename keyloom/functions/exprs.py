"""Column expressions: ranges, globs, numbers, score and member bounds, hash tags and slots."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
I64_MAX, I64_MIN = 2**63 - 1, -(2**63)


def col(x) -> Column:
    """A column from a name, or a literal from anything else."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def resolve_range(start: int, stop: int, n) -> tuple[Column, Column]:
    """Inclusive signed range as absolute (lo, hi) for length ``n``; empty where lo > hi."""
    n = col(n)
    at = lambda i: F.lit(i) if i >= 0 else n + i
    return F.greatest(at(start), F.lit(0)), F.least(at(stop), n - 1)


def string_range(start: int, stop: int, n) -> tuple[Column, Column]:
    """As ``resolve_range`` for bytes of strings: an end before the first byte is the first byte.

    Only a pair of negative offsets in falling order is empty from the outset.
    """
    n = col(n)
    lo, hi = resolve_range(start, stop, n)
    if start < 0 and stop < 0 and start > stop:
        return F.lit(1), F.lit(0)
    return lo, F.when(n == 0, -1).otherwise(F.greatest(hi, F.lit(0)) if stop < 0 else hi)


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``*``, ``?``, ``[a-z]``, ``[^a]`` and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            j, body = i + 1, []
            negate = j < len(pattern) and pattern[j] == "^"
            j += negate
            while j < len(pattern) and pattern[j] != "]":
                if pattern[j] == "\\" and j + 1 < len(pattern):
                    j += 1
                    body.append("\\" + pattern[j])
                elif pattern[j + 1 : j + 2] == "-" and j + 2 < len(pattern) and pattern[j + 2] != "]":
                    a, b = sorted((pattern[j], pattern[j + 2]))
                    body.append(f"{re.escape(a)}-{re.escape(b)}")
                    j += 2
                else:
                    body.append(re.escape(pattern[j]).replace("&", "\\&"))
                j += 1
            i = j
            out.append(f"[{'^' * negate}{''.join(body)}]" if body else ("." if negate else "(?!)"))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def glob_match(c, pattern: str) -> Column:
    """Whether a column matches a glob; a prefix glob becomes a range that scans can push down."""
    c = col(c)
    m = re.fullmatch(r"([^*?\[\\]+)\*?", pattern)
    if m and not pattern.endswith("*"):
        return c == pattern
    if m and ord(m[1][-1]) < 0x7F:
        return (c >= m[1]) & (c < m[1][:-1] + chr(ord(m[1][-1]) + 1))
    return c.rlike(glob_to_regex(pattern))


def canonical_int(c) -> Column:
    """A string as a 64-bit integer where it is written canonically, else null."""
    c = col(c).cast("string")
    return F.when(c.rlike(r"^(0|-?[1-9][0-9]*|-0)\z"), c.try_cast("bigint"))


def loose_int(c) -> Column:
    """An integer as options and ranges take it: leading zeros are fine, a plus sign or space isn't."""
    c = col(c).cast("string")
    return F.when(c.rlike(r"^-?[0-9]+\z"), c.try_cast("bigint"))


def parse_score(c) -> Column:
    """A string as a score; null for what isn't a number, NaN included."""
    c = F.lower(col(c).cast("string"))
    inf = F.when(c.rlike(r"^\+?inf(inity)?\z"), F.lit(float("inf"))).when(c.rlike(r"^-inf(inity)?\z"), F.lit(float("-inf")))
    return F.coalesce(inf, F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"), c.try_cast("double")))


def human_double(c) -> Column:
    """Shortest round-trip decimal of a double without exponent; -0 is 0."""
    c = col(c)
    text = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.", "")
    point = F.length(F.regexp_extract(text, r"^-?([0-9]+)", 1)) + F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    padded = F.rpad(mantissa, F.greatest(point, F.length(mantissa)), "0")
    plain = F.when(
        point > 0, F.concat(F.substring(padded, F.lit(1), point), F.lit("."), F.substring(padded, point + 1, F.lit(400)))
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), mantissa))
    plain = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    plain = F.regexp_replace(plain, r"^0+(?=[0-9])", "")
    sign = F.when((c < 0) & (plain != "0"), "-").otherwise("")
    return (
        F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c == 0, "0").otherwise(F.concat(sign, plain))
    )


def score_within(c, low: str | float, high: str | float) -> Column:
    """Score bounds as given to range commands: a number, ``(`` for exclusive, ``-inf`` and ``+inf``."""
    c = col(c)

    def bound(b, upper):
        text = str(b)
        open_, v = text.startswith("("), float(text.lstrip("("))
        if upper:
            return c < v if open_ else c <= v
        return c > v if open_ else c >= v

    return bound(low, False) & bound(high, True)


def lex_within(c, low: str, high: str) -> Column:
    """Member bounds: ``[`` inclusive, ``(`` exclusive, ``-`` and ``+`` without end."""
    c = col(c)

    def bound(b, upper):
        if b in ("-", "+"):
            return F.lit((b == "+") == upper)
        if b[0] not in "[(":
            raise ValueError("min or max not valid string range item")
        if upper:
            return c <= b[1:] if b[0] == "[" else c < b[1:]
        return c >= b[1:] if b[0] == "[" else c > b[1:]

    return bound(low, False) & bound(high, True)


def fnv1a(data) -> Column:
    """64-bit FNV-1a of bytes, as a signed long, in the JVM."""
    hexed = F.hex(col(data).cast("binary"))
    n = (F.length(hexed) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.lit("18446744073709551616").cast("decimal(38,0)")

    def step(h, i):
        mixed = h.bitwiseXOR(F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
        wide = F.pmod(F.pmod(mixed.cast("decimal(20,0)"), whole).cast("decimal(20,0)") * F.lit(1099511628211).cast("decimal(13,0)"), whole)
        return F.when(wide >= F.lit("9223372036854775808").cast("decimal(38,0)"), wide - whole).otherwise(wide).cast("bigint")

    return F.aggregate(places, F.lit(-3750763034362895579), step)


def hash_tag(key) -> Column:
    """What a key is hashed by: the text between the first brace and the next closing one, if any."""
    key = col(key)
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def crc16(data) -> Column:
    """CRC16/XMODEM of bytes, in the JVM: for each byte the eight steps folded into shifts."""
    hexed = F.hex(col(data).cast("binary"))
    bytes_ = F.transform(
        F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )

    def step(crc, b):
        x = F.shiftright(crc, 8).bitwiseXOR(b)
        x = x.bitwiseXOR(F.shiftright(x, 4))
        mixed = F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x)
        return mixed.bitwiseAND(F.lit(0xFFFF))

    return F.aggregate(bytes_, F.lit(0), step)


def key_slot(key) -> Column:
    """Cluster slot of a key."""
    return crc16(hash_tag(key)) % SLOTS


def slot_to_shard(slot, shards: int) -> Column:
    """Shard that owns a slot when contiguous ranges are dealt out evenly."""
    return F.floor(col(slot) * shards / SLOTS).cast("int")


def murmur64(data: bytes, seed: int = 0xADC83B19) -> int:
    """MurmurHash64A, the public algorithm of Austin Appleby, for sketch registers."""
    m, mask = 0xC6A4A7935BD1E995, (1 << 64) - 1
    h = (seed ^ (len(data) * m)) & mask
    whole = len(data) & ~7
    for i in range(0, whole, 8):
        k = int.from_bytes(data[i : i + 8], "little") * m & mask
        k = (k ^ (k >> 47)) * m & mask
        h = (h ^ k) * m & mask
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ (h >> 47)) * m & mask
    return h ^ (h >> 47)
