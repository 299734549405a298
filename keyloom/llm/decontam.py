"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers, names and units become typed placeholders; windows of the resulting templates are hashed and
joined with those of the benchmark.  Where a placeholder's values differ between the two texts, one and
the same value must always stand for the same other value: then the question was re-parameterised.
Items without a window of enough literal words (short ones, lists of numbers or names) are looked for by
their words as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, spool

#: Words in a window (a power of two), and how many of them must not be placeholders.
WINDOW, LITERALS = 8, 5
#: Share of an item's windows, on one diagonal, from which a document counts as contaminated, and a number of
#: windows that is enough whatever the share.
COVERED, ENOUGH = 0.2, 32
#: Words from which a short item may stand anywhere in a text; of a shorter one the text must be a copy.
FEWEST = 4
#: Benchmark windows up to which the benchmark is broadcast (a hash and two integers each).
BROADCAST_WINDOWS = 1_000_000
#: Unit words that become a placeholder when they stand alone.
UNITS = (
    "km kg cm mm mg ml kwh mph kmh lb lbs oz ft mile miles meter meters metre metres gram grams kilogram kilograms "
    "liter liters litre litres hour hours minute minutes second seconds day days week weeks month months year years "
    "dollar dollars euro euros pound pounds cent cents percent degree degrees"
).split()
NUM, NAME, UNIT = "\u0001", "\u0002", "\u0003"
_MARKS = "_.,;:!?\"'()[]{}«»„“”‘’*&$#%|<>"


def raw_words(text: Column) -> Column:
    """Words of a text as they stand, without those that are marks alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.translate(w, _MARKS, "") != "")


def template(text: Column) -> Column:
    """Template words, one for each word of ``raw_words``.

    Placeholders go in by passes over the whole text.  A name is a capitalised word that doesn't begin a
    sentence; words in capitals throughout aren't names, so shouted copies match.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}[\p{L}'-]*", NAME)
    t = F.regexp_replace(t, r"\d+(?:[.,:/]\d+)*", NUM)
    t = F.lower(F.translate(t, _MARKS, ""))
    t = F.regexp_replace(t, r"(?<=\x01 )(?:" + "|".join(UNITS) + r")(?![\p{L}])", UNIT)
    return F.split(F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")), " ")


def plain_words(text: Column) -> Column:
    """Words as they are but for case and marks."""
    return F.transform(raw_words(text), lambda w: F.lower(F.translate(w, _MARKS, "")))


def window_hashes(words: Column) -> Column:
    """Hash of the ``WINDOW`` words from each place on.

    Words are hashed once; hashes of two, four and eight words come from pairs of shorter ones.  Each step binds
    the one before as a variable, so that nothing is computed twice.
    """
    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def pairs(h, width):
        n = F.greatest(F.size(h) - width, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))

    def doubled(h, width):
        return h if width == WINDOW else bind(pairs(h, width), lambda wider: doubled(wider, 2 * width))

    return bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: doubled(h, 1))


def windows(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, h): position and hash of every template window."""
    return df.select(*key, F.posexplode(window_hashes(template(F.col("text")))).alias("at", "h"))


def plain_windows(df: DataFrame, key: list[str], sizes: list[int]) -> DataFrame:
    """(key, at, h): position and hash of every window of ``sizes`` words; below ``FEWEST``, of whole texts only."""
    words = df.select(*key, plain_words(F.col("text")).alias("w"))

    def of_size(m):
        n = F.size("w") - m + 1
        fits = (n > 0) if m >= FEWEST else (n == 1)
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.lit(m), F.slice("w", i, m)).alias("h")))
        return F.when(fits, hashes).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))

    return words.select(*key, F.explode(F.concat(*map(of_size, sizes))).alias("x")).select(*key, "x.at", "x.h")


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, j, m, h, n_windows): windows with enough literal words, and those of items that have none of them."""
    items = benchmark.where("item_id is not null and text is not null").dropDuplicates(["item_id"]).select("item_id", "text")
    w = items.select("item_id", template(F.col("text")).alias("w"))
    w = w.select("item_id", "w", F.posexplode(window_hashes(F.col("w"))).alias("j", "h"))
    literal = F.size(F.filter(F.slice("w", F.col("j") + 1, WINDOW), lambda x: ~x.rlike("[\x01\x02\x03]")))
    w = w.where(literal >= LITERALS).select("item_id", "j", F.lit(WINDOW).alias("m"), "h")
    rich = spool(w.join(w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows")), "item_id"))
    p = items.join(rich.select("item_id").distinct(), "item_id", "left_anti").select("item_id", plain_words(F.col("text")).alias("w"))
    p = p.where(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(WINDOW))).withColumn("n_windows", (F.size("w") - F.col("m") + 1).cast("long"))
    p = p.select("item_id", "w", "m", "n_windows", F.explode(F.sequence(F.lit(1), F.col("n_windows").cast("int"))).alias("i"))
    return rich, spool(p.select("item_id", (F.col("i") - 1).alias("j"), "m", F.xxhash64("m", F.slice("w", F.col("i"), F.col("m"))).alias("h"), "n_windows"))


def _diagonals(found: DataFrame, bench: DataFrame) -> DataFrame:
    """Windows of documents that are windows of items, by document, item and diagonal, where they are enough."""
    small = bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = found.join(F.broadcast(bench) if small else bench, "h")
    found = found.groupBy(*KEY, "item_id", (F.col("at") - F.col("j")).alias("start")).agg(
        F.collect_set("j").alias("js"), F.first("m").alias("m"), F.first("n_windows").alias("n_windows")
    )
    found = found.withColumn("n_matched", F.size("js").cast("long"))
    return found.where(F.col("n_matched") >= F.least(F.lit(ENOUGH), F.greatest(F.lit(1), F.ceil(COVERED * F.col("n_windows")))))


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``contaminated`` with the keys of ``keyed`` for the document."""
    rich, plain = benchmark_windows(benchmark)
    texts = keyed(docs.select("doc_id", "text").where("text is not null")).select("doc_id", *KEY, "text")
    found = _diagonals(windows(texts, KEY), rich)
    sizes = sorted(r.m for r in plain.select("m").distinct().collect())  # WINDOW of them at most
    if sizes:
        found = found.unionByName(_diagonals(plain_windows(texts, KEY, sizes), plain))
    diagonal = F.struct("start", "m", "n_windows", "n_matched", "js")
    best = spool(found.groupBy(*KEY, "item_id").agg(F.collect_list(diagonal).alias("diagonals")))
    # values of both texts, for the few documents that matched
    own = texts.join(best.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    own = own.select("doc_id", *KEY, raw_words(F.col("text")).alias("dw"), template(F.col("text")).alias("dt"))
    theirs = benchmark.select("item_id", raw_words(F.col("text")).alias("iw"), template(F.col("text")).alias("it"))
    both = best.join(own, KEY).join(theirs.dropDuplicates(["item_id"]), "item_id")
    at = lambda a, k: F.try_element_at(F.col(a), k)

    def slots(c):
        """Values of an item's words with a placeholder that the document has at the same place, where windows matched."""
        covered = F.array_distinct(F.flatten(F.transform(c.js, lambda j: F.sequence(j + 1, j + c.m))))
        place = lambda k: F.greatest((k + c.start).cast("int"), F.lit(1))
        pairs = F.transform(
            covered,
            lambda k: F.when(
                at("it", k).rlike("[\x01\x02\x03]") & (at("it", k) == at("dt", place(k))),
                F.struct(
                    F.lower(F.translate(at("iw", k), _MARKS, "")).alias("i"),
                    F.lower(F.translate(at("dw", place(k)), _MARKS, "")).alias("d"),
                ),
            ),
        )
        return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))

    # a row for each diagonal, without the texts
    checked = F.transform("diagonals", lambda c: F.struct(c.start.alias("start"), c.n_windows.alias("n_windows"), c.n_matched.alias("n_matched"), slots(c).alias("p")))
    ids = ["doc_id", *KEY, "item_id"]
    both = both.select(*ids, checked.alias("checked")).select(*ids, F.explode("checked").alias("c")).select(*ids, "c.*")
    values = F.size("p")
    consistent = (F.size(F.array_distinct(F.col("p.i"))) == values) & (F.size(F.array_distinct(F.col("p.d"))) == values)
    changed = F.size(F.filter("p", lambda p: p.i != p.d))
    every = both.select(
        *ids, "start", "n_windows", "n_matched",
        changed.alias("n_slots"), consistent.alias("consistent"),
        ((F.col("n_matched") == F.col("n_windows")) & (changed == 0)).alias("verbatim"),
    )
    row = F.struct("start", "n_windows", "n_matched", "n_slots", "consistent", "verbatim")
    best = every.groupBy(*ids).agg(F.max_by(row, F.struct("consistent", "n_matched", -F.col("start"))).alias("b"))
    return best.select(*ids, "b.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of document and benchmark item that share a passage.

    Returns ``doc_id``, ``item_id``, ``start`` (word of the document where the item's first word would
    stand), ``n_windows`` (of the item), ``n_matched``, ``n_slots`` (different placeholder values),
    ``consistent`` and ``verbatim``.  Values are compared where windows matched, on every
    diagonal that reaches the threshold.  One row is the best diagonal of a pair: a consistent one if there
    is any, then the one of most windows, then the first; ``consistent`` is false where the values contradict
    each other, and such a row isn't contamination.  Items of fewer words than a window, and those with no
    window of enough literal words, match by their words as they are; below ``FEWEST`` words an item
    matches only a text that is nothing else.  A null or empty text or item matches nothing; rows that repeat id
    and text count once, different texts under one id each give rows, and null ids are ids; empty tables give
    no rows; other columns are ignored.
    """
    return _matches(docs, benchmark).drop(*KEY)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those that hold a benchmark passage consistently; all columns are kept.

    What counts is the text of a row, so other texts under the same id stay; null and empty texts stay, and
    repeated rows stay or go together.
    """
    hits = _matches(docs, benchmark).where("consistent").select(*KEY).distinct()
    return keyed(docs).join(hits, KEY, "left_anti").select(*docs.columns)
