"""Text operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import bpe, common, decontam, langid, quality, queries, secrets, sharding, simhash, spans, suffixes, svm, toxicity

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40000 + "x" * 50000
EDGE = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "same text here"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (7, LONG), (8, "\n".join(["tie line"] * 30)), (9, "ünïcødé 字 😀 " * 20)]
OPS = ["op1_quality_rules", "op2_language_id", "op3_bpe", "op4_toxicity", "op5_sentence_spans", "op6_decontamination", "op7_simhash_dedup", "op8_secret_scan", "op9_suffix_dedup", "op10_sharding", "pipeline"]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def edge_dir(spark, path, rows):
    """A data folder with the given documents, extra columns of clashing names, and the other tables."""
    df = spark.createDataFrame([(i, t, "en" if t else None, None, len(t or "")) for i, t in rows], SCHEMA)
    df = df.withColumns({"score": F.lit("clash"), "h": F.lit(1), "fp": F.lit(2), "kept": F.lit("x"), "name": F.lit(None).cast("string")})
    df.write.parquet(f"{path}/documents.parquet")
    labels = [(i, (i or 0) % 2, (i or 0) % 3 == 0, None) for i, _ in rows]
    spark.createDataFrame([(i, q, int(t)) for i, q, t, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [(0, "one two three four five six seven eight nine ten"), (1, None), (None, "x"), (2, "")] if rows else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    return edge_dir(spark, tmp_path_factory.mktemp("edge"), EDGE)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return edge_dir(spark, tmp_path_factory.mktemp("none"), [])


@pytest.mark.parametrize("name", OPS)
def test_edges(spark, edge, nothing, name):
    run = queries.queries()[name]
    rows = run(spark, edge).collect()
    assert run(spark, nothing).count() == 0
    if name in ("op6_decontamination", "op8_secret_scan", "pipeline"):
        assert not rows  # no item, no candidate, and no text that the quality rules keep
        return
    texts, at = dict(EDGE), {}
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in EDGE)
    for r in rows:
        if name != "op10_sharding":
            assert at.setdefault(r.doc_id, r) == r  # repeated rows have equal results
        at[r.doc_id] = r
    nulls, sha = [at[None], at[1], at[2]], lambda t: hashlib.sha256(t.encode()).hexdigest()
    if name == "op1_quality_rules":
        assert all((r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False) for r in [*nulls, at[3]])
        assert (at[7].n_words, at[7].word_chars, at[7].n_repeat_words, at[7].kept) == (40001, 210000, 40000, False)
        assert (at[8].n_words, at[8].n_dup_lines, at[9].n_symbols) == (60, 29, 0)
    elif name == "op2_language_id":
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in [*nulls, at[3]]) and at[4].lang_pred == "en" and not at[None].held_out
    elif name == "op3_bpe":
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, sha(""), sha("")) for r in nulls)
        assert all(at[i].decoded_sha256 == sha(texts[i]) for i in (3, 4, 5, 6, 7, 8, 9)) and at[4].ids_sha256 == at[5].ids_sha256
    elif name == "op4_toxicity":
        assert len({(r.score, r.predicted) for r in nulls}) == 1 and all(0 <= r.score <= 1 for r in rows)
        assert at[4].score == at[5].score and all(r.predicted == (r.score >= 0.5) for r in rows)
    elif name == "op5_sentence_spans":
        assert [(at[i].n_removed, at[i].kept_sha256) for i in (None, 1, 2, 3, 4)] == [(0, sha(texts[i] or "")) for i in (None, 1, 2, 3, 4)]
        assert all((at[i].n_spans, at[i].n_chars_kept) == (1, 0) for i in (5, 6))  # later copies of a short text
        assert at[7].n_chars_kept < 60_000 and 0 < at[8].n_chars_kept < 280
    elif name == "op7_simhash_dedup":
        assert all((r.fingerprint, r.component_id) == ("0" * 16, 1) for r in [*nulls, at[3]]) and at[6].component_id == 4
    elif name == "op9_suffix_dedup":
        assert all((r.n_bytes, r.n_removed, r.n_spans) == (0, 0, 0) for r in nulls)
        assert (at[7].n_removed, at[7].n_spans, at[7].kept_sha256) == (250_000, 1, sha("")) and at[8].n_removed == at[4].n_removed == 0
    else:
        assert sorted(r.slot for r in rows if r.shard == at[5].shard)[:1] == [0] and all(r.size == 1 for r in nulls)
        assert len({at[i].shard for i in (4, 5, 6)}) == 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_quality_counts_and_verdict(spark, docs):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, D).collect()}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        cover = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r.base_failed == failed and (not failed or not r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    judged = [(labels[i] == 1, r.kept) for i, r in got.items() if i in labels and not r.base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.9


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) < 0.5).astype(float)
    model = quality.fit_trees(x, y, [-1, 0, 0], rounds=30)
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op2_language_id(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.95
    assert langid.LanguageModel([], np.zeros((0, 4)), np.zeros(0), {}, {}, {}, {}).predict(np.zeros(4)) == ("und", 0.0)


def test_bpe_is_exact(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    extra = ["<|endoftext|> a<|endoftext|>", "it's  we'LL x \x1c y", "é" * 300, "ab" * 999, "﻿​ 한국어 👩‍👩‍👧"]
    rng = random.Random(5)
    extra += ["".join(rng.choice("ab'sé \n\t1９字😀.") for _ in range(50)) for _ in range(300)]
    texts = dict(docs) | {10_000 + i: x for i, x in enumerate(extra)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.bpe_encode(df, bpe.vocabulary()).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    rows = docs.join(labels, "doc_id").where(common.held_out()).select("text", "toxic").collect()
    p = model.score(model.worst([r.text for r in rows]))
    y = np.array([r.toxic for r in rows])
    assert (p[y == 1] >= 0.5).mean() > 0.88 and (p[y == 0] < 0.5).mean() > 0.99
    clean, plain, gapped = model.worst(["the and of in", "you idiot", "you i-d-i-o-t"])
    assert plain > clean and gapped > clean and model.worst(["you idxiot"])[0] > clean
    assert 0 <= model.score(model.worst([""]))[0] < 0.5


def test_worst_words_are_weighed():
    rng = np.random.default_rng(3)
    x = np.sort(rng.standard_normal((400, 3)), axis=1)[:, ::-1]
    y = (x[:, 0] - x[:, 2] > 1.5).astype(float)  # the third margin speaks against the label
    slopes, offset = svm.fit_joint(x, y)
    assert (slopes >= 0).all() and slopes[2] == 0 and slopes[0] > 0
    y = (x[:, 0] + x[:, 1] > 1.5).astype(float)
    slopes, offset = svm.fit_joint(x, y)
    assert np.mean((x @ slopes + offset > 0) == (y > 0)) > 0.9
    for label in (0.0, 1.0):
        slopes, offset = svm.fit_joint(x, np.full(400, label))
        assert (slopes >= 0).all() and (offset > 0) == (label > 0)
    model = toxicity.ToxicityModel(np.zeros(toxicity.SYMBOLS**3), 0.5)
    assert model.tops(["", "abc", "abc abc", "abc def ghi jkl"]).tolist() == [[-1, -1, -1, 0], [0.5, -1, -1, 1.25], [0.5, -1, -1, 1.25], [0.5, 0.5, 0.5, 3]]


def brute_ends(text):
    """Words of a text without dense scripts or very long words, and where sentences end and runs start."""
    words = re.findall(r"\S+\s*", text)
    h = [xxhash.xxh64_intdigest(w.strip().lower().encode()) >> 32 for w in words]
    mark = [w.rstrip().rstrip("\"')]}’”»")[-1:] in list(".!?…") or bool(re.search("[\n\r\x85\u2028\u2029]", w[len(w.rstrip()) :])) for w in words]
    h = [-1 if m else x for x, m in zip(h, mark, strict=True)]

    def chosen(width):
        got = {len(words) - 1}
        for i in range(len(words) - width + 1):
            got.add(max(range(i, i + width), key=lambda k: (-h[k], k)))
        return got | {k for k, m in enumerate(mark) if m}

    return words, sorted(chosen(spans.PART)), chosen(spans.START)


def brute_runs(text):
    """(normalised text, first sentence, number of sentences) of every run."""
    words, ends, begun = brute_ends(text)
    if not words:
        return []
    plain = [w.strip().lower() for w in words]
    first = [0, *[e + 1 for e in ends[:-1]]]
    if len(words) < spans.RUN_WORDS:
        return [("whole " + " ".join(plain), 0, len(ends))]
    out, tail = set(), None
    for k, a in enumerate(first):
        if k and ends[k - 1] not in begun:
            continue
        stop = next((j for j in range(k + 1, len(ends)) if ends[j] + 1 - a >= spans.RUN_WORDS), None)
        if stop is not None:
            out.add((" ".join(plain[a : ends[stop] + 1]), k, stop - k + 1))
        if len(words) - a >= spans.RUN_WORDS:
            tail = (" ".join(plain[a:]), k, len(ends) - k)
    return [*out, *({tail} - out)]


def test_sentence_spans(spark, docs):
    texts = {i: t for i, t in docs.items() if not spans._DENSE_CHAR.search(t) and max(map(len, t.split()), default=0) <= spans.LONG_WORD}
    assert len(texts) > 0.8 * len(docs)
    first, found = {}, {i: brute_runs(texts[i]) for i in sorted(texts)}
    for i, own in found.items():
        for key, k, _ in own:
            first[key] = min(first.get(key, (i, k)), (i, k))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    removed = 0
    for r in spans.dedup_spans(df).collect():
        gone = {k + j for key, k, n in found[r.doc_id] if first[key] != (r.doc_id, k) for j in range(n)}
        words, ends, _ = brute_ends(texts[r.doc_id])
        assert r.n_removed == len(gone)
        kept = "".join("".join(words[a : e + 1]) for k, (a, e) in enumerate(zip([0, *[e + 1 for e in ends]], ends, strict=False)) if k not in gone)
        assert r.kept.strip() == kept.strip()
        removed += bool(gone)
        assert "".join(texts[r.doc_id][a:b] for a, b in spans.sentences(texts[r.doc_id])) == texts[r.doc_id] or not words
    assert removed > 10


def test_copies_go_and_common_lines_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    line, long, whole = "A line. That many texts. Share as it is.", some(55), some(80) + ". " + some(20) + "."
    rows = [(i, f"{some(40)} {long} {some(30)}") for i in range(3)] + [(10 + i, f"{some(30)}.\n{line}\n{some(40)}") for i in range(5)]
    rows += [(20, whole), (21, whole), (22, "One. Two. Three four five."), (23, "one. two. Three four  five."), (24, f"One. Two. Three four five. {some(40)}")]
    rows += [(30, None), (31, ""), (None, whole), (32, f"{whole} {whole}"), (40, some(60)), (40, some(60))]
    got = {}
    for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.n_removed == 0 for i in (0, 10, 11, 12, 13, 14, 20, 22, 24, 30, 31, 40) for r in got[i])
    assert all(len(dict(rows)[i]) - len(got[i][0].kept) > len(long) / 2 for i in (1, 2))
    assert got[21][0].kept == got[23][0].kept == got[None][0].kept == "" and len(got[32][0].kept) < 60 and len(got[40]) == 2


def test_runs_are_shuffled_once_however_common(spark, docs, monkeypatch):
    """Only runs found again are written, all are shuffled once, and dealing common runs in parts changes nothing."""
    written, spool = [], spans.spool

    def counted(df):
        written.append(spool(df))
        return written[-1]

    monkeypatch.setattr(spans, "spool", counted)
    rows = [*docs.items(), *((1000 + i, docs[0] + docs[1]) for i in range(40)), *((None, docs[i]) for i in range(3)), *[(5, docs[5])] * 3, (5, docs[6] + docs[5])]
    texts = common.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    texts = texts.select("text", F.col("__z").alias("z"), F.col("__d").alias("d"), F.col("__h").alias("h"))
    found = [(r.z, r.d, r.h, *k) for r in texts.collect() for k in zip(*map(np.ndarray.tolist, spans.runs(r.text)), strict=True)]
    least = {}
    for z, d, h, run, k, _ in found:
        least[run] = min(least.get(run, (z, d, h, k)), (z, d, h, k))
    want = Counter((d, h, k, n) for z, d, h, run, k, n in found if (z, d, h, k) != least[run])
    assert len(want) > 500
    for bounds in ((), (1, 2), (1, 20), (1, 10**6)):
        written.clear()
        got = spans.repeated_spans(texts, *bounds)
        assert Counter(map(tuple, got.collect())) == want
        assert sum(w.count() for w in written) < 0.8 * len(found)
        if bounds == (1, 10**6):
            assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1 and len(written) == 1


@pytest.mark.parametrize("kind", ["words", "one word", "uncut words", "han", "thai", "unspaced"])
def test_passages_without_marks_hold_a_run(kind):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    few = ["some", "of", "them"]
    make, n, join = {
        "words": (word, 51, " "),
        "one word": (lambda: few[0], 51, " "),
        "uncut words": (lambda: rng.choice(few), 51, " "),
        "han": (lambda: chr(rng.randint(0x4E00, 0x9F00)), 102, ""),
        "thai": (lambda: chr(rng.randint(0xE01, 0xE2E)), 102, ""),
        "unspaced": (lambda: rng.choice("abcdefghijklmnop"), 320, ""),
    }[kind]
    for _ in range(200):
        passage = join.join(make() for _ in range(n))
        around = [join.join(make() for _ in range(80)) for _ in range(4)]
        if kind == "one word":
            around = [" ".join(word() for _ in range(80)) for _ in range(4)]
        one, two = (join.join([around[i], passage, around[i + 1]]) for i in (0, 2))
        assert set(spans.runs(one)[0].tolist()) & set(spans.runs(two)[0].tolist())
    assert len(spans.sentences("第一句在这里。第二句也在这里。" * 3)) >= 6


def test_decontamination(spark):
    item = "If Alice buys 12 apples for 3 dollars each and Bob buys 12 pears, how many fruits does Alice own after 12 days of trade?"
    again = "so if Carol buys 15 apples for 4 dollars each and Dave buys 15 pears, how many fruits does Carol own after 15 days of trade? yes"
    wrong = "so if Carol buys 15 apples for 4 dollars each and Dave buys 99 pears, how many fruits does Carol own after 15 days of trade? yes"
    rows = [(1, "Before it. " + item), (2, again), (3, wrong), (4, "Nothing like it in this one, only other words that go on for a while."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and got[1].consistent and got[2].consistent and not got[3].consistent
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {3, 4, 5}
    plain = spark.createDataFrame([(9, "se raja de el dora, quemente asosa la luna y ueie, no esta dora mente del rio")], "item_id long, text string")
    loud = spark.createDataFrame([(1, "IS ANHA. SE RAJA DE EL DORA, QUEMENTE ASOSA LA LUNA Y UEIE, NO ESTA DORA MENTE DEL RIO AND MORE")], "doc_id long, text string")
    assert decontam.contaminated(loud, plain).where("consistent").count() == 1


def test_short_and_literal_poor_items(spark):
    numbers = "compute 12 + 45 + 78 and 9 * 3 + 5 - 7 then 100 / 4"
    bench = [(1, numbers), (2, "Name the capital of France"), (3, "yes"), (4, None), (5, "")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, f"so we {numbers} at last"), (2, "compute 7 + 8 and 9 * 33 + 51 - 72 then 13 / 9"), (3, "name the capital of France, now"), (4, "Yes."), (5, "yes it is"), (6, None), (7, ""), (None, numbers), (3, "other text under the same id as before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "h": F.lit(1)})
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).where("consistent").collect()} == {(1, 1), (3, 2), (4, 3), (None, 1)}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6, 7]


def test_decontamination_against_brute_force(spark, docs):
    """Every window of every text compared with every window of every item, by templates built word by word."""
    marks = str.maketrans("", "", "_.,;:!?\"'()[]{}«»„“”‘’*&$#%|<>")
    clean = lambda w: w.translate(marks)

    def template(text):
        out, raw = [], [w for w in re.split(r"[\x20\x09-\x0D]+", text) if clean(w)]
        t = regex.sub(r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}[\p{L}'-]*", "\2", text)
        t = re.sub(r"[0-9]+(?:[.,:/][0-9]+)*", "\1", t)
        for w in re.split(r"[\x20\x09-\x0D]+", t):
            w = clean(w).lower()
            if w:
                unit = regex.match(r"(?:" + "|".join(decontam.UNITS) + r")(?!\p{L})", w) if out and out[-1].endswith("\1") else None
                out.append(w if not unit else "\3" + w[unit.end() :])
        return [clean(w).lower() for w in raw], out

    items = {r.item_id: template(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    where = {}
    for i, (_, t) in items.items():
        for j in range(len(t) - 7):
            if sum(not re.search("[\1\2\3]", w) for w in t[j : j + 8]) >= 5:
                where.setdefault(tuple(t[j : j + 8]), []).append((i, j))
    sizes = Counter(i for v in where.values() for i, _ in v)
    want = {}
    for d, text in docs.items():
        raw, t = template(text)
        hits = {}
        for a in range(len(t) - 7):
            for i, j in where.get(tuple(t[a : a + 8]), ()):
                hits.setdefault((i, a - j), set()).add(j)
        for (i, start), js in hits.items():
            if len(js) < min(32, max(1, -(-sizes[i] // 5))):
                continue
            iraw, it = items[i]
            places = {j + k for j in js for k in range(8)}
            pairs = {(iraw[k], raw[k + start]) for k in places if re.search("[\1\2\3]", it[k]) and 0 <= k + start < len(t) and it[k] == t[k + start]}
            good = len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})
            want[d, i] = want.get((d, i), False) or good
    got = {(r.doc_id, r.item_id): r.consistent for r in queries.op6_decontamination(spark, D).collect()}
    assert got == want and any(got.values())


def test_every_diagonal_is_checked(spark):
    item = "If Alice buys 12 apples for 3 dollars each and Bob buys 12 pears, how many fruits does Alice own after 12 days of trade?"
    wrong = "so if Carol buys 15 apples for 4 dollars each and Dave buys 99 pears, how many fruits does Carol own after 15 days of trade? yes"
    part = "they saw him 77 times there near a lake with old red 55 boats, how many fruits does Alice own after 12 days of trade?"
    rows = [(1, f"{wrong} And then: {item}"), (2, wrong), (3, part)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect()}
    assert len(got) == decontam.contaminated(docs, bench).count()
    assert got[1].consistent and got[1].verbatim and not got[2].consistent and got[3].consistent


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs):
    ids = sorted(docs)
    fps = [brute_simhash(docs[i]) for i in ids]
    roots = brute_components(fps)
    got = {r.doc_id: r for r in queries.op7_simhash_dedup(spark, D).collect()}
    for i, fp, root in zip(ids, fps, roots, strict=True):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == ids[root]


@pytest.mark.parametrize("pairwise", [1024, 2])
def test_links_of_crowds(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(df)).collect()}
    key = lambda f: int(np.uint64(f).astype(np.int64))
    want = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = roots.get(key(fps[i]), key(fps[i])) == roots.get(key(fps[j]), key(fps[j]))
            assert same == (want[i] == want[j])


def test_keep_first_loses_no_document(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red orange yellow green blue indigo violet")
    rows = [(None, a), (None, b), (5, a), (7, c), (7, c), (7, "quite another text under the same id"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "least": F.lit(2)})
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, b), (5, a), (7, c), rows[5], (8, "")])


def test_text_passes_leave_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, "x" * 10) for i in range(1000)], "doc_id long, text string").coalesce(1)
    out = T.StructType.fromDDL("n long")
    sizes = common.map_arrow(df, ["text"], out, lambda bs: (common.record([[b.num_rows]], out) for b in bs), rows=300)
    assert spark.conf.get(name) == before and [r.n for r in sizes.collect()] == [300, 300, 300, 100]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_secrets(spark):
    rng = random.Random(1)
    aws = "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16))
    pw, tok = "18a0165473c0330cab", "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(1, f"the key is {aws} now"), (2, f"so password={pw} here"), (3, f'a token = "{tok}" there'), (4, f"see commit {tok} in the log"), (5, "https://www.site.org/a/long/path/page/2024/index"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    forest = secrets.fit_secrets(spark)
    got = {(r.doc_id, r.secret): r.is_secret for r in secrets.find_secrets(docs, forest).collect()}
    assert got[1, aws] and got[2, pw] and got[3, tok] and not got[4, tok] and not any(v for (i, _), v in got.items() if i == 5)
    clean = {r.doc_id: r for r in secrets.redact(docs, forest).collect()}
    assert clean[2].text == "so password=<SECRET> here" and clean[2].n_chars == len(clean[2].text)
    assert clean[4].text == rows[3][1] and clean[6].text is None
    held = secrets.labelled_findings(300, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    found = {r.doc_id: r.is_secret for r in secrets.find_secrets(df, forest).collect()}
    assert np.mean([found[i] == bool(y) for i, (_, y) in enumerate(held) if i in found]) > 0.95


def test_every_run_of_a_word_is_a_candidate(spark):
    rng = random.Random(5)
    mix = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789") for _ in range(k))
    tok, aws, a, b, c, d = "".join(rng.choice("0123456789abcdef") for _ in range(40)), "AKIA" + mix(16).upper(), mix(40), mix(32), mix(24) + "7", mix(30)
    path = "/some/long/path-2024"
    rows = [
        (1, f"so ID={aws};SECRET={a} here", {aws, a}),
        (2, f'{{"api_key":"{b}","path":"{path}/index"}}', {b}),
        (3, f"https://h.org/?token={tok}&next={path}", {tok}),
        (4, f"https://user:{c}@host/long/path/name-1", {c}),
        (5, f"Bearer eyJ{a}.eyJ{b}{b}.{d}", {f"eyJ{a}", f"eyJ{b}{b}", d}),
        (6, "a,b;" * 5000 + f"token={d};" + "c.d;" * 5000, {d}),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    forest = secrets.fit_secrets(spark)
    found = secrets.find_secrets(docs, forest).where("is_secret").collect()
    assert {i: {r.secret for r in found if r.doc_id == i} for i, _, _ in rows} == {i: want for i, _, want in rows}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert not any(x in clean[i] for i, _, want in rows for x in want) and path in clean[2] and path in clean[3]


def brute_secrets(text, forest):
    """(word number, run, score) of every candidate, by a plain scan and a walk through each tree."""
    words, out = re.split(r"[\x20\x09-\x0D]+", text), []
    for i, word in enumerate(words):
        if not re.search("[0-9]", word):
            continue
        at = 0
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", word):
            head, run = re.split("[?&;,{}]", word[at : m.start()])[-1], m[0]
            tail, at = re.match("[^?&;,{}]{0,200}", word[m.end() :])[0], m.end()
            left = " ".join([words[i - 2] if i > 1 else "", words[i - 1] if i else ""]).lower()
            around, n = left + " " + head.lower(), len(run)
            classes = re.sub("[0-9]+", "&", re.sub("[a-z]+", "%", re.sub("[A-Z]+", "#", run)))
            x = [
                n, sum(c.isdigit() for c in run) / n, sum(c.isupper() for c in run) / n, len(classes) / n, len(set(run)) / n,
                bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", run)), (n - len(re.sub(secrets.DICTIONARY, "", run.lower()))) / n, run.count("/") / n,
                len(re.findall("[-_]", run)) / n, bool(re.search(rf"(?:{secrets.SECRET_WORDS})[^a-z]*$|(?:{secrets.SECRET_WORDS})\W", around, re.A)),
                bool(re.search(rf"\b(?:{secrets.HARMLESS_WORDS})\b", around, re.A)), bool(re.search(secrets.PLACEHOLDERS, run.lower())),
                bool(re.search(r"@|://|www\.", head + run + tail)), bool(re.match(f"(?:{secrets.PREFIXES})", run)), bool(re.search("[=:]", head.lower())),
                max(map(len, re.split("[^A-Za-z]+", run))) / n,
            ]
            votes = 0.0
            for k in forest.roots:
                while forest.left[k] != k:
                    k = forest.left[k] if x[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
                votes += forest.value[k]
            out.append((i, run, round(votes / len(forest.roots), 9)))
    return out


def test_candidates_and_forest_against_brute_force(spark, docs):
    forest = secrets.fit_secrets(spark)
    texts = dict(docs) | {10_000 + i: t for i, (t, _) in enumerate(secrets.labelled_findings(200, seed=3))}
    texts |= {20_000: "", 20_001: " \t ", 20_002: 'x={"api_key":"' + "a1B2" * 8 + '","p":"/usr/lib/some/long/path/9"},?t=' + "f0" * 20 + "&n=1"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = Counter((r.doc_id, r.word_ix, r.secret, round(r.score, 9)) for r in secrets.find_secrets(df, forest).collect())
    assert got == Counter((i, *c) for i, t in texts.items() for c in brute_secrets(t, forest)) and len(got) > 300


@pytest.mark.parametrize(("n", "letters", "memory"), [(40, 3, 4), (101, 2, 5), (258, 1, 10)])
def test_suffix_ranks(spark, n, letters, memory):
    rng = random.Random(n)
    sym = [rng.randint(1, letters) for _ in range(n - 1)] + [letters + 5]
    got = sorted((r.pos, r["rank"]) for r in suffixes.suffix_ranks(spark.createDataFrame(list(enumerate(sym)), "pos long, sym long"), memory).collect())
    order = sorted(range(n), key=lambda i: sym[i:])
    assert got == sorted((p, i + 1) for i, p in enumerate(order))


@pytest.mark.parametrize("hot", [False, True])
def test_byte_dedup(spark, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffixes, "CROWD", 7)
        monkeypatch.setattr(suffixes, "CHUNK", 1600)
    length, rng = 60, random.Random(3)
    base = "".join(rng.choice("abc é") for _ in range(2000))
    texts = {i: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 200))) + base[(a := rng.randint(0, 1500)) : a + rng.randint(10, 400)] + "ab" * rng.randint(0, 100) for i in range(40)}
    texts |= {1000 + i: t for i, t in list(docs.items())[:60]}
    raw = {i: t.encode() for i, t in texts.items()}
    counts = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in suffixes.dedup_bytes(df, length, in_memory=30).collect():
        t, cover = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        assert r.kept == bytes(b for b, c in zip(t, cover, strict=True) if not c)
        assert sum(s.stop - s.start for s in r.spans) == sum(cover) and r.n_bytes == len(t)


def test_suffix_order_decides(spark, monkeypatch):
    """With ranks of another order nothing but equal contexts is found; with the right one all is, also far from the driver."""
    rng = random.Random(2)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = letters(700)
    rows = [(i, letters(300) + passage[i * 20 : 600 + i * 10] + letters(300)) for i in range(6)]
    rows += [(None, passage[100:650]), (3, letters(100) + passage[:650]), (50, letters(900)), (50, letters(900))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = [t.encode() for _, t in rows]
    counts = Counter(t[k : k + 400] for t in raw for k in range(len(t) - 399))
    want = Counter()
    for (i, _), t in zip(rows, raw, strict=True):
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if counts[t[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        want[i, sum(cover)] += 1
    removed = lambda: Counter((r.doc_id, sum(s.stop - s.start for s in r.spans)) for r in suffixes.dedup_bytes(df).collect())
    monkeypatch.setattr(suffixes, "IN_MEMORY", 4)
    assert removed() == want and sum(n > 0 for _, n in want) > 6

    right = suffixes.suffix_ranks

    def shuffled(seq, in_memory):
        return right(seq, in_memory).withColumn("rank", F.row_number().over(suffixes.Window.orderBy(F.xxhash64("pos"))).cast("long"))

    monkeypatch.setattr(suffixes, "suffix_ranks", shuffled)
    assert removed() != want


def test_byte_digests(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "IN_MEMORY", 500)  # the distributed sort
    raw = {i: t.encode() for i, t in docs.items()}
    counts = Counter(hash(t[k : k + 400]) for t in raw.values() for k in range(len(t) - 399))
    for r in queries.op9_suffix_dedup(spark, D).collect():
        t, cover = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for k in range(len(t) - 399):
            if counts[hash(t[k : k + 400])] > 1:
                cover[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(t), sum(cover), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == len(re.findall(b"\1+", bytes(cover)))


def test_sharding(spark, docs):
    got = queries.op10_sharding(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    of_text, slots, sizes = {}, {}, Counter()
    for r in got:
        t = docs[r.doc_id].encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and r.grown_shard is None
        assert of_text.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(Counter({t: sum(len(x.encode()) + 1 for x in docs.values() if x.encode() == t) for t in {x.encode() for x in docs.values()}}).values())
    assert max(sizes.values()) - min(sizes.values()) <= largest


def test_differencing():
    assert sharding.differencing([], 4) == []
    sizes = [8, 7, 6, 5, 4]
    parts = Counter()
    for s, p in zip(sizes, sharding.differencing(sizes, 2), strict=True):
        parts[p] += s
    assert abs(parts[0] - parts[1]) == 2


def test_pipeline(spark):
    import corpus_pipeline as C

    out = C.run(spark, D).collect()
    assert [n for n, _ in C.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scans", "bpe encoding"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = {r.doc_id for r in queries.op1_quality_rules(spark, D).where("kept").collect()}
    kept = docs.where(F.col("doc_id").isin(list(good)))
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    bad = {r.doc_id for r in decontam.contaminated(kept, spark.read.parquet(f"{D}/benchmark.parquet")).where("consistent").collect()}
    assert {r.doc_id for r in out} == {i for i, c in groups.items() if i == c and i not in bad}
