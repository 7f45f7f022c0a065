"""Source divergence, substring dedup and importance resampling against brute force; defined results for odd rows."""

import hashlib
import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialweave.llm import importance_resampling, source_divergence, substring_dedup
from trialweave.runtime import SHUFFLE_CLEANUP

SCHEMA = "doc_id long, text string, lang string, source string, id string, _keys string, term string, rank int"
ODD = [(None, None, None, None), (None, "a b", "en", None), (9001, "", "", "s1"), (9002, " \n\t ", "en", "s1"), (9003, "Straße ÀB naïve <|end|> x1y", "de", "s9"), (9004, "x" * 50_000, "en", "s1"),
       (9005, "w " * 20_000, "en", "s2"), (9006, None, "xx", "s2"), (9006, None, "xx", "s2")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "clash", "k", "t", 7) for i, t, lang, source in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed, n=120, vocabulary=60):
    rng = np.random.default_rng(seed)
    word = lambda k: f"w{chr(97 + k % 26)}{'é' if k % 7 == 0 else ''}{'Q' * (k % 3)}{chr(97 + k // 26)}"
    text = lambda n: " ".join(word(int(k)) for k in np.minimum(rng.geometric(0.06, n), vocabulary))
    passage = text(40)
    rows = []
    for i in range(n):
        body = text(int(rng.integers(1, 80)))
        if i % 3 == 0:  # a third of the rows share a passage
            body = f"{body}\n{passage} {text(3)}"
        rows.append((i, body, ("en", "de")[i % 5 == 0], f"s{min(int(rng.integers(0, 9)), 4)}"))
    return rows + [(i + 5000, t, lang, s) for i, t, lang, s in rows[::10]] + ODD


# source divergence ----------------------------------------------------------------------------------------------------


def brute_divergence(rows, min_docs, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        v = len(kept)
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * v) for t in kept} for s, c in own.items()}
        for s in own.keys() - {None}:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own.keys() - {None, s}]
            term = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            out |= {(lang, s, "pair", o, -f, r) for r, (f, _, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t, -f, r) for r, (f, _, t) in enumerate(sorted(term)[:top], 1)}
    return out


@pytest.mark.parametrize("min_docs, top, bucket_terms, block", [(3, 50, 20_000, 256), (3, 4, 5, 2), (1000, 50, 20_000, 256)])
def test_divergence_equals_brute_force(spark, min_docs, top, bucket_terms, block):
    rows = corpus(1)
    got = source_divergence.divergences(frame(spark, rows), min_docs=min_docs, top=top, bucket_terms=bucket_terms, block=block).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_divergence(rows, min_docs, top)


def test_divergence_spills_and_cuts_long_texts(spark):
    rows = corpus(2, n=60)
    stripes = source_divergence.merge_stripes(source_divergence.fold_documents(frame(spark, rows), spill=50), 1)
    got = {(r.lang, r.term): (r.df, dict(zip(r.sources, r.counts))) for r in stripes.collect()}
    df, counts = Counter(), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        df.update((lang or "", t) for t in set(terms))
        for t in terms:
            counts[lang or "", t][source or ""] += 1
    assert got == {k: (n, dict(counts[k])) for k, n in df.items()}
    text = ("ab1 " * 50).encode()
    assert b"".join(source_divergence.pieces(text, 7)) == text and all(not p.startswith(b"b") for p in source_divergence.pieces(text, 7))


def test_divergence_arithmetic_is_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 10**15, 200)
    count = (total * rng.random(200)).astype(np.int64)
    got = source_divergence.smoothed(count, total, 1000, 5)
    assert got.tolist() == [1 + 10**9 * (int(c) + 5) // (int(n) + 5000) for c, n in zip(count, total)]


def test_divergence_of_nothing(spark):
    assert source_divergence.divergences(frame(spark, [])).count() == 0


# substring dedup ------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    big = 1 << 63
    least = {}
    for (doc, *_), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, big), big if doc is None else doc)
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = {k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < (big if doc is None else doc) for k in range(i, i + window)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


@pytest.mark.parametrize("seed, window", [(3, 13), (4, 5), (5, 13)])
def test_substrings_equal_brute_force(spark, seed, window):
    rows = corpus(seed, vocabulary=6 if seed == 5 else 60)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    docs = frame(spark, rows).repartition(7)
    out = substring_dedup.remove_repeats(docs, window=window)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = Counter((r.doc_id, r["_n_words"], r["_n_removed"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())
    words, kept = brute_substrings(rows, window)
    assert got == Counter((row[0], len(w), len(w) - len(k), " ".join(k)) for row, w, k in zip(rows, words, kept))
    assert sum(n * r[2] for r, n in got.items()) > 0
    same = {r.doc_id: r.text for r in out.where("_n_removed = 0 AND doc_id IS NOT NULL").collect()}
    assert all(text == dict((r[0], r[1]) for r in rows)[doc] for doc, text in same.items())


def test_substrings_across_many_tasks_and_shards(spark):
    rows = corpus(6, n=60)
    words, kept = brute_substrings(rows, 13)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = substring_dedup.remove_repeats(frame(spark, rows).repartition(20)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["_n_removed"] for r in out) == sorted(len(w) - len(k) for w, k in zip(words, kept))


def test_every_window_holds_a_block():
    """The smallest alignment argument: any 13 consecutive places hold 7 that begin at a multiple of 7."""
    for start in range(50):
        assert any(p % 7 == 0 and p + 7 <= start + 13 for p in range(start, start + 13))


def test_substrings_release_the_packed_keys(spark):
    """Texts without repeats: when the query ends, they alone lie in shuffle files, not the packed keys of as many bytes too."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f: f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, 2000)), "en", "s1") for i in range(100)]
    docs, before, setting = frame(spark, rows), files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = substring_dedup.remove_repeats(docs)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sum(r["_n_removed"] for r in out.collect()) == 0
    size = sum(n for f, n in files().items() if f not in before)
    assert 0 < size < 1.5 * sum(len(r[1]) for r in rows)


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


# importance resampling ------------------------------------------------------------------------------------------------


def brute_resample(rows, target, percent=5, least_words=20):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    feats = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [[bucket(f) for f in feats(find(t))] for _, t, *_ in rows]
    s, t = Counter(b for o in own for b in o), Counter(bucket(f) for x in target for f in feats(find(x)))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for (doc, text, *_), o in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in o)
        out.append([doc, len(o), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(find(text))])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling_equals_brute_force(spark, percent):
    rows = corpus(7)
    target = [t for _, t, *_ in corpus(8, n=30) if t]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None, ""])], "item_id int, text string")
    got = importance_resampling.resample(frame(spark, rows).repartition(5), goal, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows, target, percent)


def test_crc_matrices():
    rng = np.random.default_rng(9)
    slices = [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(1, 40, 300)] + [b"x" * 10_000, b"y" * 9000]
    start = np.concatenate([[0], np.cumsum([len(x) for x in slices])[:-1]])
    got = importance_resampling.crc_by_length(np.frombuffer(b"".join(slices), np.uint8), start, np.array([len(x) for x in slices]))
    assert got.tolist() == [zlib.crc32(x) for x in slices]


def test_features_across_texts():
    texts = [[b"a", b"b", b"a"], [], [b"b"], [b"a", b"b"]]
    of, bucket = importance_resampling.FeatureBuckets(3, 1000)(texts)
    want = Counter((i, zlib.crc32(b" ".join(t[k : k + n])) % 1000) for i, t in enumerate(texts) for n in (1, 2, 3) for k in range(len(t) - n + 1))
    assert Counter(zip(of.tolist(), bucket.tolist())) == want


def test_resampling_of_nothing(spark):
    goal = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(frame(spark, []), goal).count() == 0
    rows = corpus(10, n=25)
    assert importance_resampling.resample(frame(spark, rows), goal).count() == len(rows)
