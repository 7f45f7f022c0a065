"""Near and line dedup, toxicity, licenses and packing against brute force; defined results for odd rows."""

import re
import zlib

import numpy as np
import pytest

from trialweave.llm import license_scan, line_dedup, near_dedup, packing, toxicity

SCHEMA = "doc_id long, text string, score double, _runs string, found string, id string"
ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "A b"), (5, "x" * 50_000), (6, None), (6, None), (7, "Straße ÀB <|endoftext|> naïve"), (8, "w " * 20_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", "f", "clash") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{int(k)}" for k in rng.integers(0, vocabulary, n)]


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(words(rng, int(rng.integers(3, 120))))) for i in range(n)]
    base = words(rng, 120)
    for i in range(n, 2 * n):  # one group of edited copies
        own = list(base)
        for at in rng.integers(0, len(own), int(rng.integers(0, 9))):
            own[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(own)))
    return rows + [(i + 1000, t) for i, t in rows[::7]] + ODD


# near dedup -----------------------------------------------------------------------------------------------------------


def brute_components(rows, size=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    big = 1 << 60
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if doc is None else doc)
    return {(doc, text): (len(sets[i]), None if least[find(i)] == big else least[find(i)]) if sets[i] else (0, doc) for i, (doc, text) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = near_dedup.near_duplicates(docs).toPandas()
    assert len(out) == len(rows)
    got = {(None if np.isnan(r.id) else int(r.id), int(r.n_shingles), None if np.isnan(r.component_id) else int(r.component_id)) for r in out.itertuples()}
    assert got == {(doc, n, comp) for (doc, _), (n, comp) in brute_components(rows).items()}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    expected = [doc for (doc, _), (_, comp) in brute_components(rows).items() if doc == comp]
    assert sorted(ids, key=str) == sorted([*expected, 6], key=str)  # rows without words stay, repeated ones too


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_bound_keeps_likely_links():
    need = near_dedup.least_matches(0.75, 1e-6)
    assert all(b >= a for a, b in zip(need, need[1:])) and need[-1] < 0.75 * near_dedup.HASHES


# line dedup -----------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_words=20):
    """Per row: what is left when every run of lines of ``min_words`` words or more that stood earlier goes, by loops over all runs."""
    seen, out = set(), []
    for _, text in rows:
        own, gone = [s.strip() for s in (text or "").split("\n") if s.strip()], set()
        for low in range(len(own)):
            for high in range(low, len(own)):
                run = tuple(own[low : high + 1])
                if sum(len(s.split()) for s in run) >= min_words and run in seen:
                    gone |= set(range(low, high + 1))
                seen.add(run)
        out.append([s for i, s in enumerate(own) if i not in gone])
    return out


@pytest.mark.parametrize("seed, longest", [(5, 30), (6, 12), (7, 3)])
def test_line_dedup_equals_brute_force(spark, seed, longest):
    rng = np.random.default_rng(seed)
    pool = [" ".join(words(rng, int(rng.integers(1, longest)))) for _ in range(12)]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), int(rng.integers(1, 25))))) for i in range(60)]
    short = {name: " ".join(f"{name}{k}" for k in range(12)) for name in "ABCXY"}
    # A and B stood before, but never next to each other, and neither has 20 words: nothing of "A B C" is repeated
    rows += [(100 + i, "\n".join(short[n] for n in text)) for i, text in enumerate(["AX", "YB", "ABC", "XAB", "BCA", "AXYB"])]
    out = {r.doc_id: r for r in line_dedup.delete_repeats(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for (doc, _), expected in zip(rows, brute_lines(rows)):
        left = [s.strip() for s in out[doc].text.split("\n") if s.strip()]
        assert left == expected, doc
        assert out[doc]["_n_lines"] - out[doc]["_n_deleted"] == len(expected)
    assert out[102]["_n_deleted"] == 0 and out[103]["_n_deleted"] == 2 and out[104]["_n_deleted"] == 2


def test_line_dedup_odd_rows(spark):
    docs = frame(spark, ODD)
    out = line_dedup.delete_repeats(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(ODD)
    assert {r.text for r in out.where("doc_id = 6").collect()} == {None}
    assert line_dedup.delete_repeats(frame(spark, [])).count() == 0
    long = "\n".join(["one line of quite a few words that comes back again and again in this one text for good"] * 3)
    (row,) = line_dedup.delete_repeats(frame(spark, [(1, long)])).collect()
    assert row["_n_deleted"] == 2 and row.text == long.split("\n")[0]


# licenses -------------------------------------------------------------------------------------------------------------


def test_license_base_counts_and_labels(spark):
    texts = [
        "Released UNDER the MIT-License. under the mit license", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "This work is licensed under the GNU General Public License, version 3.",
        "nothing here", "", None, "underthe mit license", "SPDX-License-Identifier: GPL-2.0-only", "All rights reserved.",
    ]
    out = license_scan.scan(frame(spark, list(enumerate(texts))).drop("found")).orderBy("doc_id").collect()
    base = [[p for p in r["found"] if p.priority == 3] for r in out]
    assert [len(b) for b in base] == [2, 1, 1, 2, 0, 0, 0, 0, 0, 0, 0]
    assert sorted(p.low for p in base[0]) == [1, 5] and [p.low for p in base[3]] == [0, 3]
    labels = [sorted({p.label for p in r["kept"]}) for r in out]
    assert labels[4] == ["GPL", "GPL-3.0"] or labels[4] == ["GPL-3.0"]
    assert labels[9] == ["GPL-2.0"] and labels[10] == ["proprietary"] and labels[5] == labels[7] == []
    assert "mit" in labels[0] and "apache-2" in labels[1] and "Apache-2.0" in labels[1] and "CC-BY-NC-4.0" in labels[2]
    assert [r.n_words for r in out] == [len(license_words(t)) for t in texts]


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")


def test_license_rules_are_gated():
    rules = license_scan.signature_rules()
    assert len(rules) > 200
    for _, _, keyword, rx in rules:
        re.compile(rx)
        assert keyword == keyword.strip().lower()


def test_license_gate_misses_nothing(spark):
    """Without the gate the same places are found."""
    texts = [f"{a} the {b}. {c}" for a in ("Licensed under", "Provided under", "subject to", "see") for b in ("BSD 3-clause", "Mozilla Public License 2.0", "cc0", "EUPL 1.2") for c in ("license", "", "spdx license identifier: ISC")]
    docs = frame(spark, list(enumerate(texts))).drop("found")
    from pyspark.sql import functions as F

    a = license_scan.scan(docs).select("doc_id", "found").orderBy("doc_id").collect()
    b = license_scan.scan(docs, gate=lambda low: F.lit(True)).select("doc_id", "found").orderBy("doc_id").collect()
    assert a == b


def spelled(rx):
    """Every string of a regex of literals, groups, classes of letters and optional parts."""
    from re import _parser

    def walk(parts):
        done = [""]
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                own = [chr(arg)]
            elif name == "IN":
                own = [s for part in arg for s in walk([part])]
            elif name == "SUBPATTERN":
                own = walk(arg[3])
            elif name == "BRANCH":
                own = [s for branch in arg[1] for s in walk(branch)]
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                own = ["", *walk(arg[2])]
            else:
                raise ValueError(name)
            done = [a + b for a in done for b in own]
        return done

    return walk(_parser.parse(rx))


def test_license_keywords_miss_nothing(spark):
    """Every spelling of every name is found as if no rule had a keyword."""
    from pyspark.sql import functions as F

    names = [line.split(" | ") for line in license_scan.NAMES.strip().splitlines()]
    texts = sorted({s for _, _, rx in names for s in spelled(rx)})
    docs = frame(spark, list(enumerate(f"Licensed under {s}." for s in texts))).drop("found").repartition(4)
    places = lambda rules: {r.doc_id: sorted(map(tuple, r["found"])) for r in license_scan.scan(docs, rules=rules, gate=lambda low: F.lit(True)).select("doc_id", "found").collect()}
    a = places(None)
    b = places([(label, priority, "", rx) for label, priority, _, rx in license_scan.signature_rules()])
    assert [texts[i] for i in b if a[i] != b[i]] == []
    labels = {texts[i]: {p[0] for p in found} for i, found in a.items()}
    assert "MS-PL" in labels["ms pl"] and "MS-RL" in labels["ms rl"] and "PSF-2.0" in labels["psf"] and "0BSD" in labels["zero clause bsd"] and "Libpng" in labels["png reference library"]


def places(rng, n):
    out = []
    for _ in range(n):
        low = int(rng.integers(0, 40))
        out.append((f"l{int(rng.integers(0, 4))}", int(rng.integers(0, 4)), low, low + int(rng.integers(0, 6))))
    return out


@pytest.mark.parametrize("piece", [3, 128])
def test_suppression_equals_all_pairs(spark, piece):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(piece)
    rows = [(i, places(rng, int(rng.integers(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, found array<struct<label:string,priority:int,low:int,high:int>>")
    got = {r.id: sorted(map(tuple, r.kept)) for r in df.select("id", license_scan.unsuppressed(F.col("found"), piece=piece).alias("kept")).collect()}
    for i, found in rows:
        beaten = lambda a: any(b[2] <= a[2] and a[3] <= b[3] and (b[1] > a[1] or (b[1] == a[1] and b[3] - b[2] > a[3] - a[2])) for b in found)
        assert got[i] == sorted(a for a in found if a[1] == 3 or not beaten(a))


def test_license_columns_equal_loops(spark):
    """n_words, n_base, first and last word, base labels and score of random texts, by plain loops."""
    rng = np.random.default_rng(2)
    pool = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "x", "Under the mit license", "cc-by--nc", "apache License, version 2", "é", "licensed"]
    texts = [" ".join(rng.choice(pool, int(rng.integers(0, 14)))) for _ in range(120)] + ["", None]
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    from pyspark.sql import functions as F

    out = license_scan.scan(frame(spark, list(enumerate(texts)))).withColumn("base", F.filter("found", lambda p: p["priority"] == 3)).collect()
    for r in out:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((i, name) for name, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r.n_words == len(w) and sorted((p.low, p.label) for p in r.base) == want


def test_dense_license_text_is_swept_in_time(spark):
    import time

    text = "released under the MIT license or the Apache License, Version 2.0; " * 6000
    began = time.time()
    kept = license_scan.scan(frame(spark, [(1, text)])).selectExpr("size(kept) AS n").first().n
    assert kept >= 12_000 and time.time() - began < 60


# packing --------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [r for r in corpus(3, 20) if r in ODD or r[0] > 8]
    own = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(frame(spark, rows).repartition(3), size=64).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
    for pieces in spans.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        if doc == 6:
            assert [r.ids for r in pieces] == [[0], [0]]
            continue
        assert [i for r in pieces for i in r.ids] == [*own.encode(text or "", add_special_tokens=False).ids, 0]
        assert pieces[0].doc_tokens == sum(r.length for r in pieces)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    texts = {1: "x" + "\n" * 1_100_000 + "y", 2: " " * 2_000_000, 3: "a \t\n b" * 10}
    out = packing.pack(frame(spark, list(texts.items()))).collect()
    for doc, text in texts.items():
        ids = [i for r in sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start) for i in r.ids]
        assert ids == [*own.encode(text, add_special_tokens=False).ids, 0]


def test_many_open_windows_keep_the_rule():
    """No bound on open windows changes the choice of level: texts that never fit together stay apart until the end."""
    packer = packing.LevelPacker(1024)
    assert not any(packer.place((i, 0, np.zeros(600, "<u4"), 600)) for i in range(9000))
    assert len(packer.stacks[600]) == 9000
    done = packer.close()
    assert sum(len(p[2]) for w in done for p in w) == 600 * 9000


def test_level_choice_minimises_squares():
    rng = np.random.default_rng(1)
    packer, counts = packing.LevelPacker(32), np.zeros(33, int)
    for i, n in enumerate(rng.integers(1, 33, 400)):
        before = [len(s) for s in packer.stacks]
        best = min(sum(x * x for x in after[1:32]) for level in range(33 - n) if level == 0 or before[level] for after in [[c - (k == level and level > 0) + (k == level + n) for k, c in enumerate(before)]])
        packer.place((i, 0, np.zeros(n, "<u4"), int(n)))
        counts = [len(s) for s in packer.stacks]
        if n < 32:
            assert sum(x * x for x in counts[1:32]) == best


def test_open_windows_lose_nothing():
    packer, out = packing.LevelPacker(64), []
    for i in range(300):
        out += packer.place((i, 0, np.full(40, i, "<u4"), 40))
    out += packer.close()
    assert sorted(np.concatenate([p[2] for w in out for p in w]).tolist()) == sorted(np.repeat(np.arange(300), 40).tolist())
    assert all((n := sum(len(p[2]) for p in w)) == 64 or n & (n - 1) == 0 for w in out)


# toxicity -------------------------------------------------------------------------------------------------------------


def test_one_class_gives_its_share(spark):
    docs = frame(spark, [(i, f"some words number {i}") for i in range(40)] + [(99, "")])
    for toxic, low, high in ((1, 0.99, 1.0), (0, 0.0, 0.01)):
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(40)], "doc_id long, quality int, toxic int")
        scores = [r.p for r in toxicity.score(docs, toxicity.fit(docs, labels), name="p").where("doc_id < 50").collect()]
        assert all(low <= p <= high for p in scores)


def test_long_texts_are_learnt_from(spark):
    """Labelled texts that are all longer than the training text bound still teach."""
    rng = np.random.default_rng(3)
    text = lambda bad: " ".join("vile filth" if bad and k % 9 == 0 else w for k, w in enumerate(words(rng, 2600)))
    rows = [(i, text(i % 2)) for i in range(60)]
    assert min(len(t) for _, t in rows) > 12_000
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    out = {r.doc_id: r.p for r in toxicity.score(docs, toxicity.fit(docs, labels), name="p").collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 2 == 1) for i in out]) > 0.9


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, gates = rng.integers(0, 5, (3, toxicity.WINDOW)), rng.standard_normal((5, 6 * toxicity.HIDDEN))
    mask = np.ones(ids.shape, np.float32)
    mask[0, 40:] = 0
    keep = {}
    net.logits(gates, ids, mask, keep)
    grad, dg = net.gradients(keep, np.ones(3), 5)
    eps = 1e-3
    for name in ("uf", "ub", "att", "out"):
        at = tuple(int(rng.integers(s)) for s in net.p[name].shape)
        old = net.p[name][at]
        z = []
        for step in (eps, -eps):
            net.p[name][at] = old + step
            z.append(net.logits(gates, ids, mask).astype(np.float64).sum())
        net.p[name][at] = old
        assert (z[0] - z[1]) / (2 * eps) == pytest.approx(grad[name][at], rel=0.03, abs=2e-3)


def test_windows_cover_everything():
    for n in (1, 63, 64, 65, 96, 97, 500):
        starts = toxicity.windows_of(n)
        covered = np.zeros(n, bool)
        for s in starts:
            covered[s : s + toxicity.WINDOW] = True
        assert covered.all() and (n <= toxicity.WINDOW or (np.diff(starts) <= toxicity.STEP).all())


def test_toxicity_learns_and_scores_odd_rows(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(240):
        own = words(rng, int(rng.integers(20, 200)))
        if i % 3 == 0:
            for at in rng.integers(0, len(own), 3):
                own[at] = f"vile{['ness', 'ly', 'r'][int(rng.integers(3))]}"
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    net = toxicity.train(texts[:180], labels[:180], 1 / 3)
    got = toxicity.Scorer(net).scores(texts[180:]) >= 0.5
    assert (got == np.array(labels[180:], bool)).mean() >= 0.9
    docs = frame(spark, ODD)
    out = toxicity.score(docs, net, name="_toxic")
    values = [r["_toxic"] for r in out.collect()]
    assert out.columns == [*docs.columns, "_toxic"] and len(values) == len(ODD) and all(0 <= v <= 1 for v in values)
    assert toxicity.train([], [], 0.0).prior == 0.0
    assert (toxicity.Scorer(toxicity.train([], [], 0.0)).scores(["some words", ""]) < 1e-9).all()
