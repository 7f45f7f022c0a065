"""The corpus pipeline: every stage alone on odd rows, and the whole against its stages."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (501, "", "en", "s1", 0), (502, " \n\t", None, "s1", 3), (503, None, "de", None, 0), (504, "short one", "en", "s2", 9), (504, "short one", "en", "s2", 9),
       (505, "x" * 20_000, "en", "s1", 20_000), (506, "w " * 4000, "fr", "s3", 8000)]


def line(rng, n):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, 3000, n))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = np.random.default_rng(1)
    shared = line(rng, 25)
    rows = []
    for i in range(120):
        text = "\n".join([line(rng, 30), *([shared] if i % 4 == 0 else []), line(rng, 30)])
        if i % 6 == 5:
            text += " " + " ".join(["vile filth scum"] * 6)
        rows.append((i, text, ("en", "de")[i % 2], f"s{i % 3}", len(text)))
    rows += [(200 + i, rows[i][1].replace("w1 ", "w2 "), "en", "s1", len(rows[i][1])) for i in range(0, 24, 2)]  # near copies
    rows += [(300 + i, *rows[i][1:]) for i in range(1, 6, 2)] + ODD
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 5)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("k", range(5))
def test_stage_of_nothing(spark, corpus, k):
    name, stage = cp.STAGES[k]
    out = stage(spark, read(spark, corpus[0]).limit(0), corpus[0])
    assert out.count() == 0, name
    if k < 4:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_odd_rows_alone(spark, corpus, k):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = cp.STAGES[k][1](spark, docs, corpus[0])
    if k in (0, 1):
        assert out.count() == len(ODD)  # nothing here is toxic or repeats twenty words of lines
    if k == 2:
        assert out.count() == len(ODD) - 1 and out.where("doc_id = 504").count() == 1  # only the repeated row goes once
    if k == 4:
        assert out.where("doc_id IS NULL").agg(F.sum("length")).first()[0] == 1  # a null text is its end token


def test_toxicity_stage_rejects_what_it_scores(spark, corpus):
    sf, rows = corpus
    kept = {r.doc_id for r in cp.drop_toxic(spark, read(spark, sf), sf).collect()}
    bad = {i for i in range(120) if i % 6 == 5}
    assert len(kept & bad) <= 5 and len({i for i in range(120)} - bad - kept) <= 2 and {501, 502, 503, None} <= kept


def test_line_stage_equals_loops(spark, corpus):
    sf, rows = corpus
    seen, want = set(), {}
    for doc, text, *_ in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own, gone = [s.strip() for s in (text or "").split("\n") if s.strip()], set()
        for low in range(len(own)):
            for high in range(low, len(own)):
                run = tuple(own[low : high + 1])
                if sum(len(s.split()) for s in run) >= 20 and run in seen:
                    gone |= set(range(low, high + 1))
                seen.add(run)
        want[doc] = None if own and len(gone) == len(own) else [s for i, s in enumerate(own) if i not in gone]
    out = cp.cut_repeated_lines(spark, read(spark, sf), sf).collect()
    assert {r.doc_id for r in out} == {d for d, left in want.items() if left is not None}
    for r in out:
        assert [s.strip() for s in (r.text or "").split("\n") if s.strip()] == want[r.doc_id]
        assert r.n_chars == len(r.text) if r.text and r.doc_id % 4 == 0 and 0 < r.doc_id < 120 else True


def test_near_stage_leaves_one_of_each_group(spark, corpus):
    sf, rows = corpus
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    kept = [r.doc_id for r in cp.drop_near_copies(spark, read(spark, sf), sf).collect()]
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert len(kept) == len(set(kept))
    full = [d for d in kept if sets[d]]
    assert not any(near(a, b) for i, a in enumerate(full) for b in full[:i])
    assert all(any(near(d, k) for k in full) for d in sets if sets[d] and d not in full)


def test_pipeline_is_its_stages(spark, corpus):
    sf, _ = corpus
    docs = read(spark, sf)
    for _, stage in cp.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == before
    want = cp.STAGES[-1][1](spark, docs, sf)
    got = cp.run(spark, sf)
    assert got.columns == want.columns
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(map(str, df.select(*key).collect()))
    a, b = ([r for r in df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()] for df in (got, want))
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert len(rows(got)) >= len(a)
