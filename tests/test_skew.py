"""Chunked paths equal the plain windows when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from trialweave.operators import skew as sk
from trialweave.operators import windows as wn


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 6), rng.randint(0, 40), i, rng.choice([None, 1.0, 2.5, -3.0, 4.0])) for i in range(600)]
    return spark.createDataFrame(rows, "k int, t int, id int, v double")


def same(a, b, cols):
    pick = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert pick(a) == pick(b)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("fn", [sk.scan_last, sk.scan_sum, sk.scan_max, sk.scan_min])
def test_scans(hot, fn, reverse):
    run = lambda c: fn(hot, ["k"], ["t", "id"], reverse=reverse, chunked=c, out=F.col("v"))
    same(run(False), run(True), ["k", "id", "out"])


def test_index_shift_and_ranks(hot):
    same(sk.scan_index(hot, ["k"], ["t", "id"], chunked=False), sk.scan_index(hot, ["k"], ["t", "id"], chunked=True), ["k", "id", "row_no"])
    shift = lambda c: sk.scan_shift(hot, ["k"], ["t", "id"], chunked=c, p=F.col("v"))
    same(shift(False), shift(True), ["k", "id", "p"])
    same(sk.mid_ranks(hot, ["k"], "t", chunked=False), sk.mid_ranks(hot, ["k"], "t", chunked=True), ["k", "id", "mid_rank"])


def test_quantiles(hot):
    run = lambda c: sk.exact_quantiles(hot, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.9}, chunked=c)
    a, b = ({r["k"]: r for r in run(c).collect()} for c in (False, True))
    assert a.keys() == b.keys()
    for k in a:
        assert all(abs(a[k][c] - b[k][c]) < 1e-12 for c in "abc")


def test_sliding_blocks(hot):
    run = lambda blocked: wn.sliding_frames(hot, ["k"], ["t", "id"], 5, block_rows=20, blocked=blocked, hi=lambda w: F.max("id").over(w))
    same(run(False), run(True), ["k", "id", "hi"])


def test_greedy_paths(hot):
    pts = hot.select("k", F.col("t").cast("bigint").alias("start"))
    want = []
    for k in {r["k"] for r in pts.collect()}:
        free = None
        for s in sorted({r["start"] for r in pts.filter(F.col("k") == k).collect()}):
            if free is None or s >= free:
                want.append((k, s))
                free = s + 4
    for doubling in (False, True):
        got = sorted(map(tuple, wn.greedy_segments(pts, "k", "start", 4, doubling=doubling).collect()))
        assert got == sorted(want)


def test_limit_setting_switches_path(spark, hot):
    spark.conf.set(sk.LIMIT_CONF, "5")
    try:
        assert sk.group_limit(hot) == 5 and sk.largest_group(hot, ["k"]) > 5
    finally:
        spark.conf.unset(sk.LIMIT_CONF)


def test_first_per_key_and_group_stats(hot):
    first = sk.first_per_key(hot, ["k"], ["t", "id"]).collect()
    rows = hot.collect()
    for r in first:
        assert (r["t"], r["id"]) == min((x["t"], x["id"]) for x in rows if x["k"] == r["k"])
    assert sk.with_group_stats(hot, ["v"], n=F.count(F.lit(1))).filter("n is null").count() == 0  # null key keeps its group
