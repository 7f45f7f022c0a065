"""URL filters, mixing and the vector searches against brute force; registered queries against their SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave import llm
from trialweave.llm import graph_search, impact_search, mixing, url_filters

SF = "/root/testdata/sf0.001"


# URL filters ----------------------------------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = keys[::3]
    universe = spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "key string")
    for shard_keys in (1 << 18, 200):
        cascade = url_filters.build_cascade(universe, spark.createDataFrame([(k,) for k in [*listed, "not-in-the-corpus"]], "key string"), shard_keys=shard_keys, bits_per_key=2)
        assert len(cascade.bits) > 1 and (cascade.shards > 1) == (shard_keys == 200)
        got = cascade.contains(universe, F.coalesce("key", F.lit("")), "yes").collect()
        assert len(got) == 3051 and {r.key for r in got if r.yes} == set(listed)


def test_shards_without_listed_keys(spark):
    keys = [f"k{i}" for i in range(400)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filters.build_cascade(universe, universe.where("key IN ('k1', 'k2', 'k3', 'k4', 'k5', 'k6', 'k7', 'k8')"), shard_keys=1, bits_per_key=64)
    assert cascade.shards == 8 and cascade.frame.count() < 8
    got = cascade.contains(universe.withColumn("_words_1", F.lit("clash")), F.col("key"), "yes").where("yes").select("key").collect()
    assert {r.key for r in got} == {f"k{i}" for i in range(1, 9)}


def test_query_lists_addresses_in_levels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    key = F.concat(url_filters.url_host(F.col("url")), url_filters.url_path(F.col("url")))
    assert len(url_filters.build_cascade(pages.select(key.alias("key")), url_filters.tracked_addresses(pages)).bits) >= 2
    many = spark.range(100_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), "id")
    cascade = url_filters.build_cascade(many, many.where("id % 3 = 0"))
    assert len(cascade.bits) >= 2
    assert cascade.contains(many, F.col("key"), "yes").where("yes <> (id % 3 = 0)").count() == 0


def test_judged_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/a?x#y"), (2, "https://a.example.com/en/"), (3, "https://a.example.com/EN/"), (4, "ftp://b.NET/es/q"), (5, "http://b.net/de/"), (6, None), (7, "no scheme.com/en/"), (8, "x://bad.org"),
        (9, "http://Ünï.org/?u=http://c.com/"), (9, "http://Ünï.org/?u=http://c.com/"), (None, "http://com/"), (11, "a\nb://q.net/fr/z"),
    ]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in rows], "page_id long, url string, _shard string, listed int")
    listed = spark.createDataFrame([("bad.org",), ("Ünï.org",), (None,)], "key string")
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, listed, url_filters.RULES).collect()}
    assert (1, "www.example.com", "/en/a", "www.example.com/en/", "allow") in out
    assert (2, "a.example.com", "/en/", "example.com/en/", "block") in out and (3, "a.example.com", "/EN/", "com/", "allow") in out
    assert (4, "b.net", "/es/q", "net/es/", "block") in out and (5, "b.net", "/de/", None, "allow") in out
    assert (8, "bad.org", "", None, "block") in out and (9, "Ünï.org", "/", None, "block") in out
    assert (None, "com", "/", "com/", "allow") in out and (11, "q.net", "/fr/z", "net/fr/", "block") in out
    assert url_filters.judge_urls(pages.limit(0), listed, url_filters.RULES).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


# mixing ---------------------------------------------------------------------------------------------------------------


def brute_shares(budget, nodes):
    """Exact water filling: fill whoever cannot use its share, repeat."""
    open_, quota = {k: (c, w) for k, (c, w) in nodes.items() if w > 0}, dict.fromkeys(nodes, 0)
    while open_:
        total = sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c * total <= budget * w}
        if not full:
            return quota | {k: min(c, budget * w // total) for k, (c, w) in open_.items()}
        quota |= full
        budget -= sum(full.values())
        for k in full:
            del open_[k]
    return quota


@pytest.mark.parametrize("seed", range(4))
def test_shares_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = {f"n{i}": (int(rng.integers(0, 1000)), int(rng.integers(0, 5))) for i in range(12)}
    budget = int(rng.integers(0, 6000))
    df = spark.createDataFrame([(k, c, w, budget) for k, (c, w) in nodes.items()], "name string, cap long, weight long, budget long")
    got = {r["name"]: r.quota for r in mixing.share_out(df, [], "name").collect()}
    assert got == brute_shares(budget, nodes)


def test_mix_takes_epochs_and_handles_odd_rows(spark):
    rows = [(i, "one two three", "en", f"s{i % 2}") for i in range(40)] + [(100, None, None, None), (101, "", "de", "s1"), (102, "a b", "de", None), (7, "one two three", "en", "s1"), (None, "x", "en", "s0")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, key int, tokens int")
    out = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, ({"en": 1, "de": 3}, {}), budget=F.lit(200), max_epochs=2)
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sum(r._tokens for r in got) <= 200 and max(r._epoch for r in got) <= 1
    assert sum(r._tokens for r in got if r.lang == "de") == 4  # a short subtree is taken twice
    whole = mixing.mix(docs, {"lang": F.col("lang")}, ({},), budget=F.lit(10**6), max_epochs=3).where("text <> ''").groupBy("doc_id").count().collect()
    assert {r["count"] for r in whole if r.doc_id != 7} == {3} and {r["count"] for r in whole if r.doc_id == 7} == {6}
    assert mixing.mix(docs.limit(0), {"lang": F.col("lang")}, ({},)).count() == 0


# vectors --------------------------------------------------------------------------------------------------------------


def vectors(n=700, seed=0):
    rng = np.random.default_rng(seed)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(n)]
    hot = data[3][1]
    data += [(n + i, hot) for i in range(120)]
    return data + [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [None] + [1.0] * 7), (9000, [1.0, 2.0]), (5, data[5][1]), (None, data[6][1]), (9005, [float("inf")] * 8), (9006, [])]


def table_of(spark, data):
    return spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string")


def brute_top(data, k, divisor, change, zero):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))
    seen = {(i, tuple(v)) for i, v in data if ok(v)}
    out = set()
    pad = lambda v: np.array([*v, *[0.0] * (8 - len(v))])
    cand = [(i, change(pad(v))) for i, v in seen]
    for q, qv in seen:
        if q is None or q % divisor:
            continue
        own = sorted(((float(v @ change(pad(qv))), i) for i, v in cand if i != q), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out |= {(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(own)}
    return out


def test_exact_search_equals_brute_force(spark):
    data = vectors()
    df = table_of(spark, data)
    for shard_rows in (10_000, 150):
        got = {(r.query_id, r["rank"], r.vec_id, float(r.score)) for r in impact_search.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows, query_rows=9).collect()}
        assert got == brute_top(data, 5, 50, lambda v: np.floor(256 * v), True)
    assert impact_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_exact_search_stops_early_only_on_proof():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.standard_normal((4000, 16)))
    index, stopped = impact_search.ImpactIndex(rows), 0
    for q in rows[:20]:
        possible = index.search(q, 5, np.zeros(0, np.int64))
        stopped += len(possible) < len(rows)
        assert sorted((rows @ q)[possible])[-5:] == sorted(rows @ q)[-5:]
    assert stopped == 20


@pytest.mark.parametrize("size", [1e-3, 6e6, 1e20, 1e300])
def test_exact_search_of_any_size(spark, size):
    """floor(256 x) and its sums are exact for every finite x; a score beyond 64 bits shows as the nearest 64-bit number."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((200, 8)) * size
    v[::7] *= 1e-3
    v[3] = 0
    whole = [[int(np.floor(256 * x)) if abs(x) < 1e15 else int(x) * 256 for x in r] for r in v.tolist()]
    df = table_of(spark, list(enumerate(v.tolist())))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in impact_search.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=70).collect()}
    for q in range(0, 200, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], r)), i) for i, r in enumerate(whole) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in best]


def test_graph_search_recall_and_odd_rows(spark):
    data = vectors(1500, 1)
    df = table_of(spark, data)
    want = brute_top(data, 20, 20, lambda v: v, False)
    for shard_rows in (10_000, 600):
        got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in graph_search.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=shard_rows).collect()}
        assert len(got) == len(want)
        pairs = lambda s: {(q, i) for q, _, i, _ in s}
        assert len(pairs(got) & pairs(want)) / len(pairs(want)) >= 0.95
    assert graph_search.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-30, 1e20, 1e100])
def test_graph_search_keeps_large_and_small_vectors(spark, size):
    rng = np.random.default_rng(5)
    data = [(i, (size * rng.standard_normal(8)).tolist()) for i in range(400)]
    df = table_of(spark, data)
    got = graph_search.nearest(df, df.where("vec_id % 20 = 0")).collect()
    x = np.array([v for _, v in data])
    want = {(q, int(i)) for q in range(0, 400, 20) for i in [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]}
    assert len(got) == 400 and len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.95


def test_a_hub_takes_all_its_reverse_edges():
    """Many points whose nearest is the same one: all of them are found from it or from what it keeps."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.zeros((1, 6)), rng.standard_normal((900, 6))]).astype(np.float32)
    graph = graph_search.Graph(x, degree=8, beam=32)
    near = graph.walk(x[:64], 32)[0]
    want = np.argsort(((x[:64, None] - x[None]) ** 2).sum(-1), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(near[:, :8].tolist(), want.tolist())]) > 0.9


# registered queries ---------------------------------------------------------------------------------------------------


def load():
    llm.load_all()
    return sorted(llm.ORACLES)


@pytest.mark.parametrize("name", load())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = llm.QUERIES[name](spark, SF).toPandas(), con.sql(llm.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_license_scan", "op5_near_dedup", "op6_toxicity", "op7_packing", "op8_graph_search", "op9_line_dedup"])
def test_query_runs(spark, name):
    assert llm.QUERIES[name](spark, SF).count() > 0
