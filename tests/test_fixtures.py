"""Closed-form answers on small synthetic tables."""

import math
import os
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.functions import dist
from trialweave.operators import aggregate as ag
from trialweave.operators import decode as dc
from trialweave.operators import draws as dr
from trialweave.operators import filters as fl
from trialweave.operators import joins as jn
from trialweave.operators import signal as sg
from trialweave.operators import stats as st
from trialweave.operators import windows as wn
from trialweave.operators.recode import fill_from_entities, zscore
from trialweave.plans.standins import N_BINS
from trialweave.sources import logs as lg
from trialweave.sources import recordings as rd
from trialweave.sources import store as so

Z = NormalDist()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def trial_samples(spark):
    """Trials with amplitude = time/100 + 0.5 (violation) + sensor offset + cluster offset; entity 2: 2x + 5."""
    rows = []
    for p in (1, 2):
        for c in (d.CONTROL, d.VIOLATION):
            for m in ("m1", "m2"):
                for region, off in (("midline anterior", 0.3), ("midline medial", 0.0), ("midline posterior", -0.3)):
                    for s, so_ in (("1", 0.1), ("2", -0.1), ("3", 0.0)):
                        for t in (-100, -50, 200, 300, 400, 500, 600, 700, 898):
                            x = t / 100 + 0.5 * (c == d.VIOLATION) + so_ + off
                            rows.append((p, 2, c, m, region + s, region, t, x if p == 1 else 2 * x + 5))
    return spark.createDataFrame(rows, "entity int, session int, condition string, marker string, sensor string, region string, time_ms int, amplitude double")


UNIT = ["entity", "session", "condition", "marker"]


def windows(spark):
    return spark.createDataFrame(list(d.WINDOWS), "window_name string, min_ms int, max_ms int")


def test_window_means(spark, trial_samples):
    m = ag.trial_window_means(trial_samples, windows(spark), UNIT)
    r = {x["window_name"]: x for x in m.filter("entity = 1 and marker = 'm1' and condition = 'Grammatical'").collect()}
    assert r["200_500"]["n_regions"] == 3
    assert r["200_500"]["mean_value"] == pytest.approx(3.0)
    assert r["300_600"]["mean_value"] == pytest.approx(np.mean([3, 4, 5]))
    assert r["400_900"]["mean_value"] == pytest.approx(np.mean([4, 5, 6, 7, 8.98]))
    assert m.filter("window_name = '200_500'").count() == 8
    b = ag.trial_baselines(trial_samples, UNIT).filter("entity = 1 and marker = 'm1'")
    assert {x["condition"]: round(x["baseline"], 9) for x in b.collect()} == {d.CONTROL: -0.75, d.VIOLATION: -0.25}


def test_missing_region_stops(spark, trial_samples):
    cut = trial_samples.filter("not (entity = 1 and marker = 'm1' and region = 'midline medial' and time_ms >= 0)")
    with pytest.raises(Exception, match="expected 3 regions"):
        ag.require_regions(ag.trial_window_means(cut, windows(spark), UNIT), 3).collect()


def test_zscore_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", None), ("c", None)], "k string, x double")
    z = {(r["k"], r["x"]): r["z"] for r in zscore(df, ["k"], "x", "z").collect()}
    assert z["a", 1.0] == pytest.approx(-1 / math.sqrt(2)) and z["b", 5.0] == 0.0 and z["b", None] is None and z["c", None] is None
    z2 = zscore(df, ["k"], "x", "z", null_in_constant=False).filter("k = 'b' and x is null")
    assert one(z2)["z"] == 0.0


def test_covariate_fill(spark):
    df = spark.createDataFrame([(1, 1.0)] * 5 + [(2, None), (3, 2.0)], "e int, v double")
    r = {x["e"]: x for x in fill_from_entities(df, "e", "v").distinct().collect()}
    assert r[2]["v"] == 1.5 and r[2]["v_imputed"] and not r[1]["v_imputed"]


def test_balanced_proportion(spark):
    rows = [(1, "g", 1.0)] + [(2, "g", 0.0)] * 9
    r = one(ag.balanced_proportion(spark.createDataFrame(rows, "entity int, grp string, correct double"), ["grp"]))
    assert (r["mean"], r["n"], r["n_trials"], r["ci_low"], r["ci_high"]) == (0.5, 2, 10, 0.0, 1.0)


def test_signal_detection(spark):
    rows = [(p, "x", c, v) for p, vals in ((1, [1, 1, 1, 0, 1, 1, 1, 0]), (2, [1, 1, 1, 1, 0, 0, 0, 0]))
            for c, v in zip([d.CONTROL] * 4 + [d.VIOLATION] * 4, vals)]
    s = ag.signal_detection(spark.createDataFrame(rows, "entity int, grp string, condition string, correct int"), ["grp"])
    r = one(s.agg(F.avg("d_prime").alias("m"), F.avg("criterion").alias("c")))
    assert r["m"] == pytest.approx((Z.inv_cdf(3.5 / 5) - Z.inv_cdf(1.5 / 5)) / 2, abs=1e-9)
    assert r["c"] == pytest.approx((0 - Z.inv_cdf(4.5 / 5)) / 2, abs=1e-9)


def test_pooled_and_difference(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 4, 1.0), (2, 2, 10.0)], "entity int, session int, v double")
    p = ag.add_pooled_session(df, ["entity"], "v").filter("session = 'pooled'")
    assert one(p.agg(F.avg("v").alias("m"), F.count("v").alias("n"))).asDict() == {"m": 6.5, "n": 2}
    w = spark.createDataFrame([(1, d.CONTROL, 1.0), (1, d.VIOLATION, 2.0), (2, d.CONTROL, 4.0), (2, d.VIOLATION, 8.0), (3, d.CONTROL, 9.0)], "e int, c string, v double")
    g = one(ag.group_summary(jn.paired_difference(w, ["e"], "c", "v", d.CONTROL, d.VIOLATION).withColumn("k", F.lit(1)), ["k"], "difference"))
    assert (g["mean"], round(g["se"], 9), g["n"]) == (2.5, 1.5, 2)


def test_exclusion_list(spark):
    df = spark.createDataFrame([(7, 3, "legacy"), (7, 4, "legacy"), (8, 3, "overlay"), (20, 3, None)], "entity int, session int, source string")
    listed = spark.createDataFrame([(7, 3), (8, 3), (20, 3)], "entity int, session int")
    keys = lambda x: sorted((r["entity"], r["session"]) for r in x.collect())
    assert keys(fl.drop_listed(df, listed, ["entity", "session"])) == [(7, 4), (8, 3)]
    assert keys(fl.drop_listed(df, listed, ["entity", "session"], also_overlay=True)) == [(7, 4)]
    with pytest.raises(ValueError):
        fl.drop_listed(df.drop("session"), listed, ["entity", "session"])


@pytest.mark.parametrize("extra,expect", [([], (1, 120, 50, 5)), ([("S  5", 112)], (None, None, None, None))])
def test_as_of_hand_case(spark, extra, expect):
    marks = [("S 50", 100), ("S120", 105), ("S  1", 110), ("S101", 115)] + extra
    lines = [(f"Mk{i}=Stimulus,{c},{p},1,0",) for i, (c, p) in enumerate(sorted(marks, key=lambda x: x[1]), 2)] + [("; noise",)]
    m = rd.marker_fields(spark.createDataFrame(lines, "value string")).withColumn("rec", F.lit(1))
    c = F.col("code")
    out = jn.as_of_within_boundary(m, ["rec"], ["position", "seq"], c.isin(*d.BOUNDARY_CODES), F.col("position"), prop=F.when(c.isin(*d.PROPERTY_CODES), c),
                                   sentence=F.when(c.between(*d.SENTENCE_CODES), c), word=F.when(c.between(*d.WORD_CODES), c))
    r = one(out.filter("code = 101"))
    lag = None if r["prop_pos"] is None else r["position"] - r["prop_pos"]
    assert (r["prop"], r["sentence"], r["word"], lag) == expect


def test_posterior_hand_case(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (-1, 1, 2, 3, 5)], "model string, value double")
    r = one(dr.posterior_summary(df, ["model"]))
    assert (r["median"], r["pd"]) == (2.0, 0.8)
    assert r["ci_low"] == pytest.approx(-0.8) and r["ci_high"] == pytest.approx(4.8)
    assert one(spark.range(1).select(dr.term_key(F.lit("b_z_b:z_a")).alias("k")))["k"] == "z_a:z_b"


def test_bh_family(spark):
    p = [0.00899, 0.00599, 0.03, 0.003] + [0.7] * 13
    a = wn.adjust_p(spark.createDataFrame([(1, i, v) for i, v in enumerate(p)], "f int, i int, p double"), ["f"], "p", "i")
    assert one(a.agg(F.min("p_bh").alias("q")))["q"] == pytest.approx(0.051, abs=5e-4)


def test_distributions(spark):
    df = spark.createDataFrame([(float(x), (i + 0.5) / 200) for i, x in enumerate(np.linspace(-8, 8, 200))], "z double, p double")
    for r in df.select("z", "p", dist.norm_cdf("z").alias("c"), dist.norm_quantile("p").alias("q")).collect():
        assert r["c"] == pytest.approx(Z.cdf(r["z"]), abs=1e-12) and r["q"] == pytest.approx(Z.inv_cdf(r["p"]), abs=1e-12)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385) and dist.t_quantile(0.975, 1) == pytest.approx(12.706204736432095)
    for r in spark.range(1, 1500, 7).select("id", dist.t_quantile_col(0.975, F.col("id")).alias("t")).collect():
        assert r["t"] == pytest.approx(dist.t_quantile(0.975, r["id"]), abs=2e-10)
    assert dist.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05) and dist.gamma_tail(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert dist.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_stratum_logit_matches_dummies(spark):
    rng = np.random.default_rng(3)
    s, x = rng.integers(0, 6, 400), rng.normal(size=400).round(1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.6 * x + s / 5 - 0.5)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(s, x, y)], "s int, x double, y int")
    fit = st.stratum_logit(df, "y", ["x"], ["s"])
    X = np.column_stack([x, np.eye(6)[s]])
    b = np.zeros(7)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-X @ b))
        H = X.T @ (X * (mu * (1 - mu))[:, None])
        b = b + np.linalg.solve(H, X.T @ (y - mu))
    assert fit["beta"][0] == pytest.approx(b[0], abs=1e-7) and fit["se"][0] == pytest.approx(math.sqrt(np.linalg.inv(H)[0, 0]), abs=1e-6)


def test_leave_one_out_matches_refits(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(5):
        for i in range(8):
            y = i % 2
            rows.append((e * 100 + i, e, y, 0, (rng.normal(size=3) + 0.8 * y).tolist()))
    df = spark.createDataFrame(rows, "trial int, entity int, y int, time_bin int, pattern array<double>").withColumn("in_training", F.lit(True))
    got = one(dc.leave_one_entity_out(df, ["time_bin"], "entity", "pattern", "y", 3))
    ent, y, X = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
    aucs = []
    for e in range(5):
        tr, te = ent != e, ent == e
        a, b = X[tr & (y == 0)], X[tr & (y == 1)]
        sw = (np.cov(a.T) * (len(a) - 1) + np.cov(b.T) * (len(b) - 1)) / (len(a) + len(b) - 2)
        w = np.linalg.solve(sw + (dc.RIDGE * np.trace(sw) / 3 + dc.RIDGE_FLOOR) * np.eye(3), b.mean(0) - a.mean(0))
        s1, s0 = X[te & (y == 1)] @ w, X[te & (y == 0)] @ w
        aucs.append(np.mean([(p > q) + 0.5 * (p == q) for p in s1 for q in s0]))
    assert got["n_folds"] == 5 and got["auc"] == pytest.approx(np.mean(aucs), abs=1e-9)


def test_permutations_keep_counts(spark):
    df = spark.createDataFrame([(i, i % 3, int(i % 4 == 0)) for i in range(60)], "id int, s int, y int")
    p = st.permuted_indicator(df, ["s"], "id", "y", 10, 1).groupBy("perm", "s").agg(F.sum("shuffled").alias("a"), F.sum("y").alias("b"))
    assert p.filter("a <> b").count() == 0
    r = one(st.permutation_condition(df.withColumn("x", (F.col("id") % 5 == 0).cast("int")), "x", "y", ["s"], 10, 1))
    assert 1 / 11 <= r["p"] <= 1


def test_cluster_floor_and_family_guard(spark):
    grid = [(0, t, 0.9 if 2 <= t <= 4 else 0.4) for t in range(8)] + [(b, t, 0.5) for b in range(1, 40) for t in range(8)]
    g = spark.createDataFrame(grid, "perm int, time_bin int, auc double")
    c, _ = dc.cluster_test(g, [])
    r = one(c)
    assert (r["start"], r["stop"], r["n_points"]) == (2, 4, 3) and r["cluster_p"] == pytest.approx(1 / 40) and r["significant"]
    with pytest.raises(ValueError, match="raise the permutation count"):
        dc.confirmatory_fdr(c, F.lit(True), 10)


def test_temporal_generalisation_query_is_whole(spark):
    """Every training bin against every test bin of the stand-in patterns."""
    import __spark_entry__ as entry

    cells = {(r.train_bin, r.test_bin) for r in entry.queries()["m27_temporal_generalisation"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).collect()}
    assert cells == {(a, b) for a in range(N_BINS) for b in range(N_BINS)}


def test_convergence_of_independent_chains(spark):
    rng = np.random.default_rng(11)
    rows = [("m", "b", c, i, float(v)) for c in range(4) for i, v in enumerate(rng.normal(size=250))]
    r = one(dr.convergence(spark.createDataFrame(rows, "model string, parameter string, chain int, iter int, value double"), ["model", "parameter"]))
    assert r["max_rhat"] < 1.02 and 500 < r["min_ess_bulk"] < 2000 and r["n_divergent"] == 0


def test_filter_gain_and_margins():
    fs, n = 500.0, 2000
    t = np.arange(n) / fs
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 120 * t), np.full(n, 3.0)])
    y = sg.zero_phase(x, sg.filter_sections(1.0, 30.0, fs))
    mid = slice(700, 1300)
    assert np.abs(y[0, mid]).max() == pytest.approx(1.0, abs=0.02) and np.abs(y[1, mid]).max() < 0.02 and np.abs(y[2]).max() < 1e-6
    half = sg.zero_phase(np.sin(2 * np.pi * 30 * t)[None, :], sg.filter_sections(None, 30.0, fs))
    assert np.abs(half[0, mid]).max() == pytest.approx(math.sqrt(0.5), abs=0.01)
    assert sg.decay_samples(sg.butterworth2(sg.two_pass_cutoff(1.0, fs, 2, "highpass"), fs, "highpass")) == 970


def test_chunks_equal_whole_with_margins(spark):
    rng = np.random.default_rng(2)
    whole = rng.normal(size=400)
    blocks = spark.createDataFrame([("r", i, whole[i * 100:(i + 1) * 100].tolist()) for i in range(4)], "rec string, block int, samples array<double>")
    c = sg.with_margins(blocks, ["rec"], "block", "samples", 100)
    got = {r["block"]: r["samples"] for r in sg.filter_chunks(c, "samples", ("keep_start", "keep_length"), None, 30.0, 500.0).collect()}
    want = sg.zero_phase(whole[None, :], sg.filter_sections(None, 30.0, 500.0))[0]
    for i in range(4):
        assert len(got[i]) == 100 and np.abs(np.array(got[i]) - want[i * 100:(i + 1) * 100]).max() < 1e-6


def test_log_sniffing_and_names(spark, tmp_path):
    (tmp_path / "Session 2").mkdir()
    (tmp_path / "Session 2" / "subject-7.csv").write_text("a,b;c\n1,NA\n2,x\n")
    (tmp_path / "Session 2" / "Subject-9-Test.csv").write_text("a;b\n3;undefined\n")
    (tmp_path / "Session 2" / "notes.csv").write_text("a,b\n")
    n = {r["file"]: (r["session"], r["entity"], r["part"]) for r in lg.log_listing(spark, str(tmp_path)).collect()}
    assert n == {"subject-7.csv": (2, 7, ""), "Subject-9-Test.csv": (2, 9, "test"), "notes.csv": (2, None, None)}
    files = [str(tmp_path / "Session 2" / f) for f in ("subject-7.csv", "Subject-9-Test.csv")]
    rows = lg.read_logs(spark, files).collect()
    assert sorted((r["a"], r["b"], r["b;c"]) for r in rows if r["a"] == "3") == [("3", None, None)]
    assert sorted((r["a"], r["b;c"] or "") for r in rows if r["a"] != "3") == [("1", ""), ("2", "x")]


def test_ascii_scan(spark):
    line = "Cz " + " ".join(f"{i},5" for i in range(1200))
    s = rd.ascii_samples(spark.createDataFrame([(line,)], "value string"), 600, -100, 2)
    r = s.filter("trial_no = 1 and sample_no = 599").collect()[0]
    assert (r["sensor"], r["time_ms"], r["amplitude"], s.count()) == ("Cz", 1098, 1199.5, 1200)
    with pytest.raises(Exception, match="do not align"):
        rd.ascii_samples(spark.createDataFrame([("Cz 1 2 3",)], "value string"), 2, 0, 1).collect()


def test_blob_ids_and_manifest(spark):
    b = F.encode(F.col("t"), "UTF-8")
    df = spark.createDataFrame([("e", ""), ("h", "hello\n")], "path string, t string").select("path", b.alias("content"))
    ids = {r["path"]: r["i"] for r in df.select("path", so.git_blob_id(F.col("content")).alias("i")).collect()}
    assert ids == {"e": "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "h": "ce013625030ba8dba906f756967f9e9ca394464a"}
    man = spark.createDataFrame([("h", ids["h"]), ("e", ids["h"]), ("gone", ids["e"])], "path string, blob string")
    copy = spark.createDataFrame([("h", "hello\r\n"), ("e", "")], "path string, t string").select("path", b.alias("content"))
    assert {r["path"]: r["state"] for r in so.verify_manifest(man, copy).collect()} == {"h": "ok", "e": "differs", "gone": "missing"}


def test_write_guard(tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    os.symlink(root, tmp_path / "link")
    for bad in (root / "x", tmp_path / "link" / "x"):
        with pytest.raises(ValueError):
            so.guard_output(str(bad), str(root))
    assert so.guard_output(str(tmp_path / "out"), str(root))


def test_roster_problems(spark):
    raw = spark.createDataFrame([("1", "H1", d.GROUP_ODD), ("2", "H2", d.GROUP_ODD), ("2.5", "H3", d.GROUP_EVEN), ("4", "H1", None), (None, " ", "x"), ("1", "H9", d.GROUP_ODD)],
                                "entity string, home string, grp string")
    good, bad = so.roster(raw, ["home"], "entity", "grp")
    assert good.count() == 4
    assert sorted({r["check_name"] for r in bad.collect()}) == ["duplicate entity", "duplicate home", "group without id", "id not whole", "id without group", "parity mismatch"]


def test_sequence_alignment(spark):
    mk = lambda codes, name: spark.createDataFrame([(1, i, c, i) for i, c in enumerate(codes)], f"rec int, t int, code int, {name} bigint")
    out = jn.align_sequences(mk([1, 2, 3, 4, 5], "a"), mk([9, 2, 3, 5], "b"), ["rec"], "t", "code", "a", "b")
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(1, 1), (2, 2), (4, 3)]


def test_duplicate_lookup_refused(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeated keys"):
        jn.checked_left_join(spark.createDataFrame([(1,)], "k int"), dim, ["k"])


# --- matching and reading: repeated stamps, contested events, cut files -------------------

@pytest.mark.parametrize("events, segments, expected", [
    ([(1, 1000), (2, 1000)], [(10, 1000), (11, 1500)], {(1, 10), (2, 11)}),
    ([(1, 1000), (2, 2500)], [(10, 1100), (11, 1200)], {(1, 10), (2, 11)}),
    ([(1, 0), (2, 9000)], [(10, 3000), (11, None)], set()),
])
def test_clock_match_finds_free_neighbours(spark, events, segments, expected):
    from trialweave.operators.joins import clock_match

    ev = spark.createDataFrame([("r", *e) for e in events], "rec string, event_id long, us long")
    sg = spark.createDataFrame([("r", *s) for s in segments], "rec string, segment_id long, us long")
    got = {(r.event_id, r.segment_id) for r in clock_match(ev, sg, ["rec"], "us", "event_id", "segment_id", 2000).collect()}
    assert got == expected


def test_truncated_files_keep_padded_records(spark, tmp_path):
    from trialweave.sources.logs import read_truncated

    (tmp_path / "a.csv").write_text("1,2,x\n3,4\n5,6,y\n7")
    (tmp_path / "b.csv").write_text("8,9,z\n")
    good, note = read_truncated(spark, str(tmp_path), "a long, b long, c string")
    assert sorted((r.a, r.b, r.c) for r in good.collect()) == [(1, 2, "x"), (3, 4, None), (5, 6, "y"), (8, 9, "z")]
    assert sorted((r.n_records, r.n_padded, r.n_cut) for r in note.collect()) == [(1, 0, 0), (4, 1, 1)]


def test_hypergeometric_draws_follow_their_law():
    from itertools import combinations

    from trialweave.operators.stats import hypergeometric_draws

    n, ones, hits = 9, 4, 3
    exact = np.bincount([sum(i < hits for i in c) for c in combinations(range(n), ones)], minlength=4) / 126
    grid = (np.arange(126_000) + 0.5) / 126_000
    assert np.allclose(np.bincount(hypergeometric_draws(n, ones, hits, grid), minlength=4) / len(grid), exact, atol=1e-4)
    assert set(hypergeometric_draws(10**7, 5 * 10**6, 10, grid)) == set(range(11))


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from trialweave.runtime import shared_root

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
