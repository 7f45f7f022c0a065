"""Mechanisms that split work over tasks, against plain loops: label draws, decoding grid, alignment, streams, margins, hulls, lags."""

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import aggregate as ag
from trialweave.operators import decode as dc
from trialweave.operators import draws as dr
from trialweave.operators import joins as jn
from trialweave.operators import permute as pm
from trialweave.operators import signal as sg
from trialweave.operators import stats as st
from trialweave.sources import logs as lg
from trialweave.sources import recordings as rd
from trialweave.streaming import jobs


# label draws ----------------------------------------------------------------------------------------------------------


def test_labels_keep_counts_and_balance():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 37)
    constants = pm.draw_constants(7, 200)
    label, train = pm.label_matrix("s", list(range(37)), y, 7, constants)
    kept = min(y.sum(), 37 - y.sum())
    assert (label.sum(axis=1) == y.sum()).all() and (label[0] == y).all()
    assert ((label & train).sum(axis=1) == kept).all() and ((~label & train).sum(axis=1) == kept).all()
    assert abs(label[1:].mean(axis=0) - y.mean()).max() < 0.15  # each trial gets label 1 about as often


def test_split_strata_shuffle_as_a_whole(spark):
    rows = [(s, i, int(i % 3 == 0), float(i)) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, unit int, y int, x double")
    one = {r.perm: r.stat for r in pm.draw_sums(df.withColumn("x", F.lit(1.0)), ["s"], "unit", "y", "x", 50, 3, chunk_rows=7).collect()}
    assert {round(v, 9) for v in one.values()} == {60.0}  # 20 ones in each of three strata, in every draw
    whole, cut = ([r.stat for r in pm.draw_sums(df, ["s"], "unit", "y", "x", 400, 3, chunk_rows=n).orderBy("perm").collect()] for n in (1000, 7))
    assert whole[0] == pytest.approx(cut[0]) == 3 * sum(i for i in range(60) if i % 3 == 0)
    sd = math.sqrt(3 * 20 * 40 * np.var(range(60)) / 59)  # of a sum of 20 drawn from 60, three times
    for draws in (whole[1:], cut[1:]):
        assert abs(np.mean(draws) - 3 * 20 * 29.5) < 5 * sd / 20 and 0.85 < np.std(draws) / sd < 1.15


def test_bootstrap_sums(spark):
    rows = [(g, i, float((i * 7) % 13)) for g in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, unit int, v double")
    for n in (1000, 9):
        out = {r.g: r for r in pm.resample_sums(df, ["g"], "unit", "v", 500, 5, chunk_rows=n).collect()}
        x = np.array([r[2] for r in rows[:40]])
        for g in range(2):
            means = np.array(out[g].sums) / out[g].n
            assert out[g].n == 40 and abs(means.mean() - x.mean()) < 5 * x.std() / math.sqrt(40 * 500) and 0.85 < means.std() / (x.std() / math.sqrt(40)) < 1.15
    q = {r.g: r for r in st.bootstrap_mean(df, ["g"], "unit", "v", 500, 5).collect()}
    assert all(q[g].low < x.mean() < q[g].high for g in q)


# decoding grid --------------------------------------------------------------------------------------------------------

SCHEMA = "trial int, entity int, y int, time_bin int, pattern array<double>"


def patterns(seed, sizes, bins=2, p=3):
    rng = np.random.default_rng(seed)
    rows = []
    for e, n in enumerate(sizes):
        for i in range(n):
            y = int(i % 3 == 0) if e % 2 else i % 2
            rows += [(e * 1000 + i, e, y, t, (rng.normal(size=p) + 0.7 * y * t).tolist()) for t in range(bins)]
    return rows


def auc(s, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]])


def brute_grid(rows, n_perm, seed, p=3):
    constants, out = pm.draw_constants(seed, n_perm), {}
    entities = sorted({r[1] for r in rows})
    trials = {e: sorted({(r[0], r[2]) for r in rows if r[1] == e}) for e in entities}
    drawn = {e: pm.label_matrix(str(e), [t for t, _ in own], np.array([y for _, y in own]), seed, constants) for e, own in trials.items()}
    x = {(r[0], r[3]): np.array(r[4]) for r in rows}
    for b in range(n_perm + 1):
        for t in sorted({r[3] for r in rows}):
            aucs = []
            for held in entities:
                a, c = [], []
                for e in entities:
                    if e != held:
                        label, train = drawn[e]
                        for k, (trial, _) in enumerate(trials[e]):
                            if train[b, k]:
                                (c if label[b, k] else a).append(x[trial, t])
                a, c = np.array(a), np.array(c)
                sw = ((a - a.mean(0)).T @ (a - a.mean(0)) + (c - c.mean(0)).T @ (c - c.mean(0))) / (len(a) + len(c) - 2)
                w = np.linalg.solve(sw + (dc.RIDGE * np.trace(sw) / p + dc.RIDGE_FLOOR) * np.eye(p), c.mean(0) - a.mean(0))
                aucs.append(auc(np.array([x[trial, t] @ w for trial, _ in trials[held]]), drawn[held][0][b]))
            out[b, t] = np.mean(aucs)
    return out


def test_grid_equals_refits(spark):
    rows = patterns(1, [8, 9, 12, 7])
    got = dc.decode_grid(spark.createDataFrame(rows, SCHEMA), [], "entity", "trial", "y", 12, 3, 3, block=5).collect()
    want = brute_grid(rows, 12, 3)
    assert {(r.perm, r.time_bin) for r in got} == set(want)
    assert all(r.auc == pytest.approx(want[r.perm, r.time_bin], abs=1e-9) and r.n_folds == 4 for r in got)


def test_grid_with_a_large_entity(spark):
    """Balanced classes keep every row, so the observed course is the same however an entity is cut."""
    rng = np.random.default_rng(2)
    rows = [(e * 1000 + i, e, i % 2, t, (rng.normal(size=3) + 0.5 * (i % 2)).tolist()) for e, n in enumerate([60, 8, 10, 12]) for i in range(n) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = ({(r.perm, r.time_bin): r for r in dc.decode_grid(df, [], "entity", "trial", "y", 30, 3, 3, chunk_rows=n, block=7).collect()} for n in (1000, 11))
    assert set(whole) == set(cut)
    for t in range(2):
        assert cut[0, t].auc == pytest.approx(whole[0, t].auc, abs=1e-9) and cut[0, t].n_folds == 4
        null = np.array([cut[b, t].auc for b in range(1, 31)])
        assert abs(null.mean() - 0.5) < 0.1
    one, many = ({(r.channel, r.time_bin, r.perm): r.auc for r in dc.channel_course(df, [], "entity", "trial", "y", 9, 3, 3, chunk_rows=n).collect()} for n in (1000, 11))
    assert set(one) == set(many) and len(one) == 3 * 2 * 10
    assert all(many[k] == pytest.approx(v, abs=1e-9) for k, v in one.items() if k[2] == 0)


@pytest.mark.parametrize("grid", [dc.decode_grid, dc.channel_course])
def test_nothing_of_entities_times_draws_is_kept(spark, monkeypatch, grid):
    """What is written, and what sums over draws are keyed by, does not grow with the entities."""
    rng, written, keyed = np.random.default_rng(2), [], []
    pin, sums = dc.pin, dc.sum_arrays

    def kept(df):
        out = pin(df)
        lists = [c for c, kind in out.dtypes if kind == "array<double>"]
        written.append(sum(out.agg(F.sum(F.size(c))).first()[0] or 0 for c in lists))
        return out

    monkeypatch.setattr(dc, "pin", kept)
    monkeypatch.setattr(dc, "sum_arrays", lambda df, keys, *more, **named: keyed.extend(keys) or sums(df, keys, *more, **named))
    sizes = []
    for n in (6, 24):
        rows = [(e, 10 * e + k, k % 2, t, rng.normal(size=3).tolist()) for e in range(n) for k in range(6) for t in range(2)]
        df = spark.createDataFrame(rows, "entity int, trial int, y int, time_bin int, pattern array<double>")
        assert grid(df, [], "entity", "trial", "y", 8, 3, 3).count() > 0
        sizes.append(sum(written))
        written.clear()
    assert sizes[0] == sizes[1] and "entity" not in keyed


def test_channel_course_equals_loops(spark):
    rows = patterns(4, [8, 9, 12])
    got = {(r.channel, r.time_bin, r.perm): r.auc for r in dc.channel_course(spark.createDataFrame(rows, SCHEMA), [], "entity", "trial", "y", 6, 3, 3).collect()}
    constants = pm.draw_constants(3, 6)
    for (c, t, b), value in got.items():
        aucs = []
        for e in range(3):
            own = sorted((r[0], r[2], r[4][c]) for r in rows if r[1] == e and r[3] == t)
            label, _ = pm.label_matrix(str(e), [o[0] for o in own], np.array([o[1] for o in own]), 3, constants)
            aucs.append(auc(np.array([o[2] for o in own]), label[b]))
        assert value == pytest.approx(np.mean(aucs), abs=1e-9)


def test_families_per_channel(spark):
    rows = [("overall", "all", c, k, p, 1000) for c in range(2) for k, p in ((1, 0.02), (2, 0.04 if c else 0.001))] + [("by_session", "s2", 0, 1, 0.001, 1000)]
    df = spark.createDataFrame(rows, "analysis string, level string, channel int, cluster_id int, cluster_p double, n_perm long")
    out = {(r.analysis, r.channel, r.cluster_id): r for r in dc.confirmatory_fdr(df, F.col("analysis") == "overall", family=("channel",), keys=("analysis", "level", "cluster_id")).collect()}
    assert out["overall", 0, 2].cluster_p_fdr == pytest.approx(0.002) and out["overall", 0, 1].cluster_p_fdr == pytest.approx(0.02)
    assert out["overall", 1, 1].cluster_p_fdr == pytest.approx(0.04) and out["by_session", 0, 1].cluster_p_fdr is None and not out["by_session", 0, 1].significant_fdr
    with pytest.raises(ValueError, match="raise the permutation count"):
        dc.confirmatory_fdr(df.withColumn("n_perm", F.lit(10).cast("long")), F.col("analysis") == "overall", family=("channel",))


def test_region_means(spark):
    m = spark.createDataFrame([(i, j, i * 10.0 + j) for i in range(3) for j in range(3)], "tr int, te int, auc double")
    r = dc.region_means(m, {"corner": F.col("tr") + F.col("te") >= 3, "none": F.col("tr") > 5}).first()
    assert r.corner == pytest.approx((12 + 21 + 22) / 3) and r.none is None


# alignment ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [1, 3])
def test_alignment_across_tasks(spark, alphabet):
    rng = np.random.default_rng(alphabet)
    sides = {(u, s): rng.integers(0, alphabet, int(rng.integers(3, 14))).tolist() for u in range(2) for s in "ab"}
    frame = lambda s: spark.createDataFrame([(u, i, c, 100 * u + i) for u in range(2) for i, c in enumerate(sides[u, s])], f"rec int, t int, code int, {s} long")
    want = set()
    for u in range(2):
        a, b = sides[u, "a"], sides[u, "b"]
        want |= {(u, 100 * u + i + k, 100 * u + j + k, n) for n, (i, j, size) in enumerate(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for k in range(size)}
    for rows in (20_000, 9):
        out = jn.align_sequences(frame("a"), frame("b"), ["rec"], "t", "code", "a", "b", task_rows=rows)
        assert {tuple(r) for r in out.select("rec", "a", "b", "block_no").collect()} == want, rows


# streams --------------------------------------------------------------------------------------------------------------


def test_last_marker_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    codes = [*d.PROPERTY_CODES, *d.CONDITION_CODES, *d.BOUNDARY_CODES, 50]
    rows = [(0 if rng.random() < 0.9 else int(rng.integers(1, 4)), i, 10 * i, int(rng.choice(codes, p=[0.1] * 3 + [0.2] * 3 + [0.01] * len(d.BOUNDARY_CODES) + [0.1 - 0.01 * len(d.BOUNDARY_CODES)]))) for i in range(400)]
    schema = "recording long, seq long, pos long, code int"
    for k in range(5):
        spark.createDataFrame(rows[k * 80 : k * 80 + 80], schema).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    want, state = {}, {}
    for rec, seq, pos, code in rows:
        if code in d.CONDITION_CODES:
            prop, at = state.get(rec, (None, None))
            want[seq] = (rec, code, prop, None if at is None else pos - at)
        if code in d.BOUNDARY_CODES:
            state.pop(rec, None)
        elif code in d.PROPERTY_CODES:
            state[rec] = (code, pos)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path))
    got = {r.seq: (r.recording, r.code, r.prop_marker, r.lag_us) for r in jobs.run_last_marker(stream, "t").collect()}
    assert got == want
    short = {r.seq: r.lag_us for r in jobs.run_last_marker(stream, "t", keep=0).collect()}
    assert set(short) == set(want) and any(short[s] is None and want[s][3] is not None for s in want)  # carried markers expired
    assert all(short[s] in (None, want[s][3]) for s in want)


def test_keyed_tables_over_batches(spark, tmp_path):
    rows = [(k % 3, 1000 * k, float(k)) for k in range(60)]
    for b in range(3):
        spark.createDataFrame(rows[b::3], "key int, ts long, v double").coalesce(1).write.parquet(str(tmp_path / f"{b}"))
    read = lambda: spark.readStream.schema("key int, ts long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    first = {r.key: (r.ts, r.v) for r in jobs.run_first_rows(read(), ["key"], ["ts"], "t").collect()}
    assert first == {0: (0, 0.0), 1: (1000, 1.0), 2: (2000, 2.0)}
    stamped = read().withColumn("ts", F.timestamp_millis("ts")).withWatermark("ts", "1 hour")
    means = jobs.run_to_keyed_table(jobs.bin_means(stamped, ["key"], "ts", "20 seconds", "v"), ["w", "key"], "t").collect()
    want = {}
    for k, ts, v in rows:
        want.setdefault((k, ts // 20_000), []).append(v)
    assert {(r.key, int(r.w.start.timestamp()) // 20): (r.mean_value, r.n) for r in means} == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in want.items()}  # open windows too


# records, names, layout -----------------------------------------------------------------------------------------------


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,"a\nb, ""c""",3\n4,plain,6\n7,"two\n\nbreaks",9\n10,"cut of')
    good, note = lg.read_truncated(spark, str(tmp_path), "a int, b string, c int")
    assert {(r.a, r.b, r.c) for r in good.collect()} == {(1, 'a\nb, "c"', 3), (4, "plain", 6), (7, "two\n\nbreaks", 9)}
    assert tuple(note.select("n_records", "n_padded", "n_cut").first()) == (4, 0, 1)


def test_near_names_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    name = lambda: "".join(rng.choice(list("abc"), int(rng.integers(3, 8))))
    known, strange = sorted({name() for _ in range(40)}), sorted({name() for _ in range(40)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i, *[0] * len(b)]
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["name"], r.near, r.edits) for r in rd.near_names(frame(strange), frame(known)).collect()}
    assert got == {(a, b, edits(a, b)) for a in strange if a not in known for b in known if edits(a, b) <= 2}


def test_near_names_broadcast_no_keys(spark):
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    out = rd.near_names(frame(["abcd", "", None, "éa", "zz"]), frame(["abxd", "a", "é", None, "zz", "longer"]))
    assert {tuple(r) for r in out.collect()} == {("abcd", "abxd", 1), ("", "a", 1), ("", "é", 1), ("", "zz", 2), ("éa", "a", 1), ("éa", "é", 1), ("éa", "zz", 2)}
    assert "SortMergeJoin [_key" in out._jdf.queryExecution().executedPlan().toString()


def test_export_markers_are_read_once(spark):
    """Segments with wrong, missing and repeated markers; the markers are neither joined nor read again for the codes."""
    lines = ["New Segment,", "Stimulus,S110", "Stimulus,S101", "Time 0,", "New Segment,", "Stimulus,S253", "Stimulus,S102", "Stimulus,S110", "Comment,S103"]
    marks = [("a", i, f"Mk1={m},1,1,0") for i, m in enumerate(lines)] + [("b", 0, "Mk1=New Segment,,1,1,0"), ("c", 0, "Mk1=Stimulus,S120,1,1,0"), ("d", 0, "no marker")]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    text = "stem string, value string"
    out = rd.export_inventory(frame([("a", "Fz 1 2 3 4"), ("d", "Fz 1 2")], text), frame([("a", "DataPoints=4\nSegmentDataPoints=2\n")], text), frame(marks, "stem string, line int, value string"),
                              frame([("a", 101), ("b", 102), ("d", 103)], "stem string, cond_code int"), 2)
    got = {r["stem"]: tuple(r)[5:] for r in out.collect()}
    assert got == {"a": (2.0, 2, 2.0, True, 3, 2, 1, 1, 1, 1), "b": (None, 1, None, False, 0, None, 0, 0, 0, 0), "d": (None, None, 1.0, False, None, None, None, None, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") == 1


def test_onset_census_reads_trials_once(spark, tmp_path):
    from statistics import median

    from trialweave.plans.e1_aggregations import e19

    orders = [(k, k * 7 % 31, "OFP"[k % 3]) for k in range(1, 400)] + [(None, 3, "O"), (500, None, "F")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    firsts = {}
    for k, c, s in orders:
        if k is None or c is None:
            continue
        tp, n = 3 if k % 2 == 0 else 4, min(3 + c % 8, 10)
        ons = [i * 745 + k * i % 97 if (k + i) % 53 else None for i in range(1, n + 1)]
        if None not in ons and tp < n and (k + tp) % 29 and 0 < ons[tp] - ons[tp - 1] <= 800:
            firsts.setdefault(s, []).append(ons[tp] - ons[tp - 1])
    out = e19(spark, str(tmp_path))
    assert {r.session: (r.n_trials, r.next_onset_min, r.next_onset_median, r.next_onset_max) for r in out.collect() if r.session == "P"} == {"P": (len(firsts["P"]), min(firsts["P"]), median(firsts["P"]), max(firsts["P"]))}
    assert "orders.parquet" not in out._jdf.queryExecution().executedPlan().toString()


def test_overlay_files_are_written_by_many_tasks_and_read_once(spark, tmp_path, monkeypatch):
    from trialweave.plans import a_sources

    spark.createDataFrame([(n,) for n in range(3)], "n_nationkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    rows = [(k, f"S{k}", k % 3, -1.0 if k == 4 else 100.0) for k in range(40)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    roots, made = [], a_sources.scratch_dir
    monkeypatch.setattr(a_sources, "scratch_dir", lambda spark, label: roots.append(made(spark, label)) or roots[-1])
    out = a_sources.a20(spark, str(tmp_path))
    files = [f.name for f in __import__("pathlib").Path(roots[0]).rglob("part-*.txt")]
    assert len(files) == sum(n != 0 for _, _, n, _ in rows) and len({f.split("-")[1] for f in files}) > 1
    got = {tuple(r) for r in out.collect()}
    assert {stem for rule, stem in got if rule == "hash differs"} == {"S4"} and {stem for rule, stem in got if rule == "not on disk"} == {f"S{k}" for k, _, n, _ in rows if n == 0}
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()


def test_layout_check(spark):
    sheet = spark.createDataFrame([(1, "Participant\nID", "x"), (2, None, "Language 2"), (3, "5", "6")], "row int, c1 string, c2 string")
    cells = {(1, "c1"): "Participant ID", (2, "c2"): "^Language [1-4]$"}
    assert lg.check_layout(sheet, "row", cells).count() == 3
    with pytest.raises(ValueError, match="row 2, column c2"):
        lg.check_layout(sheet.withColumn("c2", F.lit("other")), "row", cells)


# signals, hulls, lags -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fc, margin", [(0.5, None), (0.05, None), (0.5, 37)])
def test_margins_over_several_blocks(spark, fc, margin):
    fs, rng = 500.0, np.random.default_rng(8)
    x = rng.normal(size=12_000).cumsum() * 0.01
    sections = sg.filter_sections(fc, None, fs)
    margin = margin or max(sg.decay_samples(s) for s in sections)
    edges = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 12_000), 60, replace=False)), [12_000]])
    rows = [(1, i, x[a:b].tolist()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))] + [(2, 0, [1.0, 2.0])]
    got = sg.with_margins(spark.createDataFrame(rows, "rec int, block int, samples array<double>"), ["rec"], "block", "samples", margin).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.rec == 1:
            a, b = int(edges[r.block]), int(edges[r.block + 1])
            assert r.samples == x[max(a - margin, 0) : b + margin].tolist() and r.keep_start == min(a, margin) and r.keep_length == b - a


def test_whole_signal_result_with_long_margins(spark):
    """Margins of many blocks give the filter of the whole signal to the decay that the margin was made for."""
    fs, rng = 500.0, np.random.default_rng(9)
    x = rng.normal(size=20_000)
    sections = sg.filter_sections(0.5, None, fs)
    margin = 2 * max(sg.decay_samples(s) for s in sections)
    blocks = spark.createDataFrame([(1, i, x[i * 250 : i * 250 + 250].tolist()) for i in range(80)], "rec int, block int, samples array<double>")
    assert margin > 5 * 250
    out = sg.filter_chunks(sg.with_margins(blocks, ["rec"], "block", "samples", margin), "samples", ("keep_start", "keep_length"), 0.5, None, fs)
    got = np.concatenate([r.samples for r in out.orderBy("block").collect()])
    whole = sg.zero_phase(x[None, :], sections)[0]
    assert np.abs(got - whole).max() < 2e-3 * np.abs(x).max()


def test_spread_equals_all_pairs(spark):
    rng = np.random.default_rng(10)
    points = {k: np.round(rng.normal(size=(n, 2)), 1) for k, n in enumerate([1, 2, 3, 50, 400])}
    points[5] = np.array([[float(i), 2.0 * i] for i in range(9)])  # on a line
    points[6] = np.array([[x, y] for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0, 2.0)])  # a grid with parallel edges
    rows = [(k, float(a), float(b)) for k, p in points.items() for a, b in p]
    got = {r.k: r.spread for r in ag.planar_spread(spark.createDataFrame(rows, "k int, x double, y double").repartition(6), "k", "x", "y", fan=3).collect()}
    for k, p in points.items():
        assert got[k] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)).max(), abs=1e-12)


def test_lag_sums_over_chunks(spark):
    rng = np.random.default_rng(11)
    chains = {c: rng.normal(size=n).cumsum() for c, n in enumerate([5, 64, 301])}
    df = spark.createDataFrame([(c, i + 3, float(v)) for c, x in chains.items() for i, v in enumerate(x)], "c int, i long, v double")
    got = {r.c: r for r in dr.lag_sums(df, ["c"], "i", {"v": "m"}, 40, chunk_rows=50).collect()}
    for c, x in chains.items():
        y = x - x.mean()
        want = [float((y[: len(y) - k] * y[k:]).sum()) if k < len(y) else 0.0 for k in range(40)]
        assert got[c].n == len(x) and np.allclose(got[c].sums, want, atol=1e-8)


def test_effective_size_asks_for_more_lags(spark):
    rng = np.random.default_rng(12)
    rows = []
    for chain in range(2):
        x = 0.0
        for i in range(600):
            x = 0.95 * x + rng.normal()
            rows.append((0, chain, 0, i, x))
    df = spark.createDataFrame(rows, "k int, chain int, half int, i long, v double")
    few, many = (dr.effective_sizes(df, ["k"], ["chain", "half"], "i", {"v": "ess"}, lags=n).first().ess for n in (4, 1024))
    assert few == pytest.approx(many, rel=1e-9) and 5 < many < 200


def test_covariance_null_is_exact_in_the_mean(spark):
    rows = [(s, i, int((i * s) % 4 == 0), float((i * 5) % 7)) for s in range(1, 4) for i in range(50)]
    r = st.permutation_covariance(spark.createDataFrame(rows, "s int, id int, y int, x double"), "y", "x", ["s"], "id", 300, 1).first()
    x = {s: np.array([q[3] for q in rows if q[0] == s]) for s in range(1, 4)}
    assert r.observed == pytest.approx(sum(y * (v - x[s].mean()) for s, _, y, v in rows)) and abs(r.null_mean) < 6 and 1 / 301 <= r.p <= 1
    assert Counter(type(v) for v in r.asDict().values()) == {float: 3}
