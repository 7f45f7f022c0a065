"""Aggregations: two-level window means, entity-balanced summaries, signal detection, inventories, durations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialweave.functions import design as d
from trialweave.functions.dist import norm_quantile, t_quantile_col
from trialweave.operators.filters import in_windows, rt_rule, valid_trials
from trialweave.operators.joins import paired_difference
from trialweave.operators.skew import first_per_key, scan_shift, with_group_stats


def trial_window_means(samples: DataFrame, windows: DataFrame, unit: list[str], region: str = "region",
                       value: str = "amplitude") -> DataFrame:
    """Mean over a region's samples, then the equal-weight mean over regions, per trial and window."""
    per_region = in_windows(samples, windows).groupBy(*unit, "window_name", region).agg(F.avg(value).alias("_v"))
    return per_region.groupBy(*unit, "window_name").agg(F.count(F.lit(1)).alias("n_regions"), F.avg("_v").alias("mean_value"))


def require_regions(df: DataFrame, n_expected: int) -> DataFrame:
    """Stop when a trial window lacks a region (raised inside the job, on the offending row)."""
    msg = F.concat(F.lit("expected "), F.lit(n_expected), F.lit(" regions, found "), F.col("n_regions"))
    ok = F.assert_true(F.col("n_regions") == n_expected, msg)
    return df.withColumn("n_regions", F.coalesce(ok.cast("bigint"), F.col("n_regions")))


def trial_baselines(samples: DataFrame, unit: list[str], region: str = "region", value: str = "amplitude") -> DataFrame:
    per_region = samples.filter("time_ms < 0").groupBy(*unit, region).agg(F.avg(value).alias("_v"))
    return per_region.groupBy(*unit).agg(F.avg("_v").alias("baseline"))


def entity_waveforms(samples: DataFrame, keys: list[str], value: str = "amplitude") -> DataFrame:
    return samples.groupBy(*keys, "time_ms").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_obs"))


def baseline_correct(df: DataFrame, keys: list[str], value: str, missing: float | None = None) -> DataFrame:
    """x - mean(x where time < 0) within a waveform; ``missing`` replaces an absent baseline."""
    out = with_group_stats(df, keys, _b=F.avg(F.when(F.col("time_ms") < 0, F.col(value))))
    base = F.col("_b") if missing is None else F.coalesce(F.col("_b"), F.lit(missing))
    return out.withColumn(value, F.col(value) - base).drop("_b")


def binned_waveforms(df: DataFrame, keys: list[str], bin_of: Column, value: str, name: str) -> DataFrame:
    """Mean per time bin of x - mean(x where time < 0); a waveform without a baseline is left as it is.

    The mean of differences is the difference of means, so samples are aggregated once and the baseline is taken off
    the few bins of a waveform.
    """
    early = F.when(F.col("time_ms") < 0, F.col(value))
    g = df.groupBy(*keys, bin_of.alias("bin")).agg(F.avg(value).alias("_v"), F.sum(early).alias("_s"), F.count(early).alias("_n"))
    wave = W.partitionBy(*keys)
    base = F.sum("_s").over(wave) / F.nullif(F.sum("_n").over(wave), F.lit(0))
    return g.select(*keys, "bin", (F.col("_v") - F.coalesce(base, F.lit(0.0))).alias(name))


def summary_columns(value: str, prefix: str = "") -> list[Column]:
    """mean, sd, se (null for one entity) and n of entity values."""
    n = F.count(value)
    sd = F.when(n > 1, F.stddev_samp(value))
    return [F.avg(value).alias(f"{prefix}mean"), sd.alias(f"{prefix}sd"), (sd / F.sqrt(n)).alias(f"{prefix}se"),
            n.alias(f"{prefix}n")]


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*summary_columns(value))


def add_pooled_session(df: DataFrame, keys: list[str], value: str, session: str = "session") -> DataFrame:
    """Append the level "pooled": each entity's mean over its sessions (never a ROLLUP of rows)."""
    pooled = df.groupBy(*keys).agg(F.avg(value).alias(value)).withColumn(session, F.lit("pooled"))
    return df.select(*keys, value, F.col(session).cast("string").alias(session)).unionByName(pooled)


def t_interval(df: DataFrame, mean: str, se: str, n: str, level: float = 0.975, clamp: bool = False) -> DataFrame:
    """Student interval on a small per-group table."""
    out = df.withColumn("_t", t_quantile_col(level, F.col(n) - 1))
    low, high = F.col(mean) - F.col("_t") * F.col(se), F.col(mean) + F.col("_t") * F.col(se)
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return out.withColumns({"ci_low": F.when(F.col("_t").isNotNull(), low),
                            "ci_high": F.when(F.col("_t").isNotNull(), high)}).drop("_t")


def judgement_trials(raw: DataFrame, screen: bool = True) -> DataFrame:
    """Valid rows, then the first row per trial key in file order, then the response-time rule."""
    first = first_per_key(valid_trials(raw), ["entity", "session", "property", "k"], ["ts", "event_id"])
    return rt_rule(first, "rt", screen)


def balanced_proportion(trials: DataFrame, group: list[str], entity: str = "entity", y: str = "correct") -> DataFrame:
    per = trials.groupBy(*group, entity).agg(F.avg(y).alias("p"), F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(*group).agg(*summary_columns("p"), F.sum("_n").alias("n_trials"))
    return t_interval(out, "mean", "se", "n", clamp=True)


def signal_detection(trials: DataFrame, group: list[str], entity: str = "entity") -> DataFrame:
    """Log-linear d' and criterion per entity (entities with both conditions only)."""
    gram, ungram = F.col("condition") == d.CONTROL, F.col("condition") == d.VIOLATION
    said = F.when(gram, F.col("correct")).otherwise(1 - F.col("correct"))
    per = trials.groupBy(*group, entity).agg(
        F.count_if(gram).alias("n_gram"), F.count_if(ungram).alias("n_ungram"),
        F.sum(F.when(gram, said).otherwise(0)).alias("hits"), F.sum(F.when(ungram, said).otherwise(0)).alias("fas"))
    per = per.filter("n_gram > 0 and n_ungram > 0").withColumns({
        "p_h": (F.col("hits") + 0.5) / (F.col("n_gram") + 1), "p_f": (F.col("fas") + 0.5) / (F.col("n_ungram") + 1)})
    per = per.withColumns({"z_h": norm_quantile("p_h"), "z_f": norm_quantile("p_f")})
    return per.withColumns({"d_prime": F.col("z_h") - F.col("z_f"), "criterion": -(F.col("z_h") + F.col("z_f")) / 2})


def long_measures(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    return df.unpivot(ids, measures, "measure", "value")


def gate_outcomes(flags: DataFrame, subject: list[str], file: str, order: list[str]) -> DataFrame:
    """Two-attempt gate outcome per subject from each file's yes/no sequence, without collecting it.

    The collapsed sequence is "yes" when every value is yes, "no" when every value is no; it ends in
    "->yes" when the last value is yes after another one; "no->yes" is any adjacent pair.
    """
    rows = flags.filter("outcome is not null and outcome <> ''")
    step = scan_shift(rows, subject + [file], order, _prev=F.col("outcome"))
    at = F.struct(*[F.col(c) for c in order])
    per_file = step.groupBy(*subject, file).agg(
        F.min("outcome").alias("lo"), F.max("outcome").alias("hi"), F.max_by("outcome", at).alias("last"),
        F.coalesce(F.bool_or((F.col("_prev") == "no") & (F.col("outcome") == "yes")), F.lit(False)).alias("no_yes"))
    one = F.col("lo") == F.col("hi")
    seqs = per_file.groupBy(*subject).agg(
        F.bool_or(F.col("no_yes") | (~one & (F.col("last") == "yes"))).alias("second"),
        F.bool_or(one & (F.col("lo") == "yes")).alias("first"), F.bool_or(one & (F.col("lo") == "no")).alias("failed"))
    tests = flags.groupBy(*subject).agg(F.bool_or("has_test").alias("any_test"))
    out = tests.join(seqs, subject, "left")
    label = (F.when(F.col("second"), "passed_attempt2").when(F.col("first"), "passed_attempt1")
             .when(F.col("failed"), "failed_gate").when(F.col("second").isNotNull() | F.col("any_test"), "completed_test_no_gate")
             .otherwise("no_data"))
    return out.select(*subject, label.alias("outcome"))


def following_onsets(df: DataFrame, words: str, onsets: str, durations: str, target: str, max_soa: int, window: int) -> DataFrame:
    """Per trial: onsets after the target word, or the reason the trial is left out.

    Words count up to the first empty slot; arrays are short, fixed-slot lists of one trial.
    """
    present = F.transform(F.col(words), lambda w: F.coalesce(F.trim(w) != "", F.lit(False)))
    tp, ons, n, base = F.col(target), F.col("_ons"), F.col("_n"), F.col("_base")
    # one column per step, so that none is computed again inside another
    out = df.withColumn("_gap", F.array_position(present, False))
    out = out.withColumn("_n", F.when(F.col("_gap") == 0, F.size(words)).otherwise(F.col("_gap") - 1).cast("int"))
    out = out.withColumn("_ons", F.slice(F.col(onsets), F.lit(1), n))
    after = F.greatest(tp, F.lit(0)).cast("int")  # place of the next word, from 0
    out = out.withColumn("_base", F.when(tp < n, F.element_at(ons, tp)))
    out = out.withColumn("_first", F.get(ons, after) - base)
    first = F.col("_first")
    reason = (F.when(F.exists("_ons", lambda x: x.isNull()), "missing_onset").when(tp >= n, "no_following_word")
              .when(F.element_at(F.col(durations), tp).isNull(), "missing_duration")
              .when((first <= 0) | (first > max_soa), "soa_out_of_range"))
    out = out.withColumn("excluded", reason)
    ok = F.col("excluded").isNull()
    later = F.slice(ons, after + 1, F.size(ons))
    return out.withColumns({
        "first_onset": F.when(ok, first), "second_onset": F.when(ok, F.get(ons, after + 1) - base),
        "n_within": F.when(ok, F.size(F.filter(later, lambda x: (x - base > 0) & (x - base <= window)))),
    }).drop("_gap", "_n", "_ons", "_base", "_first")


def phase_durations(df: DataFrame, unit: list[str], phases: list[str], clock: str, phase: str) -> DataFrame:
    """First start per phase; end = nearest later phase start, else the phase's own last event."""
    starts = df.groupBy(*unit).agg(
        *[F.min(F.when(F.col(phase) == p, F.col(clock))).alias(f"start_{p}") for p in phases],
        *[F.max(F.when(F.col(phase) == p, F.col(clock))).alias(f"last_{p}") for p in phases])
    structs = []
    for i, p in enumerate(phases):
        s = F.col(f"start_{p}")
        later = [F.when(F.col(f"start_{q}") > s, F.col(f"start_{q}")) for q in phases[i + 1:]]
        nxt = F.least(*later) if len(later) > 1 else (later[0] if later else F.lit(None).cast("bigint"))
        own = F.when(F.col(f"last_{p}") > s, F.col(f"last_{p}"))
        structs.append(F.struct(F.lit(p).alias("phase"), s.alias("start"), F.coalesce(nxt, own).alias("end"),
                                F.when(nxt.isNotNull(), "next phase start").otherwise("last phase event").alias("boundary")))
    long = starts.select(*unit, F.explode(F.array(*structs)).alias("x")).select(*unit, "x.*")
    return long.filter("start is not null and end > start")


def error_metrics(df: DataFrame, keys: list[str], error: str, tail: DataFrame) -> DataFrame:
    """n, RMSE and max |error|, joined with a tail quantile table of |error|."""
    e = F.col(error)
    g = df.groupBy(*keys).agg(F.count(error).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs"))
    return g.join(tail, keys)


def hull_vertices(points: np.ndarray) -> np.ndarray:
    """Convex hull vertices of a small point set (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    both = half(pts) + half(pts[::-1])
    return np.array(both) if both else pts[[0, -1]]


def hull_diameter(hull: np.ndarray) -> float:
    """Largest distance between hull vertices in order, by rotating calipers."""
    n = len(hull)
    if n < 3:
        return float(np.hypot(*(hull[-1] - hull[0]))) if n else 0.0
    area = lambda i, j: abs((hull[(i + 1) % n][0] - hull[i][0]) * (hull[j][1] - hull[i][1]) - (hull[(i + 1) % n][1] - hull[i][1]) * (hull[j][0] - hull[i][0]))
    best, j = 0.0, 1
    for i in range(n):
        while area(i, (j + 1) % n) > area(i, j):
            j = (j + 1) % n
        for a, b in ((i, j), ((i + 1) % n, j), (i, (j + 1) % n)):  # the third covers parallel edges
            best = max(best, float(np.hypot(*(hull[a] - hull[b]))))
    return best


def planar_spread(df: DataFrame, key: str, x: str, y: str, fan: int = 64) -> DataFrame:
    """Largest pairwise distance per key: hulls of batches, merged ``fan`` ways before one task per key takes the rest; no pairs."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {x} double, {y} double"

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(hull_vertices(g[[x, y]].to_numpy(float)), columns=[x, y]).assign(**{key: k}) for k, g in pdf.groupby(key, dropna=False)]
        return pd.concat(parts)[[key, x, y]] if parts else pdf[[key, x, y]]

    def reduce_batch(batches):
        for pdf in batches:
            yield hulls(pdf)

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "spread": [hull_diameter(hull_vertices(pdf[[x, y]].to_numpy(float)))]})

    pts = df.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna(subset=[x, y])
    small = pts.mapInPandas(reduce_batch, schema).distinct()
    some = small.groupBy(key, F.pmod(F.xxhash64(x, y), F.lit(fan))).applyInPandas(hulls, schema)
    return some.groupBy(key).applyInPandas(widest, f"{key} {df.schema[key].dataType.simpleString()}, spread double")


def modal_value(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Most frequent combination per key; ties go to the smallest."""
    n = df.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("neg"), *cols)).alias("_b"), F.count(F.lit(1)).alias("n_variants"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in cols], "n_variants")


def quantity_table(one_row: DataFrame, notes: dict[str, tuple[str, str]]) -> DataFrame:
    """A one-row aggregate as (quantity, value, unit, note) rows."""
    rows = [F.struct(F.lit(q).alias("quantity"), F.col(q).cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(t).alias("note"))
            for q, (u, t) in notes.items()]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def windowed_differences(samples: DataFrame, windows: DataFrame, unit: list[str], sensor: str) -> DataFrame:
    m = in_windows(samples, windows).groupBy(*unit, sensor, "window_name", "condition").agg(F.avg("amplitude").alias("_v"))
    return paired_difference(m, unit + [sensor, "window_name"], "condition", "_v", d.CONTROL, d.VIOLATION)
