"""Posterior-draw algebra and comparison of result tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from trialweave.functions.dist import beta_inc, norm_quantile_sql
from trialweave.operators.permute import sum_arrays
from trialweave.operators.skew import exact_quantiles, mid_ranks, null_safe_join, scan_index, scan_min, with_group_stats
from trialweave.runtime import pin


def posterior_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median, 95 % equal-tailed interval and probability of direction."""
    q = exact_quantiles(df, keys, value, {"median": 0.5, "ci_low": 0.025, "ci_high": 0.975})
    x = F.col(value)
    up, down = F.avg((x > 0).cast("int")), F.avg((x < 0).cast("int"))
    pd_ = df.groupBy(*keys).agg(F.greatest(up, down).alias("pd"), F.count(value).alias("n_draws"))
    return null_safe_join(q, pd_, keys, "inner")


def credible(low: str = "ci_low", high: str = "ci_high") -> Column:
    return (F.col(low) > 0) | (F.col(high) < 0)


def term_key(parameter: Column) -> Column:
    """Order-free name of a model term: its components sorted and rejoined."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(parameter, "^b_", ""), ":")), ":")


def term_columns(draws: DataFrame, draw_key: list[str], terms: dict[str, list[str]]) -> DataFrame:
    """One row per draw with the needed terms as columns, found by component set."""
    d = draws.withColumn("_t", term_key(F.col("parameter")))
    wanted = {n: ":".join(sorted(parts)) for n, parts in terms.items()}
    d = d.filter(F.col("_t").isin(*wanted.values()))
    return d.groupBy(*draw_key).agg(*[F.max(F.when(F.col("_t") == k, F.col("value"))).alias(n) for n, k in wanted.items()])


def stack_contrasts(df: DataFrame, keys: list[str], contrasts: dict[str, Column]) -> DataFrame:
    """Long (contrast, value) rows; contrasts whose terms are absent vanish."""
    rows = F.array(*[F.struct(F.lit(n).alias("contrast"), c.cast("double").alias("value")) for n, c in contrasts.items()])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.contrast", "_r.value").filter("value is not null")


def design_codes(trials: DataFrame) -> DataFrame:
    """One row: standardised codes of the sessions and groups the contrasts need."""
    m = trials.agg(F.avg("c_session").alias("ms"), F.stddev_samp("c_session").alias("ss"), F.avg("c_group").alias("mg"), F.stddev_samp("c_group").alias("sg"),
                   F.avg("c_condition").alias("mc"), F.stddev_samp("c_condition").alias("sc"))
    z = lambda v, mu, sd: (F.lit(float(v)) - F.col(mu)) / F.col(sd)
    return m.select(*[z(i, "ms", "ss").alias(f"z_s{i}") for i in range(4)], z(0.5, "mg", "sg").alias("z_even"), z(-0.5, "mg", "sg").alias("z_odd"),
                    z(0.5, "mc", "sc").alias("z_control"), z(-0.5, "mc", "sc").alias("z_violation"))


C, S, G = "z_recoded_grammaticality", "z_recoded_session", "z_recoded_mini_language"
TERMS = {"i": ["Intercept"], "g": [C], "s": [S], "l": [G], "gs": [C, S], "gl": [C, G], "sl": [S, G], "gsl": [C, S, G]}


def retention_contrasts(draws: DataFrame, codes: DataFrame, draw_key: list[str]) -> DataFrame:
    """dz * (b_gs + b_gsl * l): overall, within each group, and their difference."""
    w = term_columns(draws, draw_key, {k: TERMS[k] for k in ("gs", "gsl")}).crossJoin(F.broadcast(codes))  # one-row table
    dz = F.col("z_s3") - F.col("z_s2")
    within = lambda z: dz * (F.col("gs") + F.col("gsl") * F.col(z))
    return stack_contrasts(w, draw_key, {
        "overall": dz * F.col("gs"), "within_even": within("z_even"), "within_odd": within("z_odd"), "group_difference": within("z_even") - within("z_odd")})


def first_session_contrasts(draws: DataFrame, codes: DataFrame, draw_key: list[str]) -> DataFrame:
    w = term_columns(draws, draw_key, {k: TERMS[k] for k in ("gl", "gsl")}).crossJoin(F.broadcast(codes))
    return stack_contrasts(w, draw_key, {"first_session_advantage": F.col("gl") + F.col("z_s0") * F.col("gsl")})


def detection_weights(code: dict[str, float]) -> dict[str, dict[str, float]]:
    """Every sensitivity and criterion contrast is linear in the model terms: its weight per term."""
    sessions = {"2": code["z_s0"], "3": code["z_s1"], "4": code["z_s2"], "6": code["z_s3"], "average": 0.0}
    groups = {"even": code["z_even"], "odd": code["z_odd"]}

    def eta(zc: float, zs: float, zl: float) -> np.ndarray:
        return np.array([1.0, zc, zs, zl, zc * zs, zc * zl, zs * zl, zc * zs * zl])

    def sensitivity(zs, zl):
        return eta(code["z_control"], zs, zl) + eta(code["z_violation"], zs, zl)

    def criterion(zs, zl):
        return (eta(code["z_violation"], zs, zl) - eta(code["z_control"], zs, zl)) / 2

    out: dict[str, np.ndarray] = {}
    for m, f in (("sensitivity", sensitivity), ("criterion", criterion)):
        at = {(s, g): f(zs, zl) for s, zs in sessions.items() for g, zl in groups.items()}
        for s in sessions:
            for g in groups:
                out[f"{m}|value|{g}|{s}"] = at[s, g]
            out[f"{m}|group_difference|even - odd|{s}"] = at[s, "even"] - at[s, "odd"]
        for span, first, last in (("first_to_last", "2", "6"), ("s4_to_s6", "4", "6")):
            change = {g: at[last, g] - at[first, g] for g in groups}
            for g in groups:
                out[f"{m}|change_{span}|{g}|{first}->{last}"] = change[g]
            out[f"{m}|change_{span}_group_difference|even - odd|{first}->{last}"] = change["even"] - change["odd"]
    return {n: dict(zip(TERMS, v.tolist())) for n, v in out.items()}


def detection_contrasts(draws: DataFrame, codes: DataFrame, draw_key: list[str]) -> DataFrame:
    """Sensitivity and criterion per group and session, group differences and changes across sessions.

    ``codes`` is one row of scalars; the fixed list of contrasts is exploded beside each draw.
    """
    weights = detection_weights(codes.first().asDict())
    wide = term_columns(draws, draw_key, TERMS)
    terms = F.array(*[F.coalesce(F.col(t), F.lit(0.0)) for t in TERMS])
    grid = F.array(*[F.struct(F.lit(n).alias("contrast"), F.array(*[F.lit(w[t]) for t in TERMS]).alias("w")) for n, w in weights.items()])
    d = wide.select(*draw_key, terms.alias("_b"), F.explode(grid).alias("_g"))
    value = F.aggregate(F.zip_with("_b", F.col("_g.w"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return d.select(*draw_key, "_g.contrast", value.alias("value"))


# --- convergence --------------------------------------------------------------------------

def rank_normal(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Normal scores of pooled mid-ranks, (r - 3/8) / (n + 1/4)."""
    d = mid_ranks(df, keys, value, "_r")
    d = with_group_stats(d, keys, _n=F.count(value))
    d = d.withColumn("_p", (F.col("_r") - 0.375) / (F.col("_n") + 0.25))
    return d.withColumn(name, F.expr(norm_quantile_sql("_p"))).drop("_r", "_n", "_p")


def split_rhat(df: DataFrame, keys: list[str], half: list[str], value: str) -> DataFrame:
    """Potential scale reduction over half chains, from per-half moments."""
    per = df.groupBy(*keys, *half).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).cast("double").alias("n"))
    g = per.groupBy(*keys).agg(F.avg("v").alias("w"), F.var_samp("m").alias("vm"), F.avg("n").alias("n"))
    return g.select(*keys, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("vm")) / F.col("w")).alias("rhat"))


def lag_sums(df: DataFrame, cols: list[str], order: str, values: dict[str, str], lags: int, chunk_rows: int = 8192) -> DataFrame:
    """(cols, measure, n, mean, sums): per chain and column the sums of centred products at lags 0 to ``lags`` - 1.

    A chain is cut into chunks of consecutive positions; a chunk also carries the next ``lags`` - 1 values, so each task
    adds the products that begin in its chunk, and the sums add up over chunks. No task holds a chain.
    """
    size = max(chunk_rows, lags)
    d = with_group_stats(df.select(*cols, order, *values), cols, _n=F.count(F.lit(1)), **{f"_m_{c}": F.avg(c) for c in values})
    d = d.withColumn("_chunk", F.floor(F.col(order) / size))
    into = F.when(F.col(order) - F.col("_chunk") * size < lags - 1, F.array(F.col("_chunk"), F.col("_chunk") - 1)).otherwise(F.array(F.col("_chunk")))
    d = d.withColumn("_in", F.explode(into)).withColumn("_own", F.col("_in") == F.col("_chunk"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)

    def products(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        own = group.column("_own").to_numpy(zero_copy_only=False)
        out = []
        for c in values if own.any() else ():
            x = group.column(c).to_numpy().astype(float) - group.column(f"_m_{c}")[0].as_py()
            wide = 1 << (len(x) + lags).bit_length()
            f = np.conj(np.fft.rfft(np.where(own, x, 0.0), wide)) * np.fft.rfft(x, wide)
            out.append(np.fft.irfft(f, wide)[:lags])
        one = {c: group.column(c).slice(0, 1).combine_chunks() for c in cols}
        at = pa.array([0] * len(out), pa.int32())
        first = lambda c: group.column(c)[0].as_py()
        return pa.table({**{c: v.take(at) for c, v in one.items()}, "measure": pa.array(list(values.values())[: len(out)], pa.string()), "n": pa.array([first("_n")] * len(out), pa.int64()),
                         "mean": pa.array([first(f"_m_{c}") for c in values][: len(out)], pa.float64()), "sums": pa.array(out, pa.list_(pa.float64()))})

    parts = d.groupBy(*cols, "_in").applyInArrow(products, f"{kinds}, measure string, n bigint, mean double, sums array<double>")
    return sum_arrays(parts, [*cols, "measure", "n", "mean"], "sums")


def effective_sizes(df: DataFrame, keys: list[str], half: list[str], order: str, values: dict[str, str], lags: int = 1024) -> DataFrame:
    """Effective sample size of several columns ({column: output name}) in one pass.

    Autocovariances of the first ``lags`` lags come from chunks of half chains; everything after that is sums and running
    minima over lags. Series whose positive sequence has not ended by then go on with eight times as many.
    """
    k = keys + ["measure"]
    done, open_ = None, df
    while True:
        found = _sizes_from_lags(lag_sums(open_, keys + half, order, values, lags), keys, lags)
        found = pin(found)
        more = found.where(~F.col("known")).select(*keys).distinct()
        if more.isEmpty():
            done = found if done is None else done.unionByName(found)
            break
        settled = null_safe_join(found, more.withColumn("_open", F.lit(True)), keys).where("_open IS NULL").drop("_open")
        done = settled if done is None else done.unionByName(settled)
        open_, lags = null_safe_join(open_, pin(more), keys, "inner"), lags * 8
    return done.select(*k, "size").groupBy(*keys).pivot("measure", list(values.values())).agg(F.first("size"))


def _sizes_from_lags(sums: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """(keys, measure, size, known): ``known`` where the lags at hand decide the size."""
    k = keys + ["measure"]
    a = sums.select(*k, "n", "mean", F.posexplode("sums").alias("lag", "_s")).where("lag < n").withColumn("acov", F.col("_s") / F.col("n"))
    per_lag = pin(a.groupBy(*k, "lag").agg(F.avg("acov").alias("acov"), F.min("n").alias("n"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("chains"), F.var_samp("mean").alias("vm")))
    head = per_lag.filter("lag = 0").select(*k, (F.col("acov") * F.col("n") / (F.col("n") - 1)).alias("w"), F.coalesce("vm", F.lit(0.0)).alias("b"),
                                            F.col("n").alias("n0"), F.col("chains").alias("c0"), "longest")
    d = null_safe_join(per_lag.select(*k, "lag", "acov"), head, k, "inner")
    vp = F.col("w") * (F.col("n0") - 1) / F.col("n0") + F.col("b")
    d = d.withColumn("rho", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("w") - F.col("acov")) / vp)).withColumn("_at", F.floor(F.col("lag") / 2))
    pairs = d.groupBy(*k, "_at").agg(F.sum("rho").alias("pair"), F.max(F.when(F.col("lag") % 2 == 0, F.col("rho"))).alias("even"), F.count(F.lit(1)).alias("m"),
                                   F.first("n0").alias("n0"), F.first("c0").alias("c0"), F.first("longest").alias("longest"))
    # initial positive sequence: everything before the first non-positive pair, made monotone
    pairs = scan_min(pairs.filter("m = 2 and 2 * _at < n0 - 3"), k, ["_at"], _low=F.col("pair"))
    # the running minimum turns non-positive exactly at the first non-positive pair
    open_, last = F.col("_low") > 0, F.struct("_at", "even")
    g = pairs.groupBy(*k).agg(
        F.sum(F.when(open_, F.col("_low"))).alias("s"), F.min(F.when(~open_, last)).alias("_stop"), F.max(last).alias("_end"),
        F.max_by("_low", "_at").alias("_tail"), F.max(F.col("n0") * F.col("c0")).alias("total"), F.max("longest").alias("longest"))
    # without a stop the last pair closes the sum through its even term only
    s = F.coalesce("s", F.lit(0.0)) - F.when(F.col("_stop").isNull(), F.col("_tail")).otherwise(0.0)
    t = F.greatest(F.coalesce(F.col("_stop.even"), F.col("_end.even")), F.lit(0.0))
    tau = F.greatest(-1 + 2 * s + t, 1 / F.log10("total"))
    return g.select(*k, (F.col("total") / tau).alias("size"), (F.col("_stop").isNotNull() | (F.col("longest") <= lags)).alias("known"))


def half_chains(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Draw position within its chain and which half it falls in (the middle draw of an odd chain drops)."""
    d = scan_index(draws, keys + ["chain"], ["iter"], "draw_no")
    d = with_group_stats(d, keys + ["chain"], _n=F.count(F.lit(1)))
    size = F.floor(F.col("_n") / 2)
    half = F.when(F.col("draw_no") <= size, 0).when(F.col("draw_no") > F.col("_n") - size, 1)
    return d.withColumn("half", half).filter("half is not null").drop("_n")


def convergence(draws: DataFrame, keys: list[str], divergent: DataFrame | None = None, rhat_max: float = 1.01, ess_min: float = 400) -> DataFrame:
    """Rank-normalised split R-hat, bulk and tail effective size per parameter, and the pass flag per model."""
    d = half_chains(draws, keys)
    h = ["chain", "half"]
    med = exact_quantiles(d, keys, "value", {"_med": 0.5, "_q05": 0.05, "_q95": 0.95})
    d = null_safe_join(d, med, keys, "inner").withColumns({
        "_fold": F.abs(F.col("value") - F.col("_med")), "_lo": (F.col("value") <= F.col("_q05")).cast("double"), "_hi": (F.col("value") <= F.col("_q95")).cast("double")})
    z = pin(rank_normal(rank_normal(d, keys, "value", "_z"), keys, "_fold", "_zf"))
    bulk, fold = split_rhat(z, keys, h, "_z"), split_rhat(z, keys, h, "_zf").withColumnRenamed("rhat", "_rf")
    ess = effective_sizes(z, keys, h, "draw_no", {"_z": "ess_bulk", "_lo": "_e05", "_hi": "_e95"})
    out = bulk.join(fold, keys).join(ess, keys, "left")
    out = out.select(*keys, F.greatest("rhat", "_rf").alias("rhat"), "ess_bulk", F.least("_e05", "_e95").alias("ess_tail"))
    model = keys[:-1]
    g = out.groupBy(*model).agg(F.max("rhat").alias("max_rhat"), F.min("ess_bulk").alias("min_ess_bulk"), F.min("ess_tail").alias("min_ess_tail"))
    bad = F.lit(0).alias("n_divergent") if divergent is None else F.coalesce("n_divergent", F.lit(0)).alias("n_divergent")
    g = (g if divergent is None else g.join(divergent, model, "left")).select(*model, "max_rhat", "min_ess_bulk", "min_ess_tail", bad)
    ok = (F.col("max_rhat") < rhat_max) & (F.col("min_ess_bulk") > ess_min) & (F.col("min_ess_tail") > ess_min) & (F.col("n_divergent") == 0)
    return g.withColumn("passed", ok)


def _beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


# Probabilities one standard deviation either side of the median of a normal.
ONE_SD = (0.1586553, 0.8413447)


def quantile_mcse(draws: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Monte Carlo standard error of quantiles ({output: probability}) from their indicators' effective size."""
    d = half_chains(draws, keys)
    q = exact_quantiles(d, keys, "value", {f"_q_{n}": p for n, p in probs.items()})
    d = null_safe_join(d, q, keys, "inner").withColumns({f"_i_{n}": (F.col("value") <= F.col(f"_q_{n}")).cast("double") for n in probs})
    d = pin(scan_index(d, keys, ["value", "chain", "draw_no"], "_r"))
    ess = effective_sizes(d, keys, ["chain", "half"], "draw_no", {f"_i_{n}": f"_e_{n}" for n in probs})
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))

    @F.pandas_udf(DoubleType())
    def edge(e: pd.Series, prob: pd.Series, side: pd.Series) -> pd.Series:
        return pd.Series([_beta_quantile(s, v * p + 1, v * (1 - p) + 1) for v, p, s in zip(e, prob, side)])

    b = ess.join(size, keys)
    for n, p in probs.items():
        lo, hi = (F.floor(edge(f"_e_{n}", F.lit(p), F.lit(ONE_SD[0])) * F.col("_n")), F.ceil(edge(f"_e_{n}", F.lit(p), F.lit(ONE_SD[1])) * F.col("_n")))
        b = b.withColumns({f"_k0_{n}": F.greatest(lo, F.lit(1)), f"_k1_{n}": F.least(hi, F.col("_n"))})
    j = d.select(*keys, "_r", "value").join(b.drop("_n"), keys)
    at = lambda k: F.max(F.when(F.col("_r") == F.col(k), F.col("value")))
    return j.groupBy(*keys).agg(*[((at(f"_k1_{n}") - at(f"_k0_{n}")) / 2).alias(n) for n in probs])


# --- result tables -------------------------------------------------------------------------

def merge_variants(table: DataFrame, keys: list[str], variant: str, main, alt, cols: list[str]) -> DataFrame:
    """Main and alternative rows of a result table side by side (keys held by both)."""
    pick = lambda v, c, s: F.max(F.when(F.col(variant) == v, F.col(c))).alias(f"{c}_{s}")
    g = table.groupBy(*keys).agg(*[pick(v, c, s) for v, s in ((main, "main"), (alt, "alt")) for c in cols])
    return g.filter(f"{cols[0]}_main is not null and {cols[0]}_alt is not null")


def kernel_density(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, points: int) -> DataFrame:
    """Gaussian kernel density of every series on one grid (each row adds to the grid before the shuffle)."""
    q = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    m = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    s = null_safe_join(m, q, keys, "inner")
    spread = F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34)
    s = s.select(*keys, (0.9 * spread * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"))
    step = (hi - lo) / (points - 1)
    d = null_safe_join(df, s, keys, "inner").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = d.withColumn("x", F.lit(lo) + F.col("point") * F.lit(step))
    u = (F.col("x") - F.col(value)) / F.col("_h")
    return d.groupBy(*keys, "point", "x").agg((F.avg(F.exp(-u * u / 2)) / (F.max("_h") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))


def claim_requirements(records: DataFrame, structure: str, version: str, n_cells: int) -> DataFrame:
    """What a claim about an exclusion needs of the reported fits: one row per requirement with the number of faults.

    The claim may be printed when every row has 0 faults. ``unit`` says what is counted.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reported = records.filter(yes("applicable") & ~yes("is_robustness") & F.col("prior").eqNullSafe("informative") & F.col("structure").eqNullSafe(structure))
    differs = lambda c, v: F.count_if(~F.col(c).eqNullSafe(F.lit(v)))
    requirements = (
        ("exclusion_applied", "fits", F.count_if(~yes("applied"))),
        ("valid_rows_only", "fits", differs("invalid_rows", 0)),
        ("current_version", "fits", differs("version", version)),
        ("every_cell_fitted", "cells", F.greatest(F.lit(n_cells) - F.countDistinct("model"), F.lit(0))),
    )
    one = reported.agg(*[n.cast("bigint").alias(name) for name, _, n in requirements], F.count(F.lit(1)).alias("n_fits"))
    rows = F.array(*[F.struct(F.lit(name).alias("requirement"), F.lit(unit).alias("unit"), F.col(name).alias("n_faults")) for name, unit, _ in requirements])
    return one.select(F.explode(rows).alias("r"), "n_fits").select("r.*", "n_fits", (F.col("r.n_faults") == 0).alias("met"))
