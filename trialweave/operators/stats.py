"""Statistics over groups: stratified odds ratios, permutation and bootstrap grids, rank tests, contrasts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.functions.dist import chi2_tail1, chi2_tail_udf, norm_tail_sql, t_quantile_col, t_two_sided_udf
from trialweave.operators.filters import informative_strata
from trialweave.operators.permute import draw_sums, resample_sums
from trialweave.operators.skew import exact_quantiles, null_safe_join, scan_index, scan_sum, with_group_stats
from trialweave.runtime import pin


def hash_order(seed: int, *keys: Column) -> Column:
    """Reproducible pseudo-random order: a digest of seed and keys, equal on every engine and rerun."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_index(seed: int, n: Column, *keys: Column) -> Column:
    """Pseudo-random integer in 1..n."""
    head = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return head % n + 1


# --- stratified 2x2 tables ---------------------------------------------------------------

def stratum_tables(df: DataFrame, y: str, x: str, strata: list[str]) -> DataFrame:
    """a, b, c, d per stratum, only where every margin is positive."""
    yes, no = F.col(y) == 1, F.col(y) == 0
    t = df.groupBy(*strata).agg(
        F.count_if((F.col(x) == 1) & yes).cast("double").alias("a"), F.count_if((F.col(x) == 1) & no).cast("double").alias("b"),
        F.count_if((F.col(x) == 0) & yes).cast("double").alias("c"), F.count_if((F.col(x) == 0) & no).cast("double").alias("d"))
    return t.filter("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0")


def mantel_haenszel(df: DataFrame, y: str, x: str, strata: list[str], by: list[str], z: float = 1.959963984540054) -> DataFrame:
    """Pooled odds ratio, Robins-Breslow-Greenland interval and the CMH test per ``by`` group."""
    t = stratum_tables(df, y, x, by + strata)
    a, b, c, d = (F.col(k) for k in "abcd")
    n = a + b + c + d
    t = t.select(*by, (a * d / n).alias("R"), (b * c / n).alias("S"), ((a + d) / n).alias("P"), ((b + c) / n).alias("Q"),
                 (a - (a + b) * (a + c) / n).alias("dev"), ((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("var"))
    R, S, P, Q = (F.col(k) for k in "RSPQ")
    g = t.groupBy(*by).agg(
        F.sum("R").alias("r"), F.sum("S").alias("s"), F.sum(P * R).alias("pr"), F.sum(P * S + Q * R).alias("ps"), F.sum(Q * S).alias("qs"),
        F.sum("dev").alias("dev"), F.sum("var").alias("var"), F.count(F.lit(1)).alias("n_strata"))
    r, s = F.col("r"), F.col("s")
    se = F.sqrt(F.col("pr") / (2 * r * r) + F.col("ps") / (2 * r * s) + F.col("qs") / (2 * s * s))
    g = g.withColumns({"odds_ratio": r / s, "_se": se, "cmh": F.col("dev") * F.col("dev") / F.col("var")})
    return g.select(*by, "odds_ratio", (F.col("odds_ratio") * F.exp(-z * F.col("_se"))).alias("or_low"),
                    (F.col("odds_ratio") * F.exp(z * F.col("_se"))).alias("or_high"), chi2_tail1("cmh").alias("cmh_p"), "n_strata")


def stratum_logit(df: DataFrame, y: str, xcols: list[str], strata: list[str], max_iter: int = 25, tol: float = 1e-9) -> dict:
    """Logistic regression with one intercept per stratum, by block Newton steps.

    Rows are first collapsed to (stratum, covariates) cells. Each step aggregates per stratum and
    eliminates the intercepts (Schur complement), so only a k x k matrix reaches the driver, however
    many strata there are. The likelihood-ratio test drops all covariates; its deviance is closed form.
    """
    k = len(xcols)
    use = informative_strata(df.na.drop(subset=[y, *xcols]), strata, y)
    cells = pin(use.groupBy(*strata, *xcols).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(y).cast("double").alias("_y")))
    base = cells.groupBy(*strata).agg(F.sum("_n").alias("tot_n"), F.sum("_y").alias("tot_s"))
    state = base.select(*strata, F.log(F.col("tot_s") / (F.col("tot_n") - F.col("tot_s"))).alias("alpha"))
    beta = np.zeros(k)
    cov = np.full((k, k), np.nan)

    def moments(state, beta):
        eta = F.col("alpha") + sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, xcols)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        j = cells.join(state, strata).withColumns({"_w": F.col("_n") * mu * (1 - mu), "_r": F.col("_y") - F.col("_n") * mu})
        x = [F.col(c) for c in xcols]
        return j.groupBy(*strata, "alpha").agg(
            F.sum("_w").alias("A"), F.sum("_r").alias("g"), *[F.sum(F.col("_w") * x[i]).alias(f"B{i}") for i in range(k)],
            *[F.sum(F.col("_r") * x[i]).alias(f"G{i}") for i in range(k)],
            *[F.sum(F.col("_w") * x[i] * x[m]).alias(f"H{i}_{m}") for i in range(k) for m in range(i, k)])

    for _ in range(max_iter):
        per = pin(moments(state, beta))
        tot = per.agg(
            *[F.sum(F.col(f"G{i}") - F.col(f"B{i}") * F.col("g") / F.col("A")).alias(f"r{i}") for i in range(k)],
            *[F.sum(F.col(f"H{i}_{m}") - F.col(f"B{i}") * F.col(f"B{m}") / F.col("A")).alias(f"s{i}_{m}") for i in range(k) for m in range(i, k)],
        ).first()
        S = np.array([[tot[f"s{min(i, m)}_{max(i, m)}"] for m in range(k)] for i in range(k)], float)
        step = np.linalg.solve(S, np.array([tot[f"r{i}"] for i in range(k)], float))
        cov = np.linalg.inv(S)
        shift = (F.col("g") - sum((F.col(f"B{i}") * float(step[i]) for i in range(k)), F.lit(0.0))) / F.col("A")
        state = per.select(*strata, (F.col("alpha") + shift).alias("alpha"))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise ValueError(f"the stratum logit did not converge in {max_iter} steps")
    eta = F.col("alpha") + sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, xcols)), F.lit(0.0))
    mu = 1 / (1 + F.exp(-eta))
    dev = lambda m: -2 * (F.col("_y") * F.log(m) + (F.col("_n") - F.col("_y")) * F.log(1 - m))
    rate = F.col("tot_s") / F.col("tot_n")
    j = cells.join(state, strata).join(base, strata)
    out = j.agg(F.sum(dev(mu)).alias("d1"), F.sum(dev(rate)).alias("d0"), F.sum("_n").alias("n_rows")).first()
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "lr": out["d0"] - out["d1"], "n": int(out["n_rows"]), "strata": base.count(), "df": k}


def logit_table(spark, fit: dict, xcols: list[str]) -> DataFrame:
    """One row per covariate with odds ratio, Wald interval and p, beside the likelihood-ratio test."""
    rows = [(c, float(b), float(s), float(fit["lr"]), float(fit["df"]), fit["n"], fit["strata"]) for c, b, s in zip(xcols, fit["beta"], fit["se"])]
    t = spark.createDataFrame(rows, "term string, beta double, se double, lr double, lr_df double, n bigint, n_strata bigint")
    return t.withColumns({"odds_ratio": F.exp("beta"), "or_low": F.exp(F.col("beta") - 1.96 * F.col("se")),
                          "or_high": F.exp(F.col("beta") + 1.96 * F.col("se")), "_z": F.col("beta") / F.col("se")}).withColumns({
        "p": 2 * F.expr(norm_tail_sql("_z")), "lr_p": chi2_tail_udf("lr", "lr_df")}).drop("_z")


# --- permutation and bootstrap grids ------------------------------------------------------

def permuted_indicator(df: DataFrame, strata: list[str], key: str, indicator: str, n_perm: int, seed: int) -> DataFrame:
    """One row per permutation and input row: the 0/1 indicator shuffled within strata.

    The rows whose digest ranks within the stratum's number of ones receive 1, which is a uniform
    shuffle; every permutation is reproducible from (seed, permutation, key), so tasks may rerun.
    """
    d = with_group_stats(df, strata, _ones=F.sum(indicator))
    d = d.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    d = d.withColumn("_h", hash_order(seed, F.col("perm"), F.col(key)))
    d = scan_index(d, ["perm", *strata], ["_h", key], "_r")
    return d.withColumn("shuffled", (F.col("_r") <= F.col("_ones")).cast("int")).drop("_r", "_h", "_ones")


def permutation_p(null: DataFrame, observed: DataFrame, stat: str = "stat", eps: float = 1e-9) -> DataFrame:
    """Two-sided p about the null mean, (b + 1) / (m + 1)."""
    mean = null.agg(F.avg(stat).alias("null_mean"))
    dev = F.abs(F.col(stat) - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - eps
    g = null.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(observed))  # two one-row tables
    return g.groupBy("observed", "null_mean").agg(((F.count_if(dev) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def hypergeometric_draws(n: int, ones: int, hits: int, uniforms: np.ndarray) -> np.ndarray:
    """How many of ``hits`` marked rows fall among ``ones`` of n, by inversion; terms below double precision count as 0."""
    low, high = max(0, ones + hits - n), min(ones, hits)
    k = np.arange(low, high, dtype=float)
    log = np.concatenate(([0.0], np.cumsum(np.log((ones - k) * (hits - k)) - np.log((k + 1) * (n - ones - hits + k + 1)))))
    p = np.exp(log - log.max())
    return low + np.searchsorted(np.cumsum(p) / p.sum(), uniforms, side="left").clip(max=high - low)


def permutation_condition(df: DataFrame, y: str, label: str, strata: list[str], n_perm: int, seed: int) -> DataFrame:
    """Test of sum(y * label), both 0/1, with labels shuffled within strata.

    Within a stratum that sum is hypergeometric, so three counts stand for all shuffles: rows never leave the first
    aggregate, and each task adds up its strata's draws per permutation before the shuffle.
    """
    d = df.na.drop(subset=[y, label])
    both = F.col(y) * F.col(label)
    counts = d.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"), F.sum(y).alias("hits"), F.sum(both).alias("observed"))
    obs = counts.agg(F.sum("observed").cast("double").alias("observed"))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in strata])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_perm)
        for part in batches:
            for key, n, ones, hits in part.itertuples(index=False):
                digests = (hashlib.md5(f"{seed}|{b}|{key}".encode()).hexdigest()[:12] for b in range(1, n_perm + 1))
                total += hypergeometric_draws(int(n), int(ones), int(hits), np.array([int(h, 16) for h in digests]) / 2.0**48)
        yield pd.DataFrame({"perm": np.arange(1, n_perm + 1), "part": total})

    null = counts.select(name.alias("key"), "n", "ones", "hits").mapInPandas(run, "perm int, part double").groupBy("perm").agg(F.sum("part").alias("stat"))
    return permutation_p(null, obs)


def permutation_covariance(df: DataFrame, y: str, x: str, strata: list[str], key: str, n_perm: int, seed: int) -> DataFrame:
    """Test of sum(y * (x - stratum mean)) with y (0/1) shuffled within strata; draws never leave a stratum's chunk but as sums."""
    d = df.na.drop(subset=[y, x]).select(*strata, key, y, x)
    d = with_group_stats(d, strata, _m=F.avg(x)).withColumn("_x", (F.col(x) - F.col("_m")).cast("double"))
    sums = pin(draw_sums(d, strata, key, y, "_x", n_perm, seed))
    return permutation_p(sums.filter("perm > 0").select("stat"), sums.filter("perm = 0").select(F.col("stat").alias("observed")), eps=1e-9)


def bootstrap_mean(df: DataFrame, by: list[str], unit: str, value: str, n_boot: int, seed: int) -> DataFrame:
    """Percentile interval of the mean of unit values (units drawn with replacement); only sums per draw leave a task."""
    sums = resample_sums(df.select(*by, unit, value), by, unit, value, n_boot, seed)
    means = sums.select(*by, F.explode(F.transform("sums", lambda s: s / F.col("n"))).alias("m"))
    return exact_quantiles(means, by, "m", {"low": 0.025, "high": 0.975})


# --- classical tests on moments and ranks -------------------------------------------------

def chi_square(df: DataFrame, by: list[str], row: str, col: str) -> DataFrame:
    """Chi-square of a contingency table from its observed cells: t (sum of o² / (r c) - 1), empty cells add nothing."""
    cells = pin(df.groupBy(*by, row, col).agg(F.count(F.lit(1)).cast("double").alias("o")))
    r = cells.groupBy(*by, row).agg(F.sum("o").alias("_r"))
    c = cells.groupBy(*by, col).agg(F.sum("o").alias("_c"))
    full = null_safe_join(null_safe_join(cells, r, by + [row], "inner"), c, by + [col], "inner")
    levels = lambda k: F.count_distinct(F.struct(F.col(k)))
    g = full.groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))).alias("_s"), F.sum("o").alias("_t"), levels(row).alias("_nr"), levels(col).alias("_nc"))
    return g.select(*by, (F.col("_t") * (F.col("_s") - 1)).alias("chi2"), ((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("double").alias("dof"), F.col("_t").cast("bigint").alias("n"))


def welch(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """Welch t and its degrees of freedom between group 0 and group 1."""
    g = df.withColumn("_g", group).groupBy(*by).agg(*[
        f.alias(f"{n}{k}") for k in (0, 1) for n, f in (
            ("n", F.count(F.when(F.col("_g") == k, F.col(value)))), ("m", F.avg(F.when(F.col("_g") == k, F.col(value)))),
            ("v", F.var_samp(F.when(F.col("_g") == k, F.col(value)))))])
    return welch_from_moments(g)


def welch_from_moments(g: DataFrame) -> DataFrame:
    q0, q1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    ok = (F.col("n0") > 1) & (F.col("n1") > 1) & (q0 + q1 > 0)
    dof = (q0 + q1) * (q0 + q1) / (q0 * q0 / (F.col("n0") - 1) + q1 * q1 / (F.col("n1") - 1))
    return g.withColumns({"t": F.when(ok, (F.col("m0") - F.col("m1")) / F.sqrt(q0 + q1)), "dof": F.when(ok, dof)})


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_two_sided_udf("t", "dof"))


def leave_one_out_welch(df: DataFrame, by: list[str], unit: str, group: str, value: str) -> DataFrame:
    """Welch t after dropping each unit, by removing its own moments from the group sums."""
    x = F.col(value)
    aggs = {}
    for k in (0, 1):
        v = F.when(F.col(group) == k, x)
        aggs |= {f"_n{k}": F.count(v), f"_s{k}": F.sum(v), f"_q{k}": F.sum(v * v)}
    d = with_group_stats(df, by, **aggs)
    cols = {}
    for k in (0, 1):
        own = F.col(group) == k
        n = F.col(f"_n{k}") - F.when(own, 1).otherwise(0)
        s = F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) - F.when(own, x).otherwise(0.0)
        q = F.coalesce(F.col(f"_q{k}"), F.lit(0.0)) - F.when(own, x * x).otherwise(0.0)
        cols |= {f"n{k}": n, f"m{k}": F.try_divide(s, n), f"v{k}": F.when(n > 1, (q - F.try_divide(s * s, n)) / F.nullif(n - 1, F.lit(0)))}
    return welch_from_moments(d.withColumns(cols)).select(*by, unit, "t", "dof")


def mann_whitney(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """U of group 1 with tie-corrected normal approximation, from counts per distinct value."""
    c = df.filter(F.col(value).isNotNull()).withColumn("_g", group).groupBy(*by, value).agg(
        F.count_if(F.col("_g") == 1).alias("p"), F.count_if(F.col("_g") == 0).alias("q"))
    c = scan_sum(c, by, [value], inclusive=False, _below=F.col("q"))
    below = F.coalesce("_below", F.lit(0))
    t = (F.col("p") + F.col("q")).cast("double")
    g = c.groupBy(*by).agg(F.sum(F.col("p") * (below + F.col("q") / 2)).alias("u"), F.sum("p").alias("n1"), F.sum("q").alias("n0"),
                           F.sum(t * t * t - t).alias("_ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    var = n1 * n0 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    g = g.withColumn("z", (F.col("u") - n1 * n0 / 2) / F.sqrt(F.nullif(var, F.lit(0.0))))
    return g.withColumn("p", 2 * F.expr(norm_tail_sql("z"))).drop("_ties")


def signed_rank(df: DataFrame, by: list[str], diff: str) -> DataFrame:
    """Wilcoxon signed-rank (normal approximation, ties corrected) and sign counts."""
    d = df.filter(f"{diff} <> 0").withColumn("_a", F.abs(diff))
    c = d.groupBy(*by, "_a").agg(F.count_if(F.col(diff) > 0).alias("p"), F.count_if(F.col(diff) < 0).alias("q"))
    c = c.withColumn("_n", F.col("p") + F.col("q"))
    c = scan_sum(c, by, ["_a"], inclusive=False, _below=F.col("_n"))
    rank = F.coalesce("_below", F.lit(0)) + (F.col("_n") + 1) / 2
    n3 = F.col("_n").cast("double")
    g = c.groupBy(*by).agg(F.sum(F.col("p") * rank).alias("w_plus"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(n3 * n3 * n3 - n3).alias("_t"))
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    var = (n * (n + 1) * (2 * n + 1) - F.col("_t") / 2) / 24
    g = g.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    return g.withColumn("p", 2 * F.expr(norm_tail_sql("z"))).drop("_t")


def equivalence(df: DataFrame, keys: list[str], value: str, bound: float, alpha: float = 0.05) -> DataFrame:
    """Two one-sided tests: the 1-2*alpha interval must lie inside +-bound."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))
    g = g.filter("n > 1").withColumn("dof", F.col("n") - 1)
    g = g.withColumns({"_t90": t_quantile_col(1 - alpha, F.col("dof")), "_t95": t_quantile_col(1 - alpha / 2, F.col("dof"))})
    m, se = F.col("mean"), F.col("se")
    g = g.withColumns({"ci90_low": m - F.col("_t90") * se, "ci90_high": m + F.col("_t90") * se,
                       "ci95_low": m - F.col("_t95") * se, "ci95_high": m + F.col("_t95") * se})
    return g.withColumn("passes", (F.col("ci90_low") > -bound) & (F.col("ci90_high") < bound)).drop("_t90", "_t95", "dof")


def adjusted_contrast(df: DataFrame, unit: list[str], condition: str, kept: str, y: str, base: str, control: str, violation: str) -> DataFrame:
    """Baseline-adjusted 2x2 contrast with one within-cell slope, from per-cell moments."""
    c = df.groupBy(*unit, condition, kept).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("my"), F.avg(base).alias("mb"), F.sum(base).alias("sb"),
        (F.covar_pop(base, y) * F.count(F.lit(1))).alias("cby"), (F.var_pop(base) * F.count(F.lit(1))).alias("cbb"), (F.var_pop(y) * F.count(F.lit(1))).alias("cyy"))
    cells = {"c1": (control, True), "c0": (control, False), "v1": (violation, True), "v0": (violation, False)}
    at = lambda k: (F.col(condition) == cells[k][0]) & (F.col(kept) == F.lit(cells[k][1]))
    pick = lambda k, col: F.max(F.when(at(k), F.col(col)))
    g = c.groupBy(*unit).agg(
        F.sum("cby").alias("cby"), F.sum("cbb").alias("cbb"), F.sum("cyy").alias("cyy"), F.sum("n").alias("N"), (F.sum("sb") / F.sum("n")).alias("bbar"),
        *[pick(k, col).alias(f"{col}_{k}") for k in cells for col in ("n", "my", "mb")])
    g = g.filter(" and ".join(f"n_{k} >= 2" for k in cells)).withColumn("slope", F.col("cby") / F.col("cbb"))
    adj = {k: F.col(f"my_{k}") - F.col("slope") * (F.col(f"mb_{k}") - F.col("bbar")) for k in cells}
    s2 = (F.col("cyy") - F.col("slope") * F.col("cby")) / (F.col("N") - 5)
    inv = sum((1 / F.col(f"n_{k}") for k in cells), F.lit(0.0))
    return g.select(*unit, ((adj["v0"] - adj["c0"]) - (adj["v1"] - adj["c1"])).alias("d_int"), (((adj["c0"] - adj["c1"]) + (adj["v0"] - adj["v1"])) / 2).alias("d_main"),
                    "slope", F.sqrt(s2).alias("trial_sd"), (s2 * inv).alias("var_int"))


def auc_from_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with mid-ranks per key; null when a class is absent."""
    c = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    c = scan_sum(c, keys, [score], inclusive=False, _below=F.col("_q"))
    u = F.sum(F.col("_p") * (F.coalesce("_below", F.lit(0)) + F.col("_q") / 2))
    g = c.groupBy(*keys).agg(u.alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return g.withColumn("auc", F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg"))).drop("_u")


