"""Section M, third part: posterior draws and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions.dist import norm_quantile_sql
from trialweave.operators import draws as dr
from trialweave.operators.filters import rt_band
from trialweave.operators.recode import contrast_columns, model_fields
from trialweave.operators.skew import exact_quantiles, first_per_key
from trialweave.plans.b_recode import _MODEL_SQL
from trialweave.plans.e1_aggregations import CLEAN_SQL, dedup
from trialweave.plans.standins import DRAWS_SQL, TRIALS_SQL, draws, r6, trials
from trialweave.registry import query, table

KEY = ["model", "chain", "iter"]
SUMMARY_COLS = "round(median(v), 6) AS median, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, round(greatest(avg(CASE WHEN v > 0 THEN 1 ELSE 0 END), avg(CASE WHEN v < 0 THEN 1 ELSE 0 END)), 6) AS pd"
SUM_SQL = f"""{DRAWS_SQL},
post AS (SELECT model, parameter, median(value) AS med, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi,
  greatest(avg(CASE WHEN value > 0 THEN 1 ELSE 0 END), avg(CASE WHEN value < 0 THEN 1 ELSE 0 END)) AS pd, count(*) AS n FROM draws GROUP BY ALL)"""


def summary(spark, sf):
    return dr.posterior_summary(draws(spark, sf), ["model", "parameter"])


def _rounded(df, keys):
    return df.select(*keys, *[r6(c, c) for c in ("median", "ci_low", "ci_high", "pd")])


@query("m30_posterior_summary", f"WITH {SUM_SQL} SELECT model, parameter, round(med, 6) AS median, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(pd, 6) AS pd FROM post")
def m30(spark, sf):
    return _rounded(summary(spark, sf), ["model", "parameter"])


# half chains; normal scores of the pooled mid-ranks of the values and of their distances from the median; autocovariances by self-join
HALVES_SQL = """
nb AS (SELECT *, row_number() OVER (PARTITION BY {keys}, chain ORDER BY iter) AS i, count(*) OVER (PARTITION BY {keys}, chain) AS n FROM {rows}),
hc AS (SELECT {keys}, chain, i, CASE WHEN i <= n // 2 THEN 0 ELSE 1 END AS half, value FROM nb WHERE i <= n // 2 OR i > n - n // 2)"""
ESS_SQL = """
mo AS (SELECT {keys}, measure, chain, half, avg(v) AS m, count(*) AS n FROM se GROUP BY ALL),
ce AS (SELECT {keys}, measure, chain, half, i, v - m AS c FROM se JOIN mo USING ({keys}, measure, chain, half)),
ac AS (SELECT {keys}, measure, chain, half, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM ce a JOIN ce b USING ({keys}, measure, chain, half) WHERE b.i >= a.i GROUP BY ALL),
pl AS (SELECT {keys}, measure, lag, avg(s / n) AS acov, min(n) AS n, count(*) AS chains, var_samp(m) AS vm FROM ac JOIN mo USING ({keys}, measure, chain, half) GROUP BY ALL),
hd AS (SELECT {keys}, measure, acov * n / (n - 1) AS w, coalesce(vm, 0) AS b, n AS n0, chains AS c0 FROM pl WHERE lag = 0),
ro AS (SELECT {keys}, measure, lag, n0, c0, CASE WHEN lag = 0 THEN 1 ELSE 1 - (w - acov) / (w * (n0 - 1) / n0 + b) END AS rho FROM pl JOIN hd USING ({keys}, measure)),
pr AS (SELECT * FROM (SELECT {keys}, measure, k, count(*) AS m, sum(rho) AS pair, max(CASE WHEN lag % 2 = 0 THEN rho END) AS even, any_value(n0) AS n0, any_value(c0) AS c0 FROM (SELECT *, lag // 2 AS k FROM ro) GROUP BY {keys}, measure, k) WHERE m = 2 AND 2 * k < n0 - 3),
lw AS (SELECT *, min(pair) OVER (PARTITION BY {keys}, measure ORDER BY k) AS low FROM pr),
es AS (SELECT {keys}, measure, max(n0 * c0) AS total, coalesce(sum(low) FILTER (low > 0), 0) - CASE WHEN count(*) FILTER (low <= 0) = 0 THEN arg_max(low, k) ELSE 0 END AS s,
  greatest(coalesce(arg_min(even, k) FILTER (low <= 0), arg_max(even, k)), 0) AS t FROM lw GROUP BY ALL),
ess AS (SELECT {keys}, measure, total / greatest(-1 + 2 * s + t, 1 / log10(total)) AS size FROM es)"""


def _scores_sql(value: str, name: str) -> str:
    rank = f"rank() OVER (PARTITION BY model, parameter ORDER BY {value}) + (count(*) OVER (PARTITION BY model, parameter, {value}) - 1) / 2.0::DOUBLE"
    return f"{norm_quantile_sql(f'(({rank}) - 0.375) / (count(*) OVER (PARTITION BY model, parameter) + 0.25)')} AS {name}"


@query("m31_convergence", f"""WITH {DRAWS_SQL}, {HALVES_SQL.format(keys='model, parameter', rows='draws')},
q AS (SELECT model, parameter, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95 FROM hc GROUP BY ALL),
fo AS (SELECT hc.*, abs(value - md) AS fold, CASE WHEN value <= q05 THEN 1.0 ELSE 0.0 END::DOUBLE AS lo, CASE WHEN value <= q95 THEN 1.0 ELSE 0.0 END::DOUBLE AS hi FROM hc JOIN q USING (model, parameter)),
z AS (SELECT model, parameter, chain, half, i, lo, hi, {_scores_sql('value', 'z')}, {_scores_sql('fold', 'zf')} FROM fo),
se AS (SELECT model, parameter, chain, half, i, unnest(['z', 'zf', 'lo', 'hi']) AS measure, unnest([z, zf, lo, hi]) AS v FROM z),
hm AS (SELECT model, parameter, measure, chain, half, avg(v) AS m, var_samp(v) AS v, count(*)::DOUBLE AS n FROM se GROUP BY ALL),
rh AS (SELECT model, parameter, measure, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM hm GROUP BY ALL),
{ESS_SQL.format(keys='model, parameter')},
pp AS (SELECT model, parameter, (SELECT max(rhat) FROM rh r WHERE r.model = e.model AND r.parameter = e.parameter AND r.measure IN ('z', 'zf')) AS rhat, max(size) FILTER (measure = 'z') AS bulk, min(size) FILTER (measure IN ('lo', 'hi')) AS tail FROM ess e GROUP BY ALL),
g AS (SELECT model, max(rhat) AS r, min(bulk) AS b, min(tail) AS t FROM pp GROUP BY model)
SELECT model, round(r, 6) AS max_rhat, round(b, 4) AS min_ess_bulk, round(t, 4) AS min_ess_tail, 0 AS n_divergent, r < 1.01 AND b > 400 AND t > 400 AS passed FROM g""")
def m31(spark, sf):
    c = dr.convergence(draws(spark, sf), ["model", "parameter"])
    return c.select("model", r6("max_rhat", "max_rhat"), r6("min_ess_bulk", "min_ess_bulk", 4), r6("min_ess_tail", "min_ess_tail", 4), "n_divergent", "passed")


CODES_SQL = f"""{TRIALS_SQL},
cc AS (SELECT CASE condition WHEN 'Grammatical' THEN 0.5 WHEN 'Ungrammatical' THEN -0.5 END::DOUBLE AS c, CASE session WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END::DOUBLE AS s,
  CASE grp WHEN 'Mini-Norwegian' THEN 0.5 ELSE -0.5 END::DOUBLE AS g FROM trials),
codes AS (SELECT (0 - avg(s)) / stddev_samp(s) AS z0, (1 - avg(s)) / stddev_samp(s) AS z1, (2 - avg(s)) / stddev_samp(s) AS z2, (3 - avg(s)) / stddev_samp(s) AS z3,
  (0.5 - avg(g)) / stddev_samp(g) AS ze, (-0.5 - avg(g)) / stddev_samp(g) AS zo, (0.5 - avg(c)) / stddev_samp(c) AS zc, (-0.5 - avg(c)) / stddev_samp(c) AS zv FROM cc)"""
WIDE_SQL = f"""{DRAWS_SQL}, {CODES_SQL},
wd AS (SELECT model, chain, iter, max(value) FILTER (parameter = 'b_Intercept') AS bi, max(value) FILTER (parameter = 'b_z_recoded_grammaticality') AS bg, max(value) FILTER (parameter = 'b_z_recoded_session') AS bs,
  max(value) FILTER (parameter = 'b_z_recoded_mini_language') AS bl, max(value) FILTER (parameter = 'b_z_recoded_grammaticality:z_recoded_session') AS bgs, max(value) FILTER (parameter = 'b_z_recoded_mini_language:z_recoded_grammaticality') AS bgl,
  max(value) FILTER (parameter = 'b_z_recoded_session:z_recoded_mini_language') AS bsl, max(value) FILTER (parameter = 'b_z_recoded_session:z_recoded_grammaticality:z_recoded_mini_language') AS bgsl FROM draws GROUP BY ALL)"""


def codes(spark, sf):
    return dr.design_codes(contrast_columns(trials(spark, sf)))


@query("m32_retention_contrast", f"""WITH {WIDE_SQL},
l AS (SELECT model, 'overall' AS contrast, (z3 - z2) * bgs AS v FROM wd, codes UNION ALL SELECT model, 'within_even', (z3 - z2) * (bgs + bgsl * ze) FROM wd, codes
 UNION ALL SELECT model, 'within_odd', (z3 - z2) * (bgs + bgsl * zo) FROM wd, codes UNION ALL SELECT model, 'group_difference', (z3 - z2) * (bgs + bgsl * ze) - (z3 - z2) * (bgs + bgsl * zo) FROM wd, codes)
SELECT model, contrast, {SUMMARY_COLS} FROM l GROUP BY ALL""")
def m32(spark, sf):
    c = dr.retention_contrasts(draws(spark, sf), codes(spark, sf), KEY)
    return _rounded(dr.posterior_summary(c, ["model", "contrast"]), ["model", "contrast"])


@query("m33_first_session", f"""WITH {WIDE_SQL}, l AS (SELECT model, 'first_session_advantage' AS contrast, bgl + z0 * bgsl AS v FROM wd, codes) SELECT model, contrast, {SUMMARY_COLS} FROM l GROUP BY ALL""")
def m33(spark, sf):
    c = dr.first_session_contrasts(draws(spark, sf), codes(spark, sf), KEY)
    return _rounded(dr.posterior_summary(c, ["model", "contrast"]), ["model", "contrast"])


_SDT_SQL = f"""{WIDE_SQL},
sg AS (SELECT * FROM (SELECT unnest(['2', '3', '4', '6', 'average']) AS session, unnest([z0, z1, z2, z3, 0.0::DOUBLE]) AS zs FROM codes), (SELECT unnest(['even', 'odd']) AS grp, unnest([ze, zo]) AS zl FROM codes)),
et AS (SELECT model, chain, iter, session, grp, bi + bg * zc + bs * zs + bl * zl + bgs * zc * zs + bgl * zc * zl + bsl * zs * zl + bgsl * zc * zs * zl AS up,
  bi + bg * zv + bs * zs + bl * zl + bgs * zv * zs + bgl * zv * zl + bsl * zs * zl + bgsl * zv * zs * zl AS dn FROM wd, codes, sg),
ms AS (SELECT model, chain, iter, session, grp, 'sensitivity' AS measure, up + dn AS v FROM et UNION ALL SELECT model, chain, iter, session, grp, 'criterion', -(up - dn) / 2 FROM et),
pr AS (SELECT model, chain, iter, measure, session, max(v) FILTER (grp = 'even') AS e, max(v) FILTER (grp = 'odd') AS o FROM ms GROUP BY ALL),
ch AS (SELECT b.model, b.chain, b.iter, b.measure, CASE WHEN a.session = '2' THEN 'first_to_last' ELSE 's4_to_s6' END AS span, a.session || '->' || b.session AS ss, b.e - a.e AS e, b.o - a.o AS o FROM pr a JOIN pr b USING (model, chain, iter, measure)
  WHERE b.session = '6' AND a.session IN ('2', '4')),
al AS (SELECT model, measure || '|value|' || grp || '|' || session AS contrast, v FROM ms UNION ALL SELECT model, measure || '|group_difference|even - odd|' || session, e - o FROM pr
  UNION ALL SELECT model, measure || '|change_' || span || '|even|' || ss, e FROM ch UNION ALL SELECT model, measure || '|change_' || span || '|odd|' || ss, o FROM ch
  UNION ALL SELECT model, measure || '|change_' || span || '_group_difference|even - odd|' || ss, e - o FROM ch)"""


@query("m34_detection_contrasts", f"WITH {_SDT_SQL} SELECT model, contrast, {SUMMARY_COLS} FROM al GROUP BY ALL")
def m34a(spark, sf):
    c = dr.detection_contrasts(draws(spark, sf), codes(spark, sf), KEY)
    return _rounded(dr.posterior_summary(c, ["model", "contrast"]), ["model", "contrast"])


@query("m34_bound_mcse")
def m34b(spark, sf):
    c = dr.retention_contrasts(draws(spark, sf), codes(spark, sf), KEY)
    return dr.quantile_mcse(c, ["model", "contrast"], {"mcse_low": 0.025, "mcse_high": 0.975})


# models pair up: even labels carry the informative prior, odd labels the weak one
PAIR_SQL = f"""{SUM_SQL},
vv AS (SELECT CAST(substr(model, 2) AS INT) // 2 AS cell, CASE WHEN CAST(substr(model, 2) AS INT) % 2 = 0 THEN 'informative' ELSE 'weak' END AS prior, parameter, med, lo, hi, pd, n FROM post),
pairs AS (SELECT a.cell, a.parameter, a.med AS m1, b.med AS m2, a.lo AS l1, a.hi AS h1, b.lo AS l2, b.hi AS h2, a.n AS n1, b.n AS n2 FROM vv a JOIN vv b USING (cell, parameter) WHERE a.prior = 'informative' AND b.prior = 'weak')"""


def variants(spark, sf):
    n = F.substring("model", 2, 10).try_cast("int")
    s = summary(spark, sf).withColumns({"cell": F.floor(n / 2), "prior": F.when(n % 2 == 0, "informative").otherwise("weak")})
    return dr.merge_variants(s, ["cell", "parameter"], "prior", "informative", "weak", ["median", "ci_low", "ci_high", "n_draws"])


@query("m35_prior_sensitivity", f"WITH {PAIR_SQL} SELECT cell, parameter, round(m2 - m1, 6) AS shift, round((h2 - l2) / (h1 - l1), 6) AS width_ratio, n1 = n2 AS same_size, round(max(abs(m2 - m1)) OVER (PARTITION BY cell), 6) AS largest_shift FROM pairs")
def m35(spark, sf):
    v = variants(spark, sf).withColumn("shift", F.col("median_alt") - F.col("median_main"))
    top = v.groupBy("cell").agg(F.max(F.abs("shift")).alias("top"))
    ratio = (F.col("ci_high_alt") - F.col("ci_low_alt")) / (F.col("ci_high_main") - F.col("ci_low_main"))
    return v.join(top, "cell").select(F.col("cell").cast("int").alias("cell"), "parameter", r6("shift", "shift"), r6(ratio, "width_ratio"),
                                      (F.col("n_draws_main") == F.col("n_draws_alt")).alias("same_size"), r6("top", "largest_shift"))


@query("m36_pool_artefacts", f"""WITH {_MODEL_SQL},
v AS (SELECT m.model, p.p_partkey, p.p_size AS version, p.p_retailprice AS estimate FROM m JOIN part p USING (p_partkey)),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC, p_partkey) = 1)
SELECT model, split_part(model, '_', 1) AS family, version, round(estimate, 4) AS estimate, CAST((SELECT count(*) FROM v w WHERE w.model = k.model) - 1 AS BIGINT) AS n_superseded, contains(model, '_weakprior') AS is_weak FROM k""")
def m36(spark, sf):
    k = F.col("p_partkey")
    model = F.concat(
        F.when(k % 4 == 0, "accuracy_").otherwise("erp_"),
        F.when(F.col("p_size") % 3 == 0, "gender").when(F.col("p_size") % 3 == 1, "agreement").otherwise("marking"), F.when(k % 4 == 0, "").otherwise("_200_500_midline"),
        F.when(k % 5 == 1, "_maxranef").when(k % 5 == 2, "_weakprior").when(k % 5 == 3, "_maxranef_weakprior").otherwise(""))
    v = table(spark, sf, "part").select(model.alias("model"), (-F.col("p_size")).alias("neg_version"), "p_partkey", F.col("p_retailprice").alias("estimate"))
    n = v.groupBy("model").agg((F.count(F.lit(1)) - 1).alias("n_superseded"))
    f = model_fields(F.col("model"))
    best = first_per_key(v, ["model"], ["neg_version", "p_partkey"]).join(n, "model")
    return best.select("model", f["family"].alias("family"), (-F.col("neg_version")).alias("version"), r6("estimate", "estimate", 4), "n_superseded", (f["prior"] == "weak").alias("is_weak"))


@query("m37_credible_tally", f"""WITH {SUM_SQL}
SELECT parameter, CAST(count(*) FILTER (lo > 0 OR hi < 0) AS BIGINT) AS n_credible, CAST(count(*) AS BIGINT) AS n_cells, round(min(pd), 6) AS pd_min, round(max(pd), 6) AS pd_max,
 round(median(hi - lo), 6) AS median_width, round(max(greatest(abs(lo), abs(hi))), 6) AS largest_bound, CAST(count(*) FILTER (med > 0) AS BIGINT) AS n_positive, count(*) = 10 AS complete FROM post GROUP BY parameter""")
def m37(spark, sf):
    s = summary(spark, sf).withColumn("width", F.col("ci_high") - F.col("ci_low"))
    g = s.groupBy("parameter").agg(
        F.count_if(dr.credible()).alias("n_credible"), F.count(F.lit(1)).alias("n_cells"), r6(F.min("pd"), "pd_min"), r6(F.max("pd"), "pd_max"),
        r6(F.max(F.greatest(F.abs("ci_low"), F.abs("ci_high"))), "largest_bound"), F.count_if(F.col("median") > 0).alias("n_positive"), (F.count(F.lit(1)) == 10).alias("complete"))
    return g.join(exact_quantiles(s, ["parameter"], "width", {"w": 0.5}), "parameter").withColumn("median_width", F.round("w", 6)).drop("w")


@query("m38_credibility_flips", f"WITH {PAIR_SQL} SELECT cell, parameter, l1 > 0 OR h1 < 0 AS credible_main, l2 > 0 OR h2 < 0 AS credible_alt, sign(m1) <> sign(m2) AS sign_flip FROM pairs WHERE (l1 > 0 OR h1 < 0) <> (l2 > 0 OR h2 < 0) OR sign(m1) <> sign(m2)")
def m38(spark, sf):
    v = variants(spark, sf)
    a, b = dr.credible("ci_low_main", "ci_high_main"), dr.credible("ci_low_alt", "ci_high_alt")
    flip = F.signum("median_main") != F.signum("median_alt")
    return v.filter((a != b) | flip).select(F.col("cell").cast("int").alias("cell"), "parameter", a.alias("credible_main"), b.alias("credible_alt"), flip.alias("sign_flip"))


@query("m39_band_checks", f"""WITH {CLEAN_SQL},
b AS (SELECT grp, CASE WHEN rt <= 0 THEN 'no_time' WHEN rt <= 200 THEN 'fast' WHEN rt >= 4000 THEN 'slow' ELSE 'kept' END AS band, correct FROM dedup)
SELECT grp, round(avg(correct) FILTER (band = 'fast'), 6) AS p_fast, round(avg(correct) FILTER (band = 'kept'), 6) AS p_kept, round(avg(correct) FILTER (band = 'slow'), 6) AS p_slow,
 round(1.0 - count(*) FILTER (band = 'kept') / count(*), 6) AS share_removed, avg(correct) FILTER (band = 'fast') > avg(correct) FILTER (band = 'kept') AND avg(correct) FILTER (band = 'kept') > avg(correct) FILTER (band = 'slow') AS falls_with_time FROM b GROUP BY grp""")
def m39(spark, sf):
    b = dedup(spark, sf).withColumn("band", rt_band(F.col("rt")))
    p = lambda n: F.avg(F.when(F.col("band") == n, F.col("correct")))
    return b.groupBy("grp").agg(r6(p("fast"), "p_fast"), r6(p("kept"), "p_kept"), r6(p("slow"), "p_slow"), r6(1.0 - F.count_if(F.col("band") == "kept") / F.count(F.lit(1)), "share_removed"),
                                ((p("fast") > p("kept")) & (p("kept") > p("slow"))).alias("falls_with_time"))


@query("m40_kernel_density", f"""WITH {DRAWS_SQL},
h AS (SELECT model, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM draws GROUP BY model)
SELECT model, p AS point, round(avg(exp(-(((-0.5 + p / 32.0 - value) / h) ** 2) / 2)) / (any_value(h) * sqrt(2 * pi())), 6) AS density FROM draws JOIN h USING (model), (SELECT unnest(range(0, 33)) AS p) GROUP BY ALL""")
def m40(spark, sf):
    k = dr.kernel_density(draws(spark, sf).select("model", "value"), ["model"], "value", -0.5, 0.5, 33)
    return k.select("model", "point", r6("density", "density"))


@query("m44_exclusion_claim", """
WITH r AS (SELECT 'cell_' || CAST(p_size AS VARCHAR) AS model, p_partkey % 5 <> 0 AS applicable, CASE WHEN p_partkey % 7 = 0 THEN 'weak' ELSE 'informative' END AS prior, p_partkey % 11 = 0 AS is_robustness,
  CASE WHEN p_partkey % 3 = 0 THEN 'base' ELSE 'maximal' END AS structure, 'v2' AS version, 0 AS invalid_rows, p_retailprice < 1080 AS applied FROM part),
m AS (SELECT * FROM r WHERE applicable AND prior = 'informative' AND NOT is_robustness AND structure = 'maximal'),
f AS (SELECT 'exclusion_applied' AS requirement, 'fits' AS unit, count(*) FILTER (NOT applied) AS n_faults, count(*) AS n_fits FROM m
 UNION ALL SELECT 'valid_rows_only', 'fits', count(*) FILTER (invalid_rows <> 0), count(*) FROM m
 UNION ALL SELECT 'current_version', 'fits', count(*) FILTER (version <> 'v2'), count(*) FROM m
 UNION ALL SELECT 'every_cell_fitted', 'cells', greatest(50 - count(DISTINCT model), 0), count(*) FROM m)
SELECT requirement, unit, CAST(n_faults AS BIGINT) AS n_faults, CAST(n_fits AS BIGINT) AS n_fits, n_faults = 0 AS met FROM f""")
def m44(spark, sf):
    k = F.col("p_partkey")
    r = table(spark, sf, "part").select(
        F.concat(F.lit("cell_"), F.col("p_size").cast("string")).alias("model"), (k % 5 != 0).alias("applicable"), F.when(k % 7 == 0, "weak").otherwise("informative").alias("prior"),
        (k % 11 == 0).alias("is_robustness"), F.when(k % 3 == 0, "base").otherwise("maximal").alias("structure"), F.lit("v2").alias("version"), F.lit(0).alias("invalid_rows"),
        (F.col("p_retailprice") < 1080).alias("applied"))
    return dr.claim_requirements(r, "maximal", "v2", 50)
