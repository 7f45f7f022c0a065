"""Section M, first part: tests and resampling over groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.functions.dist import (
    binom_half_two_sided_udf, chi2_tail1_sql, chi2_tail_udf, norm_tail_sql, t_quantile_col, t_values_sql,
)
from trialweave.operators import aggregate as ag
from trialweave.operators import joins as jn
from trialweave.operators import stats as st
from trialweave.operators.permute import order_sql
from trialweave.operators import windows as wn
from trialweave.operators.skew import exact_quantiles, with_group_stats
from trialweave.plans.d_joins import HOUR, PAIRS_SQL, pair_rows
from trialweave.plans.e1_aggregations import CLEAN_SQL, WAVE_SQL, dedup, waves
from trialweave.plans.e2_audit_tables import _WIDE_SQL, wide_cells
from trialweave.plans.f_windows import ADJUST_SQL, p_values
from trialweave.plans.standins import MARKERS_SQL, SAMPLES_SQL, TRIALS_SQL, WINDOWS_SQL, markers, r6, samples, trials, windows
from trialweave.registry import query, table

SEED = 20260702


@query("m01_t_interval", f"""
WITH tq(dof, t) AS (VALUES {t_values_sql(0.975, 1200)}),
g AS (SELECT l_suppkey, avg(l_discount) AS m, stddev_samp(l_discount) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(m, 8) AS mean, round(m - t * se, 8) AS ci_low, round(m + t * se, 8) AS ci_high, round({chi2_tail1_sql('((m - 0.05) / se) * ((m - 0.05) / se)')}, 8) AS chi2_p FROM g LEFT JOIN tq ON dof = n - 1""")
def m01(spark, sf):
    x = F.col("l_discount")
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(x).alias("m"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.count(x).alias("n"))
    g = g.withColumns({"t": t_quantile_col(0.975, F.col("n") - 1), "q": F.pow((F.col("m") - 0.05) / F.col("se"), 2)})
    return g.select("l_suppkey", r6("m", "mean", 8), r6(F.col("m") - F.col("t") * F.col("se"), "ci_low", 8), r6(F.col("m") + F.col("t") * F.col("se"), "ci_high", 8),
                    r6(F.expr(chi2_tail1_sql("q")), "chi2_p", 8))


_LABEL_SQL = f"""{CLEAN_SQL}, lab AS (SELECT event_id, entity, session, property, k, correct AS y, CASE WHEN condition = 'Ungrammatical' THEN 1 ELSE 0 END AS viol FROM dedup)"""


def labelled(spark, sf):
    return dedup(spark, sf).select("event_id", "entity", "session", "property", "k", F.col("correct").alias("y"), (F.col("condition") == d.VIOLATION).cast("int").alias("viol"))


@query("m02_mantel_haenszel", f"""WITH {_LABEL_SQL},
t AS (SELECT property, entity, count(*) FILTER (viol = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (viol = 1 AND y = 0)::DOUBLE AS b, count(*) FILTER (viol = 0 AND y = 1)::DOUBLE AS c,
  count(*) FILTER (viol = 0 AND y = 0)::DOUBLE AS dd FROM lab GROUP BY ALL),
u AS (SELECT *, a + b + c + dd AS n FROM t WHERE a + b > 0 AND c + dd > 0 AND a + c > 0 AND b + dd > 0),
v AS (SELECT property, a * dd / n AS r, b * c / n AS s, (a + dd) / n AS p, (b + c) / n AS q, a - (a + b) * (a + c) / n AS dev, (a + b) * (c + dd) * (a + c) * (b + dd) / (n * n * (n - 1)) AS var FROM u),
w AS (SELECT property, sum(r) AS r, sum(s) AS s, sum(p * r) AS pr, sum(p * s + q * r) AS ps, sum(q * s) AS qs, sum(dev) AS dev, sum(var) AS var, count(*) AS k FROM v GROUP BY property),
x AS (SELECT *, sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s)) AS se, dev * dev / var AS cmh FROM w)
SELECT property, round(r / s, 6) AS odds_ratio, round(r / s * exp(-1.959963984540054 * se), 6) AS or_low, round(r / s * exp(1.959963984540054 * se), 6) AS or_high,
 round({chi2_tail1_sql('cmh')}, 6) AS cmh_p, CAST(k AS BIGINT) AS n_strata FROM x""")
def m02(spark, sf):
    g = st.mantel_haenszel(labelled(spark, sf), "y", "viol", ["entity"], ["property"])
    return g.select("property", *[r6(c, c) for c in ("odds_ratio", "or_low", "or_high", "cmh_p")], "n_strata")


# Newton steps with the stratum intercepts eliminated, as a recursion over steps: one row per stratum carries its intercept
_LOGIT_SQL = f"""{_LABEL_SQL},
lp AS (SELECT entity, y, viol AS x1, (CASE session WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END) / 3.0::DOUBLE AS x2 FROM lab WHERE y IS NOT NULL AND viol IS NOT NULL),
ok AS (SELECT entity, count(*)::DOUBLE AS tn, sum(y)::DOUBLE AS ts FROM lp GROUP BY entity HAVING sum(y) > 0 AND sum(y) < count(*)),
ce AS (SELECT entity, x1, x2, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM lp JOIN ok USING (entity) GROUP BY ALL),
it(k, entity, alpha, b1, b2, s11, s12, s22) AS (
 SELECT 0, entity, ln(ts / (tn - ts)), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ok
 UNION ALL
 SELECT k + 1, entity, alpha + (g - c1 * (r1 * s22 - r2 * s12) / det - c2 * (r2 * s11 - r1 * s12) / det) / a, b1 + (r1 * s22 - r2 * s12) / det, b2 + (r2 * s11 - r1 * s12) / det, s11, s12, s22 FROM (
  SELECT *, s11 * s22 - s12 * s12 AS det FROM (
   SELECT k, entity, alpha, b1, b2, a, g, c1, c2, sum(g1 - c1 * g / a) OVER () AS r1, sum(g2 - c2 * g / a) OVER () AS r2, sum(h11 - c1 * c1 / a) OVER () AS s11, sum(h12 - c1 * c2 / a) OVER () AS s12, sum(h22 - c2 * c2 / a) OVER () AS s22 FROM (
    SELECT k, entity, alpha, b1, b2, sum(w) AS a, sum(r) AS g, sum(w * x1) AS c1, sum(w * x2) AS c2, sum(r * x1) AS g1, sum(r * x2) AS g2, sum(w * x1 * x1) AS h11, sum(w * x1 * x2) AS h12, sum(w * x2 * x2) AS h22 FROM (
     SELECT k, entity, alpha, b1, b2, x1, x2, n * mu * (1 - mu) AS w, s - n * mu AS r FROM (SELECT it.k, it.entity, it.alpha, it.b1, it.b2, ce.x1, ce.x2, ce.n, ce.s, 1 / (1 + exp(-(it.alpha + it.b1 * ce.x1 + it.b2 * ce.x2))) AS mu FROM it JOIN ce ON it.entity = ce.entity WHERE it.k < 12))
    GROUP BY k, entity, alpha, b1, b2)))),
fin AS (SELECT * FROM it WHERE k = 12),
dv AS (SELECT sum(-2 * (s * ln(ts / tn) + (n - s) * ln(1 - ts / tn))) - sum(-2 * (s * ln(mu) + (n - s) * ln(1 - mu))) AS lr, sum(n) AS n FROM (SELECT ce.*, ok.tn, ok.ts, 1 / (1 + exp(-(alpha + b1 * x1 + b2 * x2))) AS mu FROM ce JOIN ok USING (entity) JOIN fin USING (entity))),
co AS (SELECT any_value(b1) AS b1, any_value(b2) AS b2, sqrt(any_value(s22 / (s11 * s22 - s12 * s12))) AS e1, sqrt(any_value(s11 / (s11 * s22 - s12 * s12))) AS e2, count(*) AS k FROM fin),
te AS (SELECT unnest(['viol', 'pos']) AS term, unnest([b1, b2]) AS beta, unnest([e1, e2]) AS se, k FROM co)"""
_LOGIT_COLS = ("beta", "se", "lr", "odds_ratio", "or_low", "or_high", "p", "lr_p")


@query("m03_stratum_logit", f"""WITH RECURSIVE {_LOGIT_SQL}
SELECT term, round(beta, 6) AS beta, round(se, 6) AS se, round(lr, 6) AS lr, 2.0::DOUBLE AS lr_df, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS n_strata, round(exp(beta), 6) AS odds_ratio, round(exp(beta - 1.96 * se), 6) AS or_low,
 round(exp(beta + 1.96 * se), 6) AS or_high, round(2 * {norm_tail_sql('beta / se')}, 6) AS p, round(exp(-lr / 2), 6) AS lr_p FROM te, dv""")
def m03(spark, sf):
    lab = labelled(spark, sf).withColumn("pos", d.level_index(F.col("session"), d.SESSIONS) / 3)
    t = st.logit_table(spark, st.stratum_logit(lab, "y", ["viol", "pos"], ["entity"]), ["viol", "pos"])
    return t.select("term", "lr_df", "n", "n_strata", *[r6(c, c) for c in _LOGIT_COLS])


N_DRAWS = 1000


@query("m04_permutation_condition", f"""WITH {_LABEL_SQL},
g AS (SELECT entity, count(*) AS n, sum(viol) AS m, sum(y) AS s, sum(y * viol) AS a FROM lab WHERE y IS NOT NULL AND viol IS NOT NULL GROUP BY entity),
k AS (SELECT entity, n, m, s, unnest(range(greatest(0, m + s - n)::BIGINT, least(m, s)::BIGINT + 1)) AS k, greatest(0, m + s - n) AS low FROM g),
w AS (SELECT entity, k, low, exp(sum(CASE WHEN k = low THEN 0 ELSE ln((m - k + 1.0::DOUBLE) * (s - k + 1) / (k * (n - m - s + k))) END) OVER (PARTITION BY entity ORDER BY k)) AS w FROM k),
f AS (SELECT entity, k, low, sum(w) OVER (PARTITION BY entity ORDER BY k) / sum(w) OVER (PARTITION BY entity) AS cdf FROM w),
u AS (SELECT entity, b AS perm, ('0x' || substr(md5('{SEED}|' || b || '|' || entity), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, {N_DRAWS + 1})) AS b)),
nul AS (SELECT perm, sum(x)::DOUBLE AS stat FROM (SELECT perm, entity, max(low) + count(*) FILTER (cdf < u) AS x FROM u JOIN f USING (entity) GROUP BY ALL) GROUP BY perm),
o AS (SELECT sum(a)::DOUBLE AS observed, (SELECT avg(stat) FROM nul) AS null_mean FROM g)
SELECT round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round((1.0::DOUBLE + (SELECT count(*) FROM nul WHERE abs(stat - o.null_mean) >= abs(o.observed - o.null_mean) - 1e-9)) / ({N_DRAWS} + 1), 9) AS p FROM o""")
def m04a(spark, sf):
    g = st.permutation_condition(labelled(spark, sf), "y", "viol", ["entity"], N_DRAWS, SEED)
    return g.select(r6("observed", "observed"), r6("null_mean", "null_mean"), r6("p", "p", 9))


_DRAWS, _KEY, _ORDER = order_sql(SEED, N_DRAWS, "entity || '|' || event_id")


@query("m04_permutation_covariance", f"""WITH {_LABEL_SQL},
base AS (SELECT event_id, entity, y, k - avg(k) OVER (PARTITION BY entity) AS x, {_KEY} AS t FROM lab WHERE y IS NOT NULL AND k IS NOT NULL),
h AS (SELECT perm, y, x, row_number() OVER (PARTITION BY perm, entity ORDER BY {_ORDER}, event_id) AS r, sum(y) OVER (PARTITION BY perm, entity) AS ones FROM base, ({_DRAWS}) WHERE perm > 0),
nul AS (SELECT perm, sum(CASE WHEN r <= ones THEN x ELSE 0 END)::DOUBLE AS stat FROM h GROUP BY perm),
o AS (SELECT sum(y * x)::DOUBLE AS observed, (SELECT avg(stat) FROM nul) AS null_mean FROM base)
SELECT round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round((1.0::DOUBLE + (SELECT count(*) FROM nul WHERE abs(stat - o.null_mean) >= abs(o.observed - o.null_mean) - 1e-9)) / ({N_DRAWS} + 1), 9) AS p FROM o""")
def m04b(spark, sf):
    g = st.permutation_covariance(labelled(spark, sf), "y", "k", ["entity"], "event_id", N_DRAWS, SEED)
    return g.select(r6("observed", "observed"), r6("null_mean", "null_mean"), r6("p", "p", 9))


@query("m05_chi_square", f"""WITH {CLEAN_SQL},
c AS (SELECT session, property, condition, count(*)::DOUBLE AS o FROM dedup GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY session, property) * sum(o) OVER (PARTITION BY session, condition) / sum(o) OVER (PARTITION BY session) AS e, sum(o) OVER (PARTITION BY session) AS n FROM c)
SELECT session, round(sum((o - e) * (o - e) / e), 6) AS chi2, ((count(DISTINCT property) - 1) * (count(DISTINCT condition) - 1))::DOUBLE AS dof, CAST(max(n) AS BIGINT) AS n, round(exp(-sum((o - e) * (o - e) / e) / 2), 8) AS p FROM e GROUP BY session""")
def m05(spark, sf):
    g = st.chi_square(dedup(spark, sf), ["session"], "property", "condition")
    return g.withColumn("p", chi2_tail_udf("chi2", "dof")).select("session", r6("chi2", "chi2"), "dof", "n", r6("p", "p", 8))


_SHARE_SQL = f"""{CLEAN_SQL},
sh AS (SELECT session, entity, CASE WHEN grp = 'Mini-English' THEN 0 ELSE 1 END AS g, avg(correct) AS v FROM dedup GROUP BY ALL)"""


def shares(spark, sf):
    return dedup(spark, sf).groupBy("session", "entity", F.when(F.col("grp") == d.GROUP_ODD, 0).otherwise(1).alias("g")).agg(F.avg("correct").alias("v"))


@query("m06_welch_and_ranks", f"""WITH {_SHARE_SQL},
w AS (SELECT session, avg(v) FILTER (g = 0) AS m0, avg(v) FILTER (g = 1) AS m1, var_samp(v) FILTER (g = 0) / count(*) FILTER (g = 0) AS q0, var_samp(v) FILTER (g = 1) / count(*) FILTER (g = 1) AS q1,
  count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1 FROM sh GROUP BY session),
r AS (SELECT session, g, v, rank() OVER (PARTITION BY session ORDER BY v) + (count(*) OVER (PARTITION BY session, v) - 1) / 2.0::DOUBLE AS rk FROM sh),
ti AS (SELECT session, sum(c * c * c - c) AS ties FROM (SELECT session, v, count(*)::DOUBLE AS c FROM sh GROUP BY ALL) GROUP BY session),
u AS (SELECT session, sum(rk) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2 AS u FROM r GROUP BY session),
z AS (SELECT w.*, u.u, (u.u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1.0::DOUBLE)))) AS z FROM w JOIN u USING (session) JOIN ti USING (session))
SELECT session, round((m0 - m1) / sqrt(q0 + q1), 6) AS t, round((q0 + q1) * (q0 + q1) / (q0 * q0 / (n0 - 1) + q1 * q1 / (n1 - 1)), 6) AS dof, round(u, 6) AS u, round(z, 6) AS z, round(2 * {norm_tail_sql('z')}, 8) AS mwu_p FROM z""")
def m06a(spark, sf):
    s = shares(spark, sf)
    w = st.welch(s, ["session"], F.col("g"), "v").select("session", r6("t", "t"), r6("dof", "dof"))
    u = st.mann_whitney(s, ["session"], F.col("g"), "v").select("session", r6("u", "u"), r6("z", "z"), r6("p", "mwu_p", 8))
    return w.join(u, "session")


@query("m06_leave_one_out", f"""WITH {_SHARE_SQL},
l AS (SELECT a.session, a.entity, avg(b.v) FILTER (b.g = 0) AS m0, avg(b.v) FILTER (b.g = 1) AS m1, var_samp(b.v) FILTER (b.g = 0) / count(*) FILTER (b.g = 0) AS q0,
 var_samp(b.v) FILTER (b.g = 1) / count(*) FILTER (b.g = 1) AS q1 FROM sh a JOIN sh b ON a.session = b.session AND a.entity <> b.entity GROUP BY ALL)
SELECT session, entity, round((m0 - m1) / sqrt(q0 + q1), 5) AS t FROM l""")
def m06b(spark, sf):
    return st.leave_one_out_welch(shares(spark, sf), ["session"], "entity", "g", "v").select("session", "entity", r6("t", "t", 5))


# the t tail as an integral of cos^(dof - 1) over angles, by Simpson's rule
@query("m06_welch_p", f"""WITH {_SHARE_SQL},
w AS (SELECT session, avg(v) FILTER (g = 0) - avg(v) FILTER (g = 1) AS dm, var_samp(v) FILTER (g = 0) / count(*) FILTER (g = 0) AS q0, var_samp(v) FILTER (g = 1) / count(*) FILTER (g = 1) AS q1, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1 FROM sh GROUP BY session),
t AS (SELECT session, dm / sqrt(q0 + q1) AS t, (q0 + q1) * (q0 + q1) / (q0 * q0 / (n0 - 1) + q1 * q1 / (n1 - 1)) AS dof FROM w),
th AS (SELECT *, atan(abs(t) / sqrt(dof)) AS lo, (pi() / 2 - atan(abs(t) / sqrt(dof))) / 20000 AS h FROM t),
si AS (SELECT session, any_value(t) AS t, any_value(dof) AS dof, sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(lo + i * h), 0), dof - 1)) * any_value(h) / 3 AS area FROM th, (SELECT unnest(range(0, 20001)) AS i) GROUP BY session)
SELECT session, round(t, 6) AS t, round(dof, 6) AS dof, round(2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * area, 6) AS p FROM si""")
def m06c(spark, sf):
    return st.with_t_p(st.welch(shares(spark, sf), ["session"], F.col("g"), "v")).select("session", *[r6(c, c) for c in ("t", "dof", "p")])


_SHIFT_SQL = f"""{TRIALS_SQL},
per AS (SELECT session, entity, condition, avg(CASE WHEN correct = 1 THEN k / 100.0::DOUBLE END) - avg(k / 100.0::DOUBLE) AS s FROM trials WHERE condition IS NOT NULL GROUP BY ALL),
df AS (SELECT session, entity, max(s) FILTER (condition = 'Grammatical') - max(s) FILTER (condition = 'Ungrammatical') AS v FROM per GROUP BY ALL HAVING v IS NOT NULL)"""


def shifts(spark, sf):
    x = F.col("k") / F.lit(100.0)
    per = trials(spark, sf).filter("condition is not null").groupBy("session", "entity", "condition").agg(
        (F.avg(F.when(F.col("correct") == 1, x)) - F.avg(x)).alias("s"))
    return jn.paired_difference(per, ["session", "entity"], "condition", "s", d.VIOLATION, d.CONTROL).select("session", "entity", F.col("difference").alias("v"))


_BOOT, _SLOT, _PICK = order_sql(SEED, 2000, "session || '|' || i")


@query("m07_bootstrap_mean", f"""WITH {_SHIFT_SQL},
i AS (SELECT session, entity, v, row_number() OVER (PARTITION BY session ORDER BY entity) AS i, count(*) OVER (PARTITION BY session) AS n FROM df),
p AS (SELECT session, perm AS b, ({_PICK}) % n + 1 AS i FROM (SELECT session, n, {_SLOT} AS t FROM i), ({_BOOT}) WHERE perm > 0),
m AS (SELECT session, b, avg(v) AS m FROM p JOIN i USING (session, i) GROUP BY ALL)
SELECT session, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY session""")
def m07(spark, sf):
    return st.bootstrap_mean(shifts(spark, sf), ["session"], "entity", "v", 2000, SEED).select("session", r6("low", "low"), r6("high", "high"))


@query("m08_signed_rank", f"""WITH {_WIDE_SQL},
dd AS (SELECT session, n1 - n2 AS x FROM wide WHERE n1 <> n2),
r AS (SELECT session, x, rank() OVER (PARTITION BY session ORDER BY abs(x)) + (count(*) OVER (PARTITION BY session, abs(x)) - 1) / 2.0::DOUBLE AS rk FROM dd),
ti AS (SELECT session, sum(c * c * c - c) AS t FROM (SELECT session, abs(x) AS a, count(*)::DOUBLE AS c FROM dd GROUP BY ALL) GROUP BY session),
g AS (SELECT session, sum(rk) FILTER (x > 0) AS w, count(*) FILTER (x > 0) AS n_pos, count(*) FILTER (x < 0) AS n_neg, count(*)::DOUBLE AS n FROM r GROUP BY session),
z AS (SELECT g.*, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24) AS z FROM g JOIN ti USING (session))
SELECT session, round(w, 6) AS w_plus, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(z, 6) AS z, round(2 * {norm_tail_sql('z')}, 8) AS p FROM z""")
def m08a(spark, sf):
    w = wide_cells(spark, sf).withColumn("x", F.col("n1") - F.col("n2"))
    return st.signed_rank(w, ["session"], "x").select("session", r6("w_plus", "w_plus"), "n_pos", "n_neg", r6("z", "z"), r6("p", "p", 8))


@query("m08_sign_test", f"""WITH {_WIDE_SQL},
g AS (SELECT session, count(*) FILTER (n1 > n2) AS a, count(*) FILTER (n1 < n2) AS b FROM wide WHERE n1 <> n2 GROUP BY session),
k AS (SELECT session, a, b, unnest(range(0, least(a, b) + 1)) AS k FROM g)
SELECT session, CAST(a AS BIGINT) AS n_pos, CAST(b AS BIGINT) AS n_neg, round(least(1, 2 * sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2)))), 6) AS p FROM k GROUP BY session, a, b""")
def m08b(spark, sf):
    w = wide_cells(spark, sf).withColumn("x", F.col("n1") - F.col("n2"))
    g = st.signed_rank(w, ["session"], "x")
    k, n = F.col("n_pos").cast("double"), (F.col("n_pos") + F.col("n_neg")).cast("double")
    return g.select("session", "n_pos", "n_neg", r6(binom_half_two_sided_udf(k, n), "p"))


@query("m09_family_decisions", f"""WITH {ADJUST_SQL}
SELECT family, CAST(count(*) AS BIGINT) AS n_tests, CAST(count(*) FILTER (p < 0.05) AS BIGINT) AS n_raw, CAST(count(*) FILTER (p_bh < 0.05) AS BIGINT) AS n_bh,
 CAST(count(*) FILTER (p_holm < 0.05) AS BIGINT) AS n_holm, round(min(p_bh), 8) AS smallest_q FROM adj GROUP BY family""")
def m09(spark, sf):
    a = wn.adjust_p(p_values(spark, sf), ["family"], "p", "test")
    return a.groupBy("family").agg(F.count(F.lit(1)).alias("n_tests"), *[F.count_if(F.col(c) < 0.05).alias(n) for c, n in (("p", "n_raw"), ("p_bh", "n_bh"), ("p_holm", "n_holm"))],
                                   r6(F.min("p_bh"), "smallest_q", 8))


@query("m10_equivalence", f"""WITH {SAMPLES_SQL}, {WINDOWS_SQL}, tq(dof, t) AS (VALUES {t_values_sql(0.95, 400)}), tr(dof, u) AS (VALUES {t_values_sql(0.975, 400)}),
m AS (SELECT entity, session, window_name, condition, avg(amplitude) AS v FROM samples JOIN windows ON time_ms BETWEEN min_ms AND max_ms GROUP BY ALL),
dd AS (SELECT a.session, a.window_name, b.v - a.v AS x FROM m a JOIN m b USING (entity, session, window_name) WHERE a.condition = 'Grammatical' AND b.condition = 'Ungrammatical'),
g AS (SELECT session, window_name, avg(x) AS m, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM dd GROUP BY ALL)
SELECT session, window_name, round(m, 6) AS mean, round(se, 6) AS se, CAST(n AS BIGINT) AS n, round(m - t * se, 6) AS ci90_low, round(m + t * se, 6) AS ci90_high,
 round(m - u * se, 6) AS ci95_low, round(m + u * se, 6) AS ci95_high, m - t * se > -2.5 AND m + t * se < 2.5 AS passes FROM g JOIN tq ON tq.dof = n - 1 JOIN tr ON tr.dof = n - 1""")
def m10(spark, sf):
    w = ag.windowed_differences(samples(spark, sf).withColumn("sensor", F.lit("all")), windows(spark), ["entity", "session"], "sensor")
    g = st.equivalence(w, ["session", "window_name"], "difference", 2.5)
    return g.select("session", "window_name", r6("mean", "mean"), r6("se", "se"), "n", *[r6(c, c) for c in ("ci90_low", "ci90_high", "ci95_low", "ci95_high")], "passes")


@query("m11_adjusted_contrast", f"""WITH {CLEAN_SQL},
b AS (SELECT session, property, condition, correct = 1 AS kept_t, rt AS y, CAST(k AS DOUBLE) AS b FROM dedup),
c AS (SELECT session, property, condition, kept_t, count(*)::DOUBLE AS n, avg(y) AS my, avg(b) AS mb, sum(b) AS sb, covar_pop(b, y) * count(*) AS cby, var_pop(b) * count(*) AS cbb, var_pop(y) * count(*) AS cyy FROM b GROUP BY ALL),
g AS (SELECT session, property, sum(cby) / sum(cbb) AS slope, sum(cby) AS cby, sum(cyy) AS cyy, sum(n) AS n, sum(sb) / sum(n) AS bbar FROM c GROUP BY ALL HAVING min(n) >= 2 AND count(*) = 4),
a AS (SELECT c.session, c.property, condition, kept_t, c.n, my - slope * (mb - bbar) AS adj, slope, (g.cyy - slope * g.cby) / (g.n - 5) AS s2 FROM c JOIN g USING (session, property)),
w AS (SELECT session, property, any_value(slope) AS slope, any_value(s2) AS s2, sum(1 / n) AS inv, max(adj) FILTER (condition = 'Grammatical' AND kept_t) AS c1, max(adj) FILTER (condition = 'Grammatical' AND NOT kept_t) AS c0,
  max(adj) FILTER (condition = 'Ungrammatical' AND kept_t) AS v1, max(adj) FILTER (condition = 'Ungrammatical' AND NOT kept_t) AS v0 FROM a GROUP BY ALL)
SELECT session, property, round((v0 - c0) - (v1 - c1), 4) AS d_int, round(((c0 - c1) + (v0 - v1)) / 2, 4) AS d_main, round(slope, 6) AS slope, round(sqrt(s2), 4) AS trial_sd, round(s2 * inv, 3) AS var_int FROM w""")
def m11(spark, sf):
    t = dedup(spark, sf).select("session", "property", "condition", (F.col("correct") == 1).alias("kept"), F.col("rt").alias("y"), F.col("k").cast("double").alias("b"))
    g = st.adjusted_contrast(t, ["session", "property"], "condition", "kept", "y", "b", d.CONTROL, d.VIOLATION)
    return g.select("session", "property", r6("d_int", "d_int", 4), r6("d_main", "d_main", 4), r6("slope", "slope"), r6("trial_sd", "trial_sd", 4), r6("var_int", "var_int", 3))


@query("m12_word_locked_windows", """
WITH e AS (SELECT vec_id, label AS w, 16 + label AS w0, embedding::DOUBLE[] AS x FROM embeddings)
SELECT vec_id, CASE WHEN w < 2 THEN 'offset outside the expected range' WHEN w0 + 40 > 64 THEN 'epoch runs past the stored window' END AS reason,
 CASE WHEN w >= 2 AND w0 + 40 <= 64 THEN round(list_sum(x[w0 - 7:w0]) / 8, 8) END AS baseline, CASE WHEN w >= 2 AND w0 + 40 <= 64 THEN round(list_sum(x[w0 + 1:w0 + 40]) / 40, 8) END AS window_mean FROM e""")
def m12(spark, sf):
    w = F.col("label")
    w0 = w + 16
    x = F.transform("embedding", lambda v: v.cast("double"))
    mean = lambda a, n: F.round(F.aggregate(F.slice(x, a, F.lit(n)), F.lit(0.0), lambda s, v: s + v) / n, 8)
    reason = F.when(w < 2, "offset outside the expected range").when(w0 + 40 > 64, "epoch runs past the stored window")
    ok = reason.isNull()
    return table(spark, sf, "embeddings").select("vec_id", reason.alias("reason"), F.when(ok, mean(w0 - 7, 8)).alias("baseline"), F.when(ok, mean(w0 + 1, 40)).alias("window_mean"))


@query("m13_condition_events", f"""WITH {MARKERS_SQL},
c AS (SELECT recording, seq AS segment_id, code AS condition, pos FROM markers WHERE code IN (101, 102, 103))
SELECT c.recording, segment_id, condition, CAST(count(m.seq) AS BIGINT) AS n_preceding, CAST(arg_max(m.code, m.pos) AS INT) AS nearest_code, CAST(max(c.pos) - max(m.pos) AS BIGINT) AS nearest_us,
 count(m.seq) = 1 AS kept FROM c LEFT JOIN markers m ON m.recording = c.recording AND m.pos >= c.pos - {12 * HOUR}::BIGINT AND m.pos < c.pos GROUP BY ALL""")
def m13(spark, sf):
    m = markers(spark, sf)
    c = m.filter(F.col("code").isin(*d.CONDITION_CODES)).select("recording", F.col("seq").alias("segment_id"), F.col("code").alias("condition"), (F.col("pos") - 12 * HOUR).alias("start"))
    near = jn.points_in_segments(m, c.select("recording", "segment_id", "start"), ["recording"], "pos", 12 * HOUR)
    g = near.groupBy("recording", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("code", "pos").cast("int").alias("nearest_code"), (12 * HOUR - F.max("relative")).alias("nearest_us"))
    out = c.join(g, ["recording", "segment_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("recording", "segment_id", "condition", n.alias("n_preceding"), "nearest_code", "nearest_us", (n == 1).alias("kept"))


@query("m14_trial_correlation", f"""WITH {PAIRS_SQL},
c AS (SELECT entity, corr(a, b) AS r, corr(a, rotated) AS rc FROM rotated GROUP BY entity)
SELECT round(quantile_cont(r, 0.25), 6) AS q1, round(median(r), 6) AS q2, round(quantile_cont(r, 0.75), 6) AS q3, round(quantile_cont(rc, 0.25), 6) AS control_q1, round(median(rc), 6) AS control_q2,
 round(quantile_cont(rc, 0.75), 6) AS control_q3, CAST(count(*) AS BIGINT) AS n_pairs FROM c""")
def m14(spark, sf):
    r = jn.rotated_pairs(pair_rows(spark, sf), ["entity"], ["session", "time_ms"], "a", "b")
    c = r.groupBy("entity").agg(F.corr("a", "b").alias("r"), F.corr("a", "rotated").alias("rc"))
    q = lambda p: {f"{p}q{i}": i / 4 for i in (1, 2, 3)}
    out = exact_quantiles(c, [], "r", q("")).crossJoin(exact_quantiles(c, [], "rc", q("control_"))).crossJoin(c.agg(F.count(F.lit(1)).alias("n_pairs")))
    return out.select(*[r6(k, k) for k in (*q(""), *q("control_"))], "n_pairs")


@query("m15_split_half", f"""WITH {SAMPLES_SQL},
u AS (SELECT entity, session, sensor, (time_ms + 100) // 100 AS bin, CASE WHEN row_number() OVER (PARTITION BY entity, session ORDER BY condition, marker, sensor, time_ms, amplitude) % 2 = 1 THEN 'odd' ELSE 'even' END AS half, amplitude FROM samples),
m AS (SELECT entity, session, sensor, bin, avg(amplitude) FILTER (half = 'odd') AS o, avg(amplitude) FILTER (half = 'even') AS e FROM u GROUP BY ALL HAVING o IS NOT NULL AND e IS NOT NULL),
c AS (SELECT entity, session, sensor, corr(o, e) AS r FROM m GROUP BY ALL)
SELECT entity, session, round(avg(r), 6) AS split_half_r FROM c WHERE NOT isnan(r) GROUP BY ALL""")
def m15a(spark, sf):
    s = samples(spark, sf).select("entity", "session", "condition", "marker", "sensor", "time_ms", "amplitude")
    u = wn.alternate_split(s, ["entity", "session"], ["condition", "marker", "sensor", "time_ms", "amplitude"]).withColumn("bin", F.floor((F.col("time_ms") + 100) / 100))
    m = u.groupBy("entity", "session", "sensor", "bin").agg(*[F.avg(F.when(F.col("half") == h, F.col("amplitude"))).alias(h) for h in ("odd", "even")]).na.drop(subset=["odd", "even"])
    c = m.groupBy("entity", "session", "sensor").agg(F.corr("odd", "even").alias("r")).filter("not isnan(r) and r is not null")
    return c.groupBy("entity", "session").agg(r6(F.avg("r"), "split_half_r"))


@query("m15_leave_one_out_r", f"""WITH {WAVE_SQL},
a AS (SELECT entity, session, time_ms, avg(v) AS v FROM wave GROUP BY ALL),
o AS (SELECT *, (sum(v) OVER w - v) / (count(*) OVER w - 1) AS others, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY session, time_ms))
SELECT entity, session, round(corr(v, others), 6) AS loo_r, round(max(abs(v)), 6) AS peak, round(sqrt(avg(v * v)), 6) AS rms FROM o WHERE n > 1 GROUP BY ALL""")
def m15b(spark, sf):
    a = waves(spark, sf).groupBy("entity", "session", "time_ms").agg(F.avg("mean_value").alias("v"))
    o = with_group_stats(a, ["session", "time_ms"], _s=F.sum("v"), _n=F.count("v")).filter("_n > 1")
    o = o.withColumn("others", (F.col("_s") - F.col("v")) / (F.col("_n") - 1))
    return o.groupBy("entity", "session").agg(r6(F.corr("v", "others"), "loo_r"), r6(F.max(F.abs("v")), "peak"), r6(F.sqrt(F.avg(F.col("v") * F.col("v"))), "rms"))
