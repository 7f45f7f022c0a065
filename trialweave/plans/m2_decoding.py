"""Section M, second part: pattern classification, permutation nulls, clusters and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.operators import decode as dc
from trialweave.operators import permute as pm
from trialweave.operators import stats as st
from trialweave.plans.standins import N_CHANNELS, PATTERNS_SQL, patterns, r6
from trialweave.registry import query, table

SEED = 20260702
N_PERM = 1000
ALPHA = 0.05
P = N_CHANNELS

# AUC of every channel by itself per entity and time, averaged over entities, for the observed labels (perm 0) and
# N_PERM within-entity shuffles
def label_sql(rows: str, block: str = "") -> str:
    """Labels of every draw, shuffled within block and entity: the first ``ones`` in the draw's order get 1."""
    _DRAWS, _KEY, _ORDER = pm.order_sql(SEED, N_PERM, " || '|' || ".join([*block.replace(",", " ").split(), "entity", "trial"]))
    return f"""draws AS (SELECT * FROM ({_DRAWS})),
lab AS (SELECT {block}trial, entity, perm, CASE WHEN perm = 0 THEN y WHEN row_number() OVER (PARTITION BY {block}perm, entity ORDER BY {_ORDER}, trial) <= sum(y) OVER (PARTITION BY {block}perm, entity) THEN 1 ELSE 0 END AS y
  FROM (SELECT {block}trial, entity, y, {_KEY} AS t FROM {rows}), draws)"""


def course_sql(rows: str, block: str = "") -> str:
    return f"""{label_sql(rows, block)},
px AS (SELECT {block}trial, entity, t AS time_bin, ch AS channel, CAST(embedding[t * {P} + ch + 1] AS DOUBLE) AS x FROM {rows}, (SELECT unnest(range(0, 8)) AS t), (SELECT unnest(range(0, {P})) AS ch)),
rk AS (SELECT {block}trial, entity, time_bin, channel, rank() OVER (PARTITION BY {block}entity, time_bin, channel ORDER BY x) + (count(*) OVER (PARTITION BY {block}entity, time_bin, channel, x) - 1) / 2.0::DOUBLE AS r FROM px),
nn AS (SELECT {block}entity, count(*) AS n, sum(y) AS n1 FROM {rows} GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*)),
rs AS (SELECT {block}entity, perm, channel, time_bin, sum(r) AS s FROM lab JOIN rk USING ({block}trial, entity) WHERE y = 1 GROUP BY ALL),
course AS (SELECT {block}channel, perm, time_bin, round(avg((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1))), 12) AS auc FROM rs JOIN nn USING ({block}entity) GROUP BY ALL)"""


COURSE_SQL = f"{PATTERNS_SQL},\n{course_sql('patterns')}"


def course(spark, sf):
    return dc.channel_course(patterns(spark, sf), [], "entity", "trial", "y", N_PERM, SEED, P)


BINS_SQL = f"""{PATTERNS_SQL},
px AS (SELECT trial, entity, session, grp, y, t AS time_bin, ch AS channel, CAST(embedding[t * {P} + ch + 1] AS DOUBLE) AS x FROM patterns, (SELECT unnest(range(0, 8)) AS t), (SELECT unnest(range(0, {P})) AS ch))"""
# the balanced training rows of M18, by a domain of their own where one is given
BALANCED_SQL = f"""
bn AS (SELECT {{by}}entity, least(sum(y), count(*) - sum(y)) AS m FROM patterns GROUP BY ALL),
br AS (SELECT {{by}}trial, entity, row_number() OVER (PARTITION BY {{by}}entity, y ORDER BY {{digest}}, trial) AS r FROM patterns),
tr AS (SELECT px.* FROM px JOIN br USING ({{by}}trial, entity) JOIN bn USING ({{by}}entity) WHERE r <= m)"""


def moments_sql(rows: str, keys: str) -> str:
    """pa (sums of products) and mm (class counts and sums) per key; ``keys`` with a comma after each."""
    return f"""pa AS (SELECT {keys}a.channel AS i, b.channel AS j, sum(a.x * b.x) AS s FROM {rows} a JOIN {rows} b USING ({keys}trial) GROUP BY ALL),
mm AS (SELECT {keys}channel AS i, count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1, coalesce(sum(x) FILTER (y = 0), 0) AS s0, coalesce(sum(x) FILTER (y = 1), 0) AS s1 FROM {rows} GROUP BY ALL)"""


def weights_sql(keys: str) -> str:
    """wt (keys, w) from pa and mm: the ridged pooled covariance solved by elimination, one step of the recursion per column."""
    on = keys.rstrip(", ")
    return f"""sw AS (SELECT {keys}pa.i, pa.j, (s - a.s0 * b.s0 / a.n0 - a.s1 * b.s1 / a.n1) / (a.n0 + a.n1 - 2) AS v FROM pa JOIN (SELECT {keys}i, n0, n1, s0, s1 FROM mm) a USING ({keys}i) JOIN (SELECT {keys}i AS j, s0, s1 FROM mm) b USING ({keys}j)),
li AS (SELECT {on}, {dc.RIDGE} * sum(v) FILTER (i = j) / {P} + {dc.RIDGE_FLOOR} AS lift FROM sw GROUP BY {on}),
rw AS (SELECT {keys}i, list(v + CASE WHEN i = j THEN lift ELSE 0 END ORDER BY j) AS r FROM sw JOIN li USING ({on}) GROUP BY {keys}i),
sy AS (SELECT {on}, list(list_append(r, s1 / n1 - s0 / n0) ORDER BY i) AS a FROM rw JOIN mm USING ({keys}i) GROUP BY {on}),
ge({keys}k, a) AS (SELECT {on}, 1, a FROM sy UNION ALL
 SELECT {on}, k + 1, [CASE WHEN i = k THEN [x / a[k][k] FOR x IN a[k]] ELSE [a[i][j] - a[i][k] / a[k][k] * a[k][j] FOR j IN range(1, {P + 2})] END FOR i IN range(1, {P + 1})] FROM ge WHERE k <= {P}),
wt AS (SELECT {on}, [r[{P + 1}] FOR r IN a] AS w FROM ge WHERE k = {P + 1})"""


def auc_sql(scores: str, keys: str) -> str:
    """au (keys, auc) from rows (keys, y, s)."""
    on = keys.rstrip(", ")
    return f"""rk AS (SELECT {on}, y, rank() OVER (PARTITION BY {on} ORDER BY s) + (count(*) OVER (PARTITION BY {on}, s) - 1) / 2.0::DOUBLE AS r FROM {scores}),
au AS (SELECT {on}, sum(y) AS n_pos, count(*) - sum(y) AS n_neg, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS auc FROM rk GROUP BY {on} HAVING sum(y) > 0 AND sum(y) < count(*))"""


_PLAIN_DIGEST = f"md5('{SEED}|' || CAST(trial AS VARCHAR))"
# every fold: the total's moments less the held-out entity's
FOLDS_SQL = f"""{BINS_SQL}, {BALANCED_SQL.format(by='', digest=_PLAIN_DIGEST)},
{moments_sql('tr', 'time_bin, entity, ').replace('pa AS', 'po AS').replace('mm AS', 'mo AS')},
ne AS (SELECT time_bin, count(DISTINCT entity) AS n FROM mo GROUP BY time_bin),
pa AS (SELECT po.time_bin, po.entity, po.i, po.j, t.s - po.s AS s FROM po JOIN (SELECT time_bin, i, j, sum(s) AS s FROM po GROUP BY ALL) t USING (time_bin, i, j)),
mm AS (SELECT mo.time_bin, mo.entity, mo.i, t.n0 - mo.n0 AS n0, t.n1 - mo.n1 AS n1, t.s0 - mo.s0 AS s0, t.s1 - mo.s1 AS s1 FROM mo JOIN (SELECT time_bin, i, sum(n0) AS n0, sum(n1) AS n1, sum(s0) AS s0, sum(s1) AS s1 FROM mo GROUP BY ALL) t USING (time_bin, i) JOIN ne USING (time_bin) WHERE ne.n >= 3 AND t.n0 + t.n1 - mo.n0 - mo.n1 >= 4),
{weights_sql('time_bin, entity, ')},
vx AS (SELECT trial, entity, y, time_bin, list(x ORDER BY channel) AS v FROM px GROUP BY ALL)"""


@query("m16_discriminant_weights", f"""WITH RECURSIVE {BINS_SQL}, {moments_sql('px', 'session, time_bin, ')}, {weights_sql('session, time_bin, ')}
SELECT session, time_bin, CAST(ch AS INT) AS channel, round(w[ch + 1], 6) AS weight FROM wt, (SELECT unnest(range(0, {P})) AS ch)""")
def m16(spark, sf):
    p = patterns(spark, sf)
    m = dc.class_moments(p, ["session", "time_bin"], "pattern", "y", P)
    w = m.select("session", "time_bin", dc.weights_of(F.col("moments"), P).alias("weights"))
    return w.select("session", "time_bin", F.posexplode("weights").alias("channel", "weight")).withColumn("weight", r6("weight", "weight"))


@query("m17_auc", f"""WITH {PATTERNS_SQL},
px AS (SELECT trial, entity, y, t AS time_bin, ch AS channel, CAST(embedding[t * {P} + ch + 1] AS DOUBLE) AS x FROM patterns, (SELECT unnest(range(0, 8)) AS t), (SELECT unnest(range(0, {P})) AS ch)),
rk AS (SELECT *, rank() OVER (PARTITION BY entity, time_bin, channel ORDER BY x) + (count(*) OVER (PARTITION BY entity, time_bin, channel, x) - 1) / 2.0::DOUBLE AS r FROM px),
fa AS (SELECT time_bin, channel, entity, sum(y) AS n1, count(*) - sum(y) AS n0, sum(CASE WHEN y = 1 THEN r END) AS s FROM rk GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*))
SELECT time_bin, channel, entity, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg FROM fa""")
def m17(spark, sf):
    p = patterns(spark, sf).select("entity", "time_bin", "y", F.posexplode("pattern").alias("channel", "x"))
    a = st.auc_from_counts(p, ["time_bin", "channel", "entity"], "x", "y").filter("auc is not null")
    return a.select("time_bin", "channel", "entity", r6("auc", "auc"), "n_pos", "n_neg")


@query("m18_balanced_training", f"""WITH {PATTERNS_SQL},
n AS (SELECT entity, least(sum(y), count(*) - sum(y)) AS m FROM patterns GROUP BY entity),
r AS (SELECT trial, entity, y, row_number() OVER (PARTITION BY entity, y ORDER BY md5('{SEED}|' || CAST(trial AS VARCHAR)), trial) AS r FROM patterns)
SELECT trial, entity, y, r <= m AS in_training FROM r JOIN n USING (entity)""")
def m18(spark, sf):
    t = patterns(spark, sf).select("trial", "entity", "y").distinct()
    return dc.balanced_rows(t, [], "entity", "y", "trial", SEED)


@query("m19_label_permutations", f"WITH {PATTERNS_SQL}, {label_sql('patterns')} SELECT trial, string_agg(CAST(y AS VARCHAR), '' ORDER BY perm) AS labels FROM lab GROUP BY trial")
def m19(spark, sf):
    t = patterns(spark, sf).select("trial", "entity", "y").distinct()
    return pm.draw_labels(t, ["entity"], "trial", "y", N_PERM, SEED)


@query("m20_leave_one_out", f"""WITH RECURSIVE {FOLDS_SQL},
sc AS (SELECT time_bin, entity, y, list_inner_product(v, w) AS s FROM vx JOIN wt USING (time_bin, entity)),
{auc_sql('sc', 'time_bin, entity, ')}
SELECT time_bin, round(avg(auc), 6) AS auc, CAST(count(*) AS BIGINT) AS n_folds FROM au GROUP BY time_bin""")
def m20(spark, sf):
    p = patterns(spark, sf)
    flags = dc.balanced_rows(p.select("trial", "entity", "y").distinct(), [], "entity", "y", "trial", SEED).select("trial", "in_training")
    return dc.leave_one_entity_out(p.join(flags, "trial"), ["time_bin"], "entity", "pattern", "y", P).withColumn("auc", r6("auc", "auc"))


@query("m21_entity_folds", f"""WITH e AS (SELECT DISTINCT l_suppkey AS entity FROM lineitem)
SELECT entity, CAST((row_number() OVER (ORDER BY md5('{SEED}|' || CAST(entity AS VARCHAR)), entity) - 1) % 5 + 1 AS INT) AS fold FROM e""")
def m21(spark, sf):
    return dc.entity_folds(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity")), "entity", 5, SEED)


@query("m22_null_timecourse", f"""WITH {COURSE_SQL},
o AS (SELECT channel, time_bin, auc AS observed FROM course WHERE perm = 0)
SELECT channel, time_bin, round(any_value(observed), 6) AS observed, round(avg(auc), 6) AS null_mean, round(quantile_cont(auc, 0.975), 6) AS null_q975, CAST(count(auc) AS BIGINT) AS n_perm,
 round((1.0::DOUBLE + count(*) FILTER (auc >= observed - 1e-12)) / (count(*) + 1), 9) AS p_pointwise FROM course JOIN o USING (channel, time_bin) WHERE perm > 0 GROUP BY channel, time_bin""")
def m22a(spark, sf):
    t = dc.timecourse(course(spark, sf), ["channel"])
    return t.select("channel", "time_bin", r6("observed", "observed"), r6("null_mean", "null_mean"), r6("null_q975", "null_q975"), "n_perm", r6("p_pointwise", "p_pointwise", 9))


@query("m22_decoding_timecourse")
def m22b(spark, sf):
    grid = dc.decode_grid(patterns(spark, sf).drop("session", "grp"), [], "entity", "trial", "y", N_PERM, SEED, P)
    return dc.timecourse(grid, [])


def cluster_sql(keys: str) -> str:
    """Clusters of every observed course; ``keys`` name a course, with a comma after each."""
    on = keys.rstrip(", ")
    return f"""th AS (SELECT {keys}quantile_cont(auc, {1 - ALPHA}) AS thr FROM course WHERE perm > 0 GROUP BY {on}),
ab AS (SELECT {keys}perm, time_bin, auc - thr AS over, auc > thr AS above, row_number() OVER (PARTITION BY {keys}perm ORDER BY time_bin) - row_number() OVER (PARTITION BY {keys}perm, auc > thr ORDER BY time_bin) AS g FROM course JOIN th USING ({on})),
cl AS (SELECT {keys}perm, min(time_bin) AS start, max(time_bin) AS stop, count(*) AS n_points, sum(over) AS mass FROM ab WHERE above GROUP BY {keys}perm, g),
mx AS (SELECT {', '.join('p.' + k.strip() for k in on.split(','))}, p.perm, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT {keys}perm FROM course WHERE perm > 0) p LEFT JOIN cl USING ({keys}perm) GROUP BY ALL),
obs AS (SELECT {keys}row_number() OVER (PARTITION BY {on} ORDER BY start) AS cluster_id, start, stop, n_points, mass, n_perm, (1.0::DOUBLE + n_over) / (n_perm + 1) AS cluster_p
  FROM (SELECT {', '.join('cl.' + k.strip() for k in on.split(','))}, start, stop, n_points, mass, count(*) AS n_perm, count(*) FILTER (top >= mass - 1e-12) AS n_over FROM cl JOIN mx USING ({on}) WHERE cl.perm = 0 GROUP BY ALL))"""


CLUSTER_SQL = f"{COURSE_SQL},\n{cluster_sql('channel, ')}"


@query("m23_cluster_mass", f"WITH {CLUSTER_SQL} SELECT channel, CAST(cluster_id AS BIGINT) AS cluster_id, start, stop, CAST(n_points AS BIGINT) AS n_points, round(mass, 6) AS mass, round(cluster_p, 9) AS cluster_p, cluster_p < {ALPHA} AS significant FROM obs")
def m23(spark, sf):
    c, _ = dc.cluster_test(course(spark, sf), ["channel"], alpha=ALPHA)
    return c.select("channel", "cluster_id", "start", "stop", "n_points", r6("mass", "mass"), r6("cluster_p", "cluster_p", 9), "significant")


BLOCK_SQL = f"""{PATTERNS_SQL},
bl AS (SELECT 'overall' AS analysis, 'all' AS level, * FROM patterns UNION ALL SELECT 'by_session', 'session_' || CAST(session AS VARCHAR), * FROM patterns
  UNION ALL SELECT 'by_session_group', 'session_' || CAST(session AS VARCHAR) || '_' || grp, * FROM patterns),
blocks AS (SELECT analysis, level, count(*) AS n_trials, count(DISTINCT entity) AS n_entities FROM bl GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT entity) >= 3)"""


BLOCK_KEYS = ["analysis", "level", "channel"]


@query("m24_confirmatory_family", f"""WITH {BLOCK_SQL},
inb AS (SELECT bl.* FROM bl JOIN blocks USING (analysis, level)),
{course_sql('inb', 'analysis, level, ')},
{cluster_sql('analysis, level, channel, ')},
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY cluster_p, analysis, level, cluster_id) AS r, count(*) OVER (PARTITION BY channel) AS m FROM obs WHERE analysis = 'overall'),
q AS (SELECT *, least(1, min(cluster_p * m / r) OVER (PARTITION BY channel ORDER BY r DESC)) AS q FROM r)
SELECT analysis, level, channel, CAST(cluster_id AS BIGINT) AS cluster_id, round(obs.cluster_p, 9) AS cluster_p, CAST(obs.n_perm AS BIGINT) AS n_perm, CASE WHEN analysis = 'overall' THEN 'confirmatory' ELSE 'exploratory' END AS inference,
 round(q, 9) AS cluster_p_fdr, coalesce(q < {ALPHA}, false) AS significant_fdr FROM obs LEFT JOIN q USING (analysis, level, channel, cluster_id)""")
def m24(spark, sf):
    """Clusters of every block; the overall block's are the confirmatory family of their channel."""
    b = dc.analysis_blocks(patterns(spark, sf), "entity", "trial").drop("n_trials", "n_entities", "session", "grp")
    grid = dc.channel_course(b, ["analysis", "level"], "entity", "trial", "y", N_PERM, SEED, P)
    c, _ = dc.cluster_test(grid, BLOCK_KEYS, alpha=ALPHA)
    f = dc.confirmatory_fdr(c, F.col("analysis") == "overall", alpha=ALPHA, family=("channel",), keys=("analysis", "level", "cluster_id"))
    return f.select(*BLOCK_KEYS, "cluster_id", r6("cluster_p", "cluster_p", 9), "n_perm", "inference", r6("cluster_p_fdr", "cluster_p_fdr", 9), "significant_fdr")


@query("m25_blocks", f"WITH {BLOCK_SQL} SELECT analysis, level, CAST(n_trials AS BIGINT) AS n_trials, CAST(n_entities AS BIGINT) AS n_entities FROM blocks")
def m25a(spark, sf):
    one = patterns(spark, sf).select("trial", "entity", "session", "grp").distinct()
    b = dc.analysis_blocks(one, "entity", "trial")
    return b.groupBy("analysis", "level").agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("entity").alias("n_entities"))


@query("m25_block_decoding")
def m25b(spark, sf):
    b = dc.analysis_blocks(patterns(spark, sf), "entity", "trial").drop("n_trials", "n_entities", "session", "grp")
    grid = dc.decode_grid(b, ["analysis", "level"], "entity", "trial", "y", N_PERM, SEED, P)
    return dc.timecourse(grid, ["analysis", "level"])


def across_sql(domain: str) -> str:
    digest = f"md5('{SEED}|' || CAST({domain} AS VARCHAR) || '|' || CAST(trial AS VARCHAR))"
    return f"""WITH RECURSIVE {BINS_SQL}, {BALANCED_SQL.format(by=f'{domain}, ', digest=digest)}, {moments_sql('tr', f'{domain}, time_bin, ')}, {weights_sql(f'{domain}, time_bin, ')},
vx AS (SELECT trial, {domain} AS test_set, y, time_bin, list(x ORDER BY channel) AS v FROM px GROUP BY ALL),
sc AS (SELECT wt.{domain} AS train_set, test_set, time_bin, y, list_inner_product(v, w) AS s FROM vx JOIN wt USING (time_bin) WHERE wt.{domain} <> test_set),
{auc_sql('sc', 'train_set, test_set, time_bin, ')}
SELECT train_set, test_set, time_bin, round(auc, 6) AS auc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM au"""


@query("m26_cross_group", across_sql("grp"))
def m26a(spark, sf):
    return dc.generalise(patterns(spark, sf), "grp", "entity", "trial", "y", SEED, P).withColumn("auc", r6("auc", "auc"))


@query("m26_cross_domain", across_sql("session"))
def m26b(spark, sf):
    return dc.generalise(patterns(spark, sf), "session", "entity", "trial", "y", SEED, P).withColumn("auc", r6("auc", "auc"))


TEMPORAL_SQL = f"""{FOLDS_SQL},
sc AS (SELECT wt.time_bin AS train_bin, vx.time_bin AS test_bin, entity, y, list_inner_product(v, w) AS s FROM vx JOIN wt USING (entity)),
{auc_sql('sc', 'train_bin, test_bin, entity, ')},
tg AS (SELECT train_bin, test_bin, avg(auc) AS auc, count(*) AS n_folds FROM au GROUP BY ALL)"""


@query("m27_temporal_generalisation", f"WITH RECURSIVE {TEMPORAL_SQL} SELECT train_bin, test_bin, round(auc, 6) AS auc, CAST(n_folds AS BIGINT) AS n_folds FROM tg")
def m27(spark, sf):
    return dc.temporal_generalisation(patterns(spark, sf), "entity", "trial", "y", SEED, P, stride=1).withColumn("auc", r6("auc", "auc"))


@query("m28_decoding_summary", f"""WITH {CLUSTER_SQL},
c AS (SELECT channel, time_bin * 150 - 100 AS time_ms, auc FROM course WHERE perm = 0),
k AS (SELECT channel, count(*) AS n, count(*) FILTER (cluster_p < {ALPHA}) AS sig, min(start) AS lo, max(stop) AS hi FROM obs GROUP BY channel)
SELECT channel, round(max(auc) FILTER (time_ms >= 0), 6) AS peak_auc, arg_max(time_ms, auc) FILTER (time_ms >= 0) AS peak_ms, round(avg(auc) FILTER (time_ms < 0), 6) AS pre_mean_auc,
 CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_clusters, CAST(coalesce(any_value(sig), 0) AS BIGINT) AS n_significant,
 CAST(any_value(lo) * 150 - 100 AS BIGINT) AS span_start_ms, CAST(any_value(hi) * 150 - 100 AS BIGINT) AS span_stop_ms FROM c LEFT JOIN k USING (channel) GROUP BY channel""")
def m28(spark, sf):
    grid = course(spark, sf)
    t = F.col("time_bin") * 150 - 100
    c = grid.filter("perm = 0").select("channel", t.alias("time_ms"), "auc")
    post = F.when(F.col("time_ms") >= 0, F.col("auc"))
    a = c.groupBy("channel").agg(r6(F.max(post), "peak_auc"), F.max_by("time_ms", post).alias("peak_ms"), r6(F.avg(F.when(F.col("time_ms") < 0, F.col("auc"))), "pre_mean_auc"))
    cl, _ = dc.cluster_test(grid, ["channel"], alpha=ALPHA)
    s = cl.groupBy("channel").agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if("significant").alias("n_significant"),
                                  (F.min("start") * 150 - 100).cast("bigint").alias("span_start_ms"), (F.max("stop") * 150 - 100).cast("bigint").alias("span_stop_ms"))
    return a.join(s, "channel", "left").na.fill(0, ["n_clusters", "n_significant"])


# The regions of the matrix that the study describes, in ms; the bins stand at these times
_BIN_MS = (-98, -82, -34, -18, 22, 78, 200, 400)
_REGIONS = {
    "reversal": "tr > -100 AND tr < -65 AND te > -35 AND te < 0", "carry": "tr > -35 AND tr < 0 AND te > 0 AND te <= 100",
    "late": "tr >= 200 AND te >= 200 AND tr <> te", "cross": "tr > -35 AND tr < 0 AND te >= 200",
}


@query("m28_region_means", f"""WITH RECURSIVE {TEMPORAL_SQL},
ms AS (SELECT {list(_BIN_MS)}[train_bin + 1] AS tr, {list(_BIN_MS)}[test_bin + 1] AS te, auc FROM tg)
SELECT {', '.join(f'round(avg(auc) FILTER ({where}), 6) AS {name}' for name, where in _REGIONS.items())} FROM ms""")
def m28b(spark, sf):
    m = dc.temporal_generalisation(patterns(spark, sf), "entity", "trial", "y", SEED, P, stride=1)
    ms = lambda c: F.element_at(F.array(*[F.lit(v) for v in _BIN_MS]), F.col(c) + 1)
    m = m.select(ms("train_bin").alias("tr"), ms("test_bin").alias("te"), "auc")
    out = dc.region_means(m, {n: F.expr(w) for n, w in _REGIONS.items()})
    return out.select(*[r6(n, n) for n in _REGIONS])


@query("m29_assembly", f"""WITH {BLOCK_SQL},
ex AS (SELECT level AS block, n_trials, n_entities, 'fp1' AS fp FROM blocks),
bk AS (SELECT 'session_' || CAST(session AS VARCHAR) || '_' || grp AS block, count(*) AS n_trials, count(DISTINCT entity) AS n_entities, CASE WHEN session = 6 THEN 50 ELSE 100 END AS n_perm, CASE WHEN session = 4 THEN 'fp0' ELSE 'fp1' END AS fp FROM patterns GROUP BY ALL
  UNION ALL SELECT 'session_' || CAST(session AS VARCHAR), count(*) - 1, count(DISTINCT entity), 100, 'fp1' FROM patterns GROUP BY session UNION ALL SELECT 'session_9', 30, 3, 100, 'fp1' FROM (SELECT 1) x)
SELECT block, CAST(bk.n_trials AS BIGINT) AS n_trials, CAST(bk.n_entities AS BIGINT) AS n_entities, bk.n_perm, CASE WHEN ex.block IS NULL THEN 'stray' WHEN bk.block IS NULL THEN 'dropped' WHEN bk.fp <> ex.fp THEN 'other inputs'
 WHEN bk.n_trials <> ex.n_trials OR bk.n_entities <> ex.n_entities THEN 'count mismatch' WHEN bk.n_perm < 100 THEN 'fewer permutations' ELSE 'ok' END AS state FROM bk FULL JOIN ex USING (block)""")
def m29(spark, sf):
    one = patterns(spark, sf).select("trial", "entity", "session", "grp").distinct()
    counts = lambda df, *k: df.groupBy(*k).agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("entity").alias("n_entities"))
    expected = counts(dc.analysis_blocks(one, "entity", "trial").drop("n_trials", "n_entities"), F.col("level").alias("block")).withColumn("fingerprint", F.lit("fp1"))
    s = F.col("session")
    name = F.concat(F.lit("session_"), s.cast("string"))
    fine = counts(one, s, F.col("grp")).select(F.concat(name, F.lit("_"), "grp").alias("block"), "n_trials", "n_entities", F.when(s == 6, 50).otherwise(100).alias("n_perm"),
                                               F.when(s == 4, "fp0").otherwise("fp1").alias("fingerprint"))
    coarse = counts(one, s).select(name.alias("block"), (F.col("n_trials") - 1).alias("n_trials"), "n_entities", F.lit(100).alias("n_perm"), F.lit("fp1").alias("fingerprint"))
    stray = spark.createDataFrame([("session_9", 30, 3, 100, "fp1")], "block string, n_trials bigint, n_entities bigint, n_perm int, fingerprint string")
    previous = expected.select("block", F.lit(100).alias("n_perm"))
    return dc.assemble_blocks(fine.unionByName(coarse).unionByName(stray), expected, previous)


