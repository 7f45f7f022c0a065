"""Signal jobs (M41-M43, M45) and data-quality rules (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import quality as ql
from trialweave.operators import signal as sg
from trialweave.operators.filters import valid_trials
from trialweave.plans.d_joins import PAIRS_SQL, pair_rows
from trialweave.plans.e1_aggregations import CLEAN_SQL, dedup
from trialweave.plans.standins import MARKERS_SQL, TRIALS_SQL, markers, patterns, r6, trials
from trialweave.registry import query, table

FS = 32.0


@query("m41_zero_phase_filter")
def m41(spark, sf):
    # every vector is one block of a recording (the entity); neighbouring blocks supply the margins
    e = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("recording"), F.col("vec_id").alias("block"), F.col("embedding").cast("array<double>").alias("samples"))
    sections = sg.filter_sections(1.0, 8.0, FS)
    margin = max(sg.decay_samples(s) for s in sections)
    chunks = sg.with_margins(e, ["recording"], "block", "samples", margin)
    return sg.filter_chunks(chunks, "samples", ("keep_start", "keep_length"), 1.0, 8.0, FS).select("recording", "block", "samples")


_MIX = [[((i * 3 + j * 5) % 7 - 3) / 10 for j in range(8)] for i in range(8)]


@query("m42_linear_projection", """
WITH p AS (SELECT vec_id AS trial, t, embedding[t * 8 + 1:t * 8 + 8]::DOUBLE[] AS x FROM embeddings, (SELECT unnest(range(0, 8)) AS t)),
u AS (SELECT trial, t, i, sum(((i * 3 + j * 5) % 7 - 3) / 10 * (x[j + 1] - 0.01)) + 0.01 AS y FROM p, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) GROUP BY ALL)
SELECT trial, CAST(t AS INT) AS time_bin, round(sum(y), 8) AS total, round(max(y), 8) AS largest FROM u GROUP BY ALL""")
def m42(spark, sf):
    y = sg.project(F.col("pattern"), _MIX, [0.01] * 8)
    p = patterns(spark, sf).select("trial", "time_bin", y.alias("y"))
    return p.select("trial", "time_bin", r6(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), "total", 8), r6(F.array_max("y"), "largest", 8))


@query("m43_version_comparison", f"""WITH {PAIRS_SQL},
e AS (SELECT entity, b - a AS err, least(time_ms + 100, 1098 - time_ms) > 100 AS far FROM pair_rows)
SELECT entity, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(err * err)), 6) AS rmse, round(max(abs(err)), 6) AS max_abs, CAST(count(*) FILTER (far) AS BIGINT) AS n_far,
 round(sqrt(avg(CASE WHEN far THEN err * err END)), 6) AS rmse_far, round(quantile_cont(abs(err), 0.9999), 6) AS p9999, sqrt(avg(err * err)) <= 35 AND max(abs(err)) <= 90 AS passes FROM e GROUP BY entity""")
def m43(spark, sf):
    edge = F.least(F.col("time_ms") + 100, 1098 - F.col("time_ms"))
    g = sg.compare_versions(pair_rows(spark, sf), ["entity"], "a", "b", edge, 100, 35.0, 90.0)
    return g.select("entity", "n", r6("rmse", "rmse"), r6("max_abs", "max_abs"), "n_far", r6("rmse_far", "rmse_far"), r6("p9999", "p9999"), "passes")


@query("m43_marker_multisets", f"""WITH {MARKERS_SQL},
a AS (SELECT recording, code, count(*) AS n FROM markers WHERE code IN (1, 2, 3) GROUP BY ALL), b AS (SELECT recording, code - 100 AS code, count(*) AS n FROM markers WHERE code IN (101, 102, 103) GROUP BY ALL)
SELECT coalesce(a.recording, b.recording) AS recording, CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS only_first,
 CAST(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) AS BIGINT) AS only_second FROM a FULL JOIN b ON a.recording = b.recording AND a.code = b.code GROUP BY 1""")
def m43b(spark, sf):
    m = markers(spark, sf)
    a = m.filter(F.col("code").isin(*d.PROPERTY_CODES)).select("recording", "code")
    b = m.filter(F.col("code").isin(*d.CONDITION_CODES)).select("recording", (F.col("code") - 100).alias("code"))
    return sg.multiset_difference(a, b, ["recording"], ["code"])


_SPECTRUM_SQL = """
x AS (SELECT label, vec_id, s, list_transform(embedding[s * 16 + 1:s * 16 + 32]::DOUBLE[], lambda v: v) AS seg FROM embeddings, (SELECT unnest(range(0, 3)) AS s)),
c AS (SELECT label, vec_id, s, n, (seg[n + 1] - list_sum(seg) / 32) * (0.5 - 0.5 * cos(2 * pi() * n / 31)) AS v FROM x, (SELECT unnest(range(0, 32)) AS n)),
win AS (SELECT avg((0.5 - 0.5 * cos(2 * pi() * n / 31)) ** 2) AS u FROM (SELECT unnest(range(0, 32)) AS n)),
f AS (SELECT label, vec_id, s, k, (sum(v * cos(2 * pi() * k * n / 32)) ** 2 + sum(v * sin(2 * pi() * k * n / 32)) ** 2) AS p FROM c, (SELECT unnest(range(0, 17)) AS k) GROUP BY ALL),
r AS (SELECT label, vec_id, k, avg(p / (32.0 * 32 * u)) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM f, win GROUP BY label, vec_id, k),
psd AS (SELECT label, k, avg(p) AS power, count(*) AS n FROM r GROUP BY ALL)"""


@query("m45_power_spectrum", f"WITH {_SPECTRUM_SQL} SELECT label, CAST(k AS DOUBLE) AS freq, round(power, 8) AS power, CAST(n AS BIGINT) AS n_channels FROM psd")
def m45a(spark, sf):
    s = sg.welch_spectra(table(spark, sf, "embeddings"), ["label"], "embedding", FS, 32)
    return s.select("label", "freq", r6("power", "power", 8), "n_channels")


@query("m45_band_power", f"""WITH {_SPECTRUM_SQL},
z AS (SELECT label, k, power, lead(power) OVER (PARTITION BY label ORDER BY k) AS nx FROM psd)
SELECT label, round(sum((power + nx) / 2) FILTER (k >= 1 AND k + 1 < 4), 8) AS slow, round(sum((power + nx) / 2) FILTER (k >= 4 AND k + 1 < 8), 8) AS middle,
 round(sum((power + nx) / 2) FILTER (k >= 8 AND k + 1 < 13), 8) AS fast, CAST(arg_max(k, power) FILTER (k BETWEEN 7 AND 13) AS DOUBLE) AS peak_freq FROM z GROUP BY label""")
def m45b(spark, sf):
    s = sg.welch_spectra(table(spark, sf, "embeddings"), ["label"], "embedding", FS, 32)
    b = sg.band_power(s, ["label"], {"slow": (1.0, 4.0), "middle": (4.0, 8.0), "fast": (8.0, 13.0)}, (7.0, 13.0))
    return b.select("label", *[r6(c, c, 8) for c in ("slow", "middle", "fast")], "peak_freq")


_MATRIX_SQL = f"""{TRIALS_SQL},
att AS (SELECT entity, bool_or(session = 2 AND event_type = 'signup') AS a2, bool_or(session = 3 AND event_type = 'signup') AS a3, bool_or(session = 4 AND event_type = 'signup') AS a4,
  bool_or(session = 6 AND event_type = 'signup') AS a6, bool_or(event_type = 'purchase' AND k < 20) AS acc, bool_or(event_type = 'error' AND k < 20) AS erp FROM trials GROUP BY entity),
mx AS (SELECT c_custkey AS entity, coalesce(a2, FALSE) AS a2, coalesce(a3, FALSE) AS a3, coalesce(a4, FALSE) AS a4, coalesce(a6, FALSE) AS a6, coalesce(acc, FALSE) AS acc, coalesce(erp, FALSE) AS erp,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Mini-English' WHEN 'MACHINERY' THEN 'Mini-Norwegian' END AS rec, CAST(c_acctbal AS BIGINT) AS sid, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS pred FROM customer LEFT JOIN att ON c_custkey = entity)"""


@query("n01_presence_checks", f"""WITH {_MATRIX_SQL}
SELECT rule, severity, entity FROM (
 SELECT 'usable_accuracy:no_session' AS rule, 'error' AS severity, entity FROM mx WHERE acc AND NOT (a2 OR a3 OR a4 OR a6)
 UNION ALL SELECT 'usable_signal:no_session', 'error', entity FROM mx WHERE erp AND NOT (a3 OR a4 OR a6)
 UNION ALL SELECT 'usable_accuracy:without:usable_signal', 'warning', entity FROM mx WHERE acc AND NOT erp
 UNION ALL SELECT 'usable_signal:without:usable_accuracy', 'warning', entity FROM mx WHERE erp AND NOT acc
 UNION ALL SELECT 'id:missing', 'error', entity FROM mx WHERE entity IS NULL
 UNION ALL SELECT 'secondary_id:missing', 'info', entity FROM mx WHERE sid IS NULL
 UNION ALL SELECT 'group:parity', 'error', entity FROM mx WHERE rec <> CASE WHEN entity % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END
 UNION ALL SELECT 'attendance:hole', 'info', entity FROM mx WHERE (a2 AND NOT a3 AND (a4 OR a6)) OR ((a2 OR a3) AND NOT a4 AND a6)
 UNION ALL SELECT 'attendance:none', 'info', entity FROM mx WHERE NOT (a2 OR a3 OR a4 OR a6)
 UNION ALL SELECT 'predictor:missing', 'info', entity FROM mx WHERE (acc OR erp) AND pred IS NULL
 UNION ALL SELECT 'id:repeated', 'error', min(entity) FROM mx WHERE entity IS NOT NULL GROUP BY entity HAVING count(*) > 1
 UNION ALL SELECT 'secondary_id:repeated', 'error', min(entity) FROM mx WHERE sid IS NOT NULL GROUP BY sid HAVING count(*) > 1)""")
def n01(spark, sf):
    return ql.presence_checks(_matrix(spark, sf))


# a stored flow table: accuracy counted over all recorded ids, signal as the matrix has it, a stage that is not built here
# with a total, and one without
@query("n01_flow_totals", f"""WITH {_MATRIX_SQL},
fl AS (SELECT 'usable_accuracy' AS stage, (SELECT count(*) FROM att WHERE acc) AS ship, (SELECT count(*) FROM mx WHERE acc) AS mine UNION ALL SELECT 'usable_signal', (SELECT count(*) FROM mx WHERE erp), (SELECT count(*) FROM mx WHERE erp)
 UNION ALL SELECT 'attended_6', NULL, (SELECT count(*) FROM mx WHERE a6))
SELECT 'flow:mismatch' AS rule, 'error' AS severity, stage, CAST(mine AS BIGINT) AS matrix_total, CAST(ship AS BIGINT) AS flow_total FROM fl WHERE ship IS DISTINCT FROM mine
UNION ALL SELECT 'flow:unverifiable', 'warning', 'followed_up', NULL, CAST(count(*) AS BIGINT) FROM customer""")
def n01b(spark, sf):
    m = _matrix(spark, sf).withColumns({"followed_up": F.lit(None).cast("boolean"), "invited": F.lit(None).cast("boolean")})
    total = lambda df, stage, c=None: df.agg(F.lit(stage).alias("stage"), (F.count(F.lit(1)) if c is None else F.count_if(F.col(c))).alias("n_total"))
    flow = total(_attended(spark, sf), "usable_accuracy", "usable_accuracy").unionByName(total(m, "usable_signal", "usable_signal")).unionByName(total(table(spark, sf, "customer"), "followed_up"))
    none = total(m, "attended_6").unionByName(total(m, "invited")).withColumn("n_total", F.lit(None).cast("bigint"))
    return ql.flow_checks(m, flow.unionByName(none), ["usable_accuracy", "usable_signal", "attended_6", "followed_up", "invited"])


def _attended(spark, sf):
    t = trials(spark, sf)
    s, et, low = F.col("session"), F.col("event_type"), F.col("k") < 20
    return t.groupBy("entity").agg(*[F.bool_or((s == x) & (et == "signup")).alias(f"attended_{x}") for x in d.SESSIONS],
                                   F.bool_or((et == "purchase") & low).alias("usable_accuracy"), F.bool_or((et == "error") & low).alias("usable_signal"))


def _matrix(spark, sf):
    seg = F.col("c_mktsegment")
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.when(seg == "BUILDING", d.GROUP_ODD).when(seg == "MACHINERY", d.GROUP_EVEN).alias("recorded_group"),
        F.bround("c_acctbal", 0).cast("bigint").alias("secondary_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("predictor"))
    return c.join(_attended(spark, sf), "entity", "left")


@query("n02_cell_structure", f"""WITH {CLEAN_SQL},
u AS (SELECT entity, session, property, k, count(*) AS n, count(DISTINCT condition) AS nc FROM valid GROUP BY ALL)
SELECT property, session, CAST(count(*) AS BIGINT) AS n_trials, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_repeated, CAST(count(*) FILTER (nc > 1) AS BIGINT) AS n_mixed_labels, bool_or(n > 1) AS violates FROM u GROUP BY ALL""")
def n02(spark, sf):
    u = valid_trials(trials(spark, sf)).groupBy("entity", "session", "property", "k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("condition").alias("nc"))
    return u.groupBy("property", "session").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("n") > 1).alias("n_repeated"),
                                                F.count_if(F.col("nc") > 1).alias("n_mixed_labels"), F.bool_or(F.col("n") > 1).alias("violates"))


@query("n03_geometry_checks", """
WITH p AS (SELECT s_suppkey AS id, s_suppkey // 2 AS pair, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (1 + s_suppkey // 2 % 5) / 5.0::DOUBLE AS x, CASE WHEN s_nationkey > 20 THEN 0.9 ELSE 0.5 END::DOUBLE AS y FROM supplier)
SELECT pair, CAST(count(*) AS BIGINT) AS n, round(max(x) + min(x), 6) = 0 AS mirrored, max(y) = min(y) AS level, round(max(sqrt(x * x + y * y)), 6) <= 1.2 AS inside FROM p GROUP BY pair""")
def n03(spark, sf):
    k = F.col("s_suppkey")
    x = F.when(k % 2 == 0, -1).otherwise(1) * (1 + F.floor(k / 2) % 5) / F.lit(5.0)
    p = table(spark, sf, "supplier").select(F.floor(k / 2).alias("pair"), x.alias("x"), F.when(F.col("s_nationkey") > 20, 0.9).otherwise(0.5).alias("y"))
    return p.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), (F.round(F.max("x") + F.min("x"), 6) == 0).alias("mirrored"), (F.max("y") == F.min("y")).alias("level"),
                                 (F.round(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), 6) <= 1.2).alias("inside"))


@query("n04_table_invariants", f"""WITH {CLEAN_SQL}
SELECT (SELECT count(*) FROM valid) >= (SELECT count(*) FROM dedup) AS nested, (SELECT count(*) FROM dedup) = (SELECT count(*) FROM kept) + (SELECT count(*) FROM dedup WHERE NOT (rt > 200 AND rt < 4000)) AS parts_sum,
 (SELECT min(correct) >= 0 AND max(correct) <= 1 FROM kept) AS bounded, (SELECT count(DISTINCT session) = 4 FROM kept) AS all_scopes""")
def n04(spark, sf):
    ok = (F.col("rt") > 200) & (F.col("rt") < 4000)
    one = dedup(spark, sf).agg(F.count(F.lit(1)).alias("nd"), F.count_if(ok).alias("nk"), F.count_if(~ok).alias("nx"), F.min(F.when(ok, F.col("correct"))).alias("lo"),
                               F.max(F.when(ok, F.col("correct"))).alias("hi"), F.countDistinct(F.when(ok, F.col("session"))).alias("ns"))
    nv = valid_trials(trials(spark, sf)).agg(F.count(F.lit(1)).alias("nv"))
    return one.crossJoin(nv).select((F.col("nv") >= F.col("nd")).alias("nested"), (F.col("nd") == F.col("nk") + F.col("nx")).alias("parts_sum"),
                                    ((F.col("lo") >= 0) & (F.col("hi") <= 1)).alias("bounded"), (F.col("ns") == 4).alias("all_scopes"))


@query("n05_expected_stages", """
WITH e AS (SELECT unnest(['F', 'O', 'P', 'X']) AS stage), f AS (SELECT DISTINCT o_orderstatus AS stage FROM orders)
SELECT coalesce(e.stage, f.stage) AS stage, e.stage IS NOT NULL AS expected, f.stage IS NOT NULL AS found FROM e FULL JOIN f ON e.stage = f.stage""")
def n05(spark, sf):
    e = spark.createDataFrame([(x,) for x in "FOPX"], "stage string").withColumn("expected", F.lit(True))
    f = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("stage")).distinct().withColumn("found", F.lit(True))
    j = e.join(f, "stage", "full_outer")
    return j.select("stage", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("found", F.lit(False)).alias("found"))


@query("n06_count_cross_checks", """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n1, max(l_linenumber) AS n2, count(DISTINCT l_linenumber) AS n3 FROM lineitem GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_exports, CAST(count(*) FILTER (n1 = n2) AS BIGINT) AS header_equals_text, CAST(count(*) FILTER (n1 = n3) AS BIGINT) AS header_equals_markers, CAST(count(*) FILTER (n1 = n2 AND n1 = n3) AS BIGINT) AS all_agree FROM l""")
def n06(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n1"), F.max("l_linenumber").alias("n2"), F.countDistinct("l_linenumber").alias("n3"))
    a, b = F.col("n1") == F.col("n2"), F.col("n1") == F.col("n3")
    return x.agg(F.count(F.lit(1)).alias("n_exports"), F.count_if(a).alias("header_equals_text"), F.count_if(b).alias("header_equals_markers"), F.count_if(a & b).alias("all_agree"))
