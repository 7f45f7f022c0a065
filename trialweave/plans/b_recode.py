"""Section B: projections and recodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import recode as rc
from trialweave.plans.standins import MARKERS_SQL, SAMPLES_SQL, TRIALS_SQL, markers, r6, samples, trials
from trialweave.registry import query, table


@query("b01_label_recode", f"""WITH {TRIALS_SQL}
SELECT CASE property WHEN 'gender' THEN 'gender agreement' WHEN 'agreement' THEN 'verb-object agreement'
            WHEN 'marking' THEN 'differential object marking' END AS property_label,
       coalesce(condition, 'unlabelled') AS condition_label, 'Session ' || CAST(session AS VARCHAR) AS session_label,
       CAST(count(*) AS BIGINT) AS n FROM trials GROUP BY ALL""")
def b01(spark, sf):
    t = trials(spark, sf)
    names = {"gender": "gender agreement", "agreement": "verb-object agreement", "marking": "differential object marking"}
    return t.groupBy(
        rc.recode(F.col("property"), names).alias("property_label"),
        F.coalesce("condition", F.lit("unlabelled")).alias("condition_label"),
        F.concat(F.lit("Session "), F.col("session").cast("string")).alias("session_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("b02_text_class", """
SELECT lang, CASE WHEN contains(lower(trim(text)), 'license') THEN 'license'
  WHEN contains(lower(trim(text)), '@') THEN 'address' WHEN contains(lower(trim(text)), 'http') THEN 'link'
  ELSE 'plain' END AS text_class, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL""")
def b02(spark, sf):
    cls = rc.text_class(F.col("text"), [("license", "license"), ("@", "address"), ("http", "link")], "plain")
    return table(spark, sf, "documents").groupBy("lang", cls.alias("text_class")).agg(F.count(F.lit(1)).alias("n"))


@query("b03_map_agreement", """
WITH map AS (SELECT DISTINCT l_linenumber AS sensor, CASE WHEN l_linenumber <= 3 THEN 'anterior'
                WHEN l_linenumber <= 5 THEN 'medial' ELSE 'posterior' END AS region FROM lineitem),
 other AS (SELECT DISTINCT l_linenumber AS sensor, CASE l_linenumber WHEN 1 THEN 'anterior' WHEN 2 THEN 'anterior'
             WHEN 3 THEN 'anterior' WHEN 4 THEN 'medial' WHEN 5 THEN 'posterior' ELSE 'posterior' END AS region FROM lineitem)
SELECT sensor, region, 'first only' AS side FROM (SELECT * FROM map EXCEPT ALL SELECT * FROM other)
UNION ALL SELECT sensor, region, 'second only' FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM map)""")
def b03(spark, sf):
    s = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(s.alias("sensor")).distinct()
    c = F.col("sensor")
    a = lines.select("sensor", F.when(c <= 3, "anterior").when(c <= 5, "medial").otherwise("posterior").alias("region"))
    b = lines.select("sensor", rc.recode(c, {1: "anterior", 2: "anterior", 3: "anterior", 4: "medial"},
                                         F.lit("posterior")).alias("region"))
    return (a.exceptAll(b).withColumn("side", F.lit("first only"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("second only"))))


@query("b04_sum_codes", f"""WITH {TRIALS_SQL}
SELECT event_id, CASE condition WHEN 'Grammatical' THEN 0.5::DOUBLE WHEN 'Ungrammatical' THEN -0.5::DOUBLE END AS c_condition,
  CASE grp WHEN 'Mini-Norwegian' THEN 0.5::DOUBLE WHEN 'Mini-English' THEN -0.5::DOUBLE END AS c_group,
  CASE session WHEN 2 THEN 0::DOUBLE WHEN 3 THEN 1::DOUBLE WHEN 4 THEN 2::DOUBLE WHEN 6 THEN 3::DOUBLE END AS c_session
FROM trials""")
def b04(spark, sf):
    return rc.contrast_columns(trials(spark, sf)).select("event_id", "c_condition", "c_group", "c_session")


@query("b05_composite_keys", f"""WITH {TRIALS_SQL}
SELECT event_id, CASE WHEN property IS NOT NULL AND condition IS NOT NULL AND k IS NOT NULL THEN
  property || '|' || condition || '|' || CAST(k AS VARCHAR) END AS item_id,
  CASE WHEN condition IS NOT NULL THEN CAST(entity AS VARCHAR) || '|' || CAST(session AS VARCHAR) || '|' || condition || '|' || CAST(k AS VARCHAR) END AS trial_uid
FROM trials""")
def b05(spark, sf):
    return trials(spark, sf).select("event_id", d.composite_key("property", "condition", "k").alias("item_id"),
                                    d.composite_key("entity", "session", "condition", "k").alias("trial_uid"))


@query("b06_parity_group", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END AS grp FROM customer""")
def b06(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", d.group_from_parity(F.col("c_custkey")).alias("grp"))


@query("b07_blank_to_null", """
WITH x AS (SELECT role, nullif(trim(split_part(text, '.', 2)), '') AS second_part FROM conversations)
SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(count(second_part) AS BIGINT) AS n_filled FROM x GROUP BY role""")
def b07(spark, sf):
    c = table(spark, sf, "conversations")
    x = c.select("role", F.split_part("text", F.lit("."), F.lit(2)).alias("second_part"))
    return rc.blank_to_null(x).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("second_part").alias("n_filled"))


@query("b08_path_fields", """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang,
  TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS record_no FROM pages""")
def b08(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract(u, "^https?://[^/]+/([a-z]{2})/", 1).alias("lang"),
        F.nullif(F.regexp_extract(u, "/([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("record_no"))


@query("b09_days_from_reference", f"""WITH {TRIALS_SQL},
s AS (SELECT entity, session, min(ts) AS started FROM trials GROUP BY ALL)
SELECT a.entity, a.session, round_even((epoch_us(a.started) - epoch_us(b.started)) / 86400000000.0::DOUBLE, 1) AS days_from_reference
FROM s a LEFT JOIN s b ON a.entity = b.entity AND b.session = 2""")
def b09(spark, sf):
    s = trials(spark, sf).groupBy("entity").agg(
        *[F.min(F.when(F.col("session") == k, F.col("ts"))).alias(f"s{k}") for k in d.SESSIONS])
    rows = s.select("entity", "s2", F.explode(F.array(*[
        F.struct(F.lit(k).alias("session"), F.col(f"s{k}").alias("started")) for k in d.SESSIONS])).alias("x"))
    return rows.filter("x.started is not null").select(
        "entity", "x.session", rc.days_between(F.col("x.started"), F.col("s2")).alias("days_from_reference"))


@query("b10_standardise_predictors", f"""WITH {TRIALS_SQL},
c AS (SELECT event_id, property, CASE condition WHEN 'Grammatical' THEN 0.5::DOUBLE WHEN 'Ungrammatical' THEN -0.5::DOUBLE END AS x FROM trials),
s AS (SELECT property, avg(x) AS m, stddev_samp(x) AS sd FROM c GROUP BY property)
SELECT c.event_id, round(CASE WHEN s.m IS NULL THEN NULL WHEN s.sd IS NULL OR s.sd = 0 THEN CASE WHEN x IS NOT NULL THEN 0 END
  ELSE (x - s.m) / s.sd END, 6) AS z_condition FROM c JOIN s ON c.property IS NOT DISTINCT FROM s.property""")
def b10(spark, sf):
    t = rc.contrast_columns(trials(spark, sf)).select("event_id", "property", "c_condition")
    return rc.zscore(t, ["property"], "c_condition", "z").select("event_id", r6("z", "z_condition"))


@query("b11_covariate_fill", f"""WITH {TRIALS_SQL},
j AS (SELECT t.event_id, t.entity, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS cov FROM trials t LEFT JOIN customer ON c_custkey = entity),
p AS (SELECT entity, max(cov) AS v FROM j GROUP BY entity)
SELECT event_id, round(coalesce(cov, (SELECT avg(v) FROM p)), 6) AS cov, cov IS NULL AS cov_imputed FROM j""")
def b11(spark, sf):
    cust = table(spark, sf, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("cov"))
    t = trials(spark, sf).select("event_id", "entity").join(cust, "entity", "left")
    return rc.fill_from_entities(t, "entity", "cov").select("event_id", r6("cov", "cov"), "cov_imputed")


_UNIT_SQL = "entity, session, condition, marker, time_ms"


@query("b12_session_rereference", f"""WITH {SAMPLES_SQL},
s AS (SELECT {_UNIT_SQL}, sensor, avg(amplitude) AS v FROM samples WHERE session = 2 GROUP BY ALL),
r AS (SELECT {_UNIT_SQL}, sum(CASE WHEN sensor IN ('c6', 'c7') THEN v END) AS ref FROM s GROUP BY ALL)
SELECT sensor, CAST(count(*) AS BIGINT) AS n, CAST(count(y) AS BIGINT) AS n_value, round(avg(y), 6) AS mean_value FROM (
 SELECT sensor, CASE WHEN sensor = 'c1' THEN v * 1.5 WHEN sensor NOT IN ('c6', 'c7') THEN v - ref / 6 ELSE v END AS y
 FROM s JOIN r USING ({_UNIT_SQL})) GROUP BY sensor""")
def b12(spark, sf):
    unit = ["entity", "session", "condition", "marker", "time_ms"]
    s = samples(spark, sf).filter("session = 2").groupBy(*unit, "sensor").agg(F.avg("amplitude").alias("v"))
    out = rc.subtract_reference(s, unit, "sensor", "v", ("c6", "c7"), 6.0, ~F.col("sensor").isin("c6", "c7"), {"c1": 1.5}, "y")
    return out.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_value"), r6(F.avg("y"), "mean_value"))


@query("b13_rereference", f"""WITH {SAMPLES_SQL},
s AS (SELECT {_UNIT_SQL}, sensor, avg(amplitude) AS v FROM samples GROUP BY ALL),
r AS (SELECT {_UNIT_SQL}, sum(CASE WHEN sensor IN ('c4', 'c5') THEN v END) / 3 AS ref FROM s GROUP BY ALL),
o AS (SELECT sensor, v - ref AS v FROM s JOIN r USING ({_UNIT_SQL}) WHERE sensor IN ('c1', 'c2', 'c3')
      UNION ALL SELECT 'implicit', -ref FROM r)
SELECT sensor, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_value, round(avg(v), 6) AS mean_value FROM o GROUP BY sensor""")
def b13(spark, sf):
    unit = ["entity", "session", "condition", "marker", "time_ms"]
    s = samples(spark, sf).groupBy(*unit, "sensor").agg(F.avg("amplitude").alias("v"))
    out = rc.rereference(s, unit, "sensor", "v", ("c4", "c5"), ("c1", "c2", "c3"), "implicit", implicit_included=True)
    return out.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_value"), r6(F.avg("v"), "mean_value"))


@query("b14_planar_projection", """
WITH a AS (SELECT s_suppkey, CAST(s_suppkey % 181 - 90 AS DOUBLE) AS theta, CAST((s_suppkey * 7) % 181 - 90 AS DOUBLE) AS phi FROM supplier)
SELECT s_suppkey, round(abs(theta) / 90 * cos(radians(CASE WHEN theta >= 0 THEN phi ELSE phi + 180 END)), 9) AS x,
  round(abs(theta) / 90 * sin(radians(CASE WHEN theta >= 0 THEN phi ELSE phi + 180 END)), 9) AS y FROM a""")
def b14(spark, sf):
    k = F.col("s_suppkey")
    x, y = rc.plane_x_y((k % 181 - 90).cast("double"), ((k * 7) % 181 - 90).cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", r6(x, "x", 9), r6(y, "y", 9))


@query("b15_absolute_clock", f"""WITH {MARKERS_SQL},
m AS (SELECT recording, seq, pos // 2000 AS p, code, last_value(CASE WHEN code IN (5, 6, 7, 8) THEN pos END IGNORE NULLS) OVER w AS seg_us,
   last_value(CASE WHEN code IN (5, 6, 7, 8) THEN pos // 2000 END IGNORE NULLS) OVER w AS seg_p FROM markers
   WINDOW w AS (PARTITION BY recording ORDER BY pos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT recording, seq, CAST(seg_us + (p - seg_p) * 2000 AS BIGINT) AS abs_us FROM m WHERE code IN (101, 102, 103)""")
def b15(spark, sf):
    m = markers(spark, sf).withColumn("p", F.floor(F.col("pos") / 2000))
    out = rc.absolute_clock(m, ["recording"], ["pos", "seq"], F.col("code").isin(5, 6, 7, 8), F.col("pos"), F.col("p"), 2000)
    return out.filter(F.col("code").isin(*d.CONDITION_CODES)).select("recording", "seq", "abs_us")


@query("b16_interval_clamp", """
SELECT l_suppkey, greatest(0, least(1, round(avg(l_discount) * 20 - 0.2, 6))) AS low FROM lineitem GROUP BY 1""")
def b16(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        rc.clamp01(F.round(F.avg("l_discount") * 20 - 0.2, 6)).alias("low"))


@query("b17_trial_position", f"""WITH {TRIALS_SQL},
t AS (SELECT event_id, session, rt, k + 1 AS trial, 100 AS n_trials, CASE WHEN session = 2 THEN 40 ELSE 50 END AS bs FROM trials),
u AS (SELECT *, (trial - 1) % bs AS pos, (trial - 1) // bs AS blk FROM t)
SELECT event_id, round(ln(greatest(rt, 0) + 1), 6) AS log_rt, trial / n_trials AS trial_prop,
  CASE WHEN trial / n_trials > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS second_half, CAST(pos AS BIGINT) AS pos_in_block, CAST(blk AS BIGINT) AS block_no,
  CASE WHEN pos = 0 AND blk > 0 THEN 1 ELSE 0 END AS first_after_break,
  CASE WHEN least(CASE WHEN blk > 0 THEN pos ELSE 999 END,
    CASE WHEN trial + (bs - 1 - pos) < n_trials THEN bs - 1 - pos ELSE 999 END) <= 2 THEN 1 ELSE 0 END AS near_break FROM u""")
def b17(spark, sf):
    t = trials(spark, sf).select("event_id", "session", "rt", (F.col("k") + 1).alias("trial"), F.lit(100).alias("n_trials"))
    out = rc.trial_position_fields(t, "trial", "n_trials", F.when(F.col("session") == 2, 40).otherwise(50), "rt")
    return out.select("event_id", r6("log_rt", "log_rt"), "trial_prop", "second_half", "pos_in_block", "block_no",
                      "first_after_break", "near_break")


@query("b18_name_normalise", """
WITH n AS (SELECT p_partkey, lower(regexp_replace(trim(upper(p_type) || ' (' || p_brand || ') '), '\\s*\\(.*\\)\\s*$', '')) AS low FROM part)
SELECT p_partkey, upper(low[1:1]) || low[2:] AS type_name, regexp_matches(low, '^(economy|stand)') AS is_common FROM n""")
def b18(spark, sf):
    raw = F.concat(F.upper("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(") "))
    name = rc.language_norm(raw)
    return table(spark, sf, "part").select("p_partkey", name.alias("type_name"),
                                           F.lower(name).rlike("^(economy|stand)").alias("is_common"))


@query("b19_drop_by_pattern", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def b19(spark, sf):
    return rc.drop_like(table(spark, sf, "orders"), r"status$|date$|priority$")


@query("b20_retention_code", f"""WITH {TRIALS_SQL},
c AS (SELECT entity, property, max(session) AS last_s, count(DISTINCT session) AS n FROM trials GROUP BY ALL)
SELECT event_id, CASE WHEN n >= 3 THEN CASE WHEN session = last_s THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END END AS retention
FROM trials JOIN c ON trials.entity = c.entity AND trials.property IS NOT DISTINCT FROM c.property""")
def b20(spark, sf):
    t = trials(spark, sf).select("event_id", "entity", "property", "session")
    return rc.retention_code(t, ["entity", "property"], "session").select("event_id", "retention")


_MODEL_SQL = """
m AS (SELECT p_partkey, (CASE WHEN p_partkey % 4 = 0 THEN 'accuracy_' ELSE 'erp_' END) ||
  (CASE p_size % 3 WHEN 0 THEN 'gender' WHEN 1 THEN 'agreement' ELSE 'marking' END) ||
  (CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '_200_500_midline' END) ||
  (CASE p_partkey % 5 WHEN 1 THEN '_maxranef' WHEN 2 THEN '_weakprior' WHEN 3 THEN '_maxranef_weakprior' ELSE '' END) AS model FROM part)"""


@query("b21_model_fields", f"""WITH {_MODEL_SQL}
SELECT p_partkey, split_part(model, '_', 1) AS family, split_part(model, '_', 2) AS property,
  CASE WHEN contains(model, '_200_500') THEN '200_500' END AS window_name, CASE WHEN contains(model, '_midline') THEN 'midline' END AS macroregion,
  CASE WHEN contains(model, '_maxranef') THEN 'maximal' ELSE 'base' END AS structure,
  CASE WHEN contains(model, '_weakprior') THEN 'weak' ELSE 'informative' END AS prior,
  contains(model, '_maxranef') OR contains(model, '_weakprior') AS is_variant FROM m""")
def b21(spark, sf):
    k = F.col("p_partkey")
    model = F.concat(
        F.when(k % 4 == 0, "accuracy_").otherwise("erp_"),
        F.when(F.col("p_size") % 3 == 0, "gender").when(F.col("p_size") % 3 == 1, "agreement").otherwise("marking"),
        F.when(k % 4 == 0, "").otherwise("_200_500_midline"),
        F.when(k % 5 == 1, "_maxranef").when(k % 5 == 2, "_weakprior").when(k % 5 == 3, "_maxranef_weakprior").otherwise(""))
    p = table(spark, sf, "part").select("p_partkey", model.alias("model"))
    return p.select("p_partkey", *[c.alias(n) for n, c in rc.model_fields(F.col("model")).items()])


