"""Section E, first half: windowed series and judgement aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.functions.dist import norm_quantile_sql, t_values_sql
from trialweave.operators import aggregate as ag
from trialweave.operators.filters import rt_band, valid_trials
from trialweave.operators.skew import exact_quantiles, first_per_key
from trialweave.plans.standins import SAMPLES_SQL, TRIAL_KEY, TRIALS_SQL, WINDOWS_SQL, r6, samples, trials, windows
from trialweave.registry import query, table
from trialweave.runtime import pin

KEY = "entity, session, condition, marker"
TQ = f"tq(dof, t) AS (VALUES {t_values_sql(0.975, 600)})"
CLEAN_SQL = f"""{TRIALS_SQL},
valid AS (SELECT * FROM trials WHERE property IS NOT NULL AND condition IS NOT NULL AND correct IS NOT NULL),
dedup AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY entity, session, property, k ORDER BY ts, event_id) = 1),
kept AS (SELECT * FROM dedup WHERE rt > 200 AND rt < 4000)"""


def kept(spark, sf):
    return ag.judgement_trials(trials(spark, sf))


def dedup(spark, sf):
    return first_per_key(valid_trials(trials(spark, sf)), ["entity", "session", "property", "k"], ["ts", "event_id"])


@query("e01_trial_window_means", f"""WITH {SAMPLES_SQL}, {WINDOWS_SQL},
r AS (SELECT {KEY}, window_name, region, avg(amplitude) AS v FROM samples JOIN windows ON time_ms BETWEEN min_ms AND max_ms GROUP BY ALL)
SELECT {KEY}, window_name, CAST(count(*) AS BIGINT) AS n_regions, round(avg(v), 6) AS mean_value FROM r GROUP BY ALL""")
def e01(spark, sf):
    m = ag.trial_window_means(samples(spark, sf), windows(spark), TRIAL_KEY)
    return m.select(*TRIAL_KEY, "window_name", "n_regions", r6("mean_value", "mean_value"))


@query("e02_trial_baseline", f"""WITH {SAMPLES_SQL},
r AS (SELECT {KEY}, region, avg(amplitude) AS v FROM samples WHERE time_ms < 0 GROUP BY ALL)
SELECT {KEY}, round(avg(v), 6) AS baseline FROM r GROUP BY ALL""")
def e02(spark, sf):
    return ag.trial_baselines(samples(spark, sf), TRIAL_KEY).select(*TRIAL_KEY, r6("baseline", "baseline"))


@query("e03_entity_waveform", f"""WITH {SAMPLES_SQL}
SELECT entity, session, condition, time_ms, round(avg(amplitude), 6) AS mean_value, CAST(count(amplitude) AS BIGINT) AS n_obs FROM samples GROUP BY ALL""")
def e03(spark, sf):
    w = ag.entity_waveforms(samples(spark, sf), ["entity", "session", "condition"])
    return w.select("entity", "session", "condition", "time_ms", r6("mean_value", "mean_value"), "n_obs")


WAVE_SQL = f"""{SAMPLES_SQL},
w AS (SELECT entity, session, condition, time_ms, avg(amplitude) AS v FROM samples GROUP BY ALL),
b AS (SELECT entity, session, condition, avg(v) AS base FROM w WHERE time_ms < 0 GROUP BY ALL),
wave AS (SELECT w.entity, w.session, w.condition, w.time_ms, v - base AS v FROM w JOIN b USING (entity, session, condition))"""


def waves(spark, sf):
    w = ag.entity_waveforms(samples(spark, sf), ["entity", "session", "condition"]).drop("n_obs")
    return ag.baseline_correct(w, ["entity", "session", "condition"], "mean_value").filter("mean_value is not null")


@query("e04_group_waveform", f"""WITH {WAVE_SQL}
SELECT session, condition, time_ms, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
 round(stddev_samp(v) / sqrt(count(v)), 6) AS se, CAST(count(v) AS BIGINT) AS n FROM wave GROUP BY ALL""")
def e04(spark, sf):
    g = ag.group_summary(waves(spark, sf), ["session", "condition", "time_ms"], "mean_value")
    return g.select("session", "condition", "time_ms", r6("mean", "mean"), r6("sd", "sd"), r6("se", "se"), "n")


@query("e05_pooled_sessions", f"""WITH {WAVE_SQL},
p AS (SELECT entity, condition, time_ms, CAST(session AS VARCHAR) AS session, v FROM wave
  UNION ALL SELECT entity, condition, time_ms, 'pooled', avg(v) FROM wave GROUP BY ALL)
SELECT session, condition, time_ms, round(avg(v), 6) AS mean, CAST(count(v) AS BIGINT) AS n FROM p GROUP BY ALL""")
def e05(spark, sf):
    p = ag.add_pooled_session(waves(spark, sf), ["entity", "condition", "time_ms"], "mean_value")
    return p.groupBy("session", "condition", "time_ms").agg(r6(F.avg("mean_value"), "mean"), F.count("mean_value").alias("n"))


@query("e06_window_differences", f"""WITH {SAMPLES_SQL}, {WINDOWS_SQL},
m AS (SELECT entity, session, sensor, window_name, condition, avg(amplitude) AS v FROM samples JOIN windows ON time_ms BETWEEN min_ms AND max_ms GROUP BY ALL),
dd AS (SELECT a.entity, a.session, a.sensor, a.window_name, b.v - a.v AS diff FROM m a JOIN m b USING (entity, session, sensor, window_name)
  WHERE a.condition = 'Grammatical' AND b.condition = 'Ungrammatical')
SELECT session, sensor, window_name, round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS sd,
 round(stddev_samp(diff) / sqrt(count(diff)), 6) AS se, CAST(count(diff) AS BIGINT) AS n FROM dd GROUP BY ALL""")
def e06(spark, sf):
    diff = ag.windowed_differences(samples(spark, sf), windows(spark), ["entity", "session"], "sensor")
    g = ag.group_summary(diff, ["session", "sensor", "window_name"], "difference")
    return g.select("session", "sensor", "window_name", r6("mean", "mean"), r6("sd", "sd"), r6("se", "se"), "n")


@query("e07_balanced_proportion", f"""WITH {CLEAN_SQL}, {TQ},
p AS (SELECT grp, session, property, condition, entity, avg(correct) AS p, count(*) AS k FROM kept GROUP BY ALL),
g AS (SELECT grp, session, property, condition, avg(p) AS mean, stddev_samp(p) AS sd, count(p) AS n, sum(k) AS n_trials FROM p GROUP BY ALL)
SELECT grp, session, property, condition, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, CAST(n AS BIGINT) AS n,
 CAST(n_trials AS BIGINT) AS n_trials, round(CASE WHEN t IS NOT NULL THEN greatest(0, mean - t * sd / sqrt(n)) END, 6) AS ci_low,
 round(CASE WHEN t IS NOT NULL THEN least(1, mean + t * sd / sqrt(n)) END, 6) AS ci_high FROM g LEFT JOIN tq ON dof = n - 1""")
def e07(spark, sf):
    g = ag.balanced_proportion(kept(spark, sf), ["grp", "session", "property", "condition"])
    return g.select("grp", "session", "property", "condition", r6("mean", "mean"), r6("sd", "sd"), r6("se", "se"), "n", "n_trials",
                    r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("e08_signal_detection", f"""WITH {CLEAN_SQL}, {TQ},
c AS (SELECT grp, session, property, entity, count(*) FILTER (condition = 'Grammatical') AS ng, count(*) FILTER (condition = 'Ungrammatical') AS nu,
  coalesce(sum(correct) FILTER (condition = 'Grammatical'), 0) AS h, coalesce(sum(1 - correct) FILTER (condition = 'Ungrammatical'), 0) AS f FROM kept GROUP BY ALL),
pp AS (SELECT *, (h + 0.5) / (ng + 1.0::DOUBLE) AS ph, (f + 0.5) / (nu + 1.0::DOUBLE) AS pf FROM c WHERE ng > 0 AND nu > 0),
z AS (SELECT *, {norm_quantile_sql('ph')} AS zh, {norm_quantile_sql('pf')} AS zf FROM pp),
l AS (SELECT grp, session, property, 'd_prime' AS measure, zh - zf AS v FROM z UNION ALL SELECT grp, session, property, 'criterion', -(zh + zf) / 2 FROM z),
g AS (SELECT grp, session, property, measure, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n FROM l GROUP BY ALL)
SELECT grp, session, property, measure, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, CAST(n AS BIGINT) AS n,
 round(mean - t * sd / sqrt(n), 6) AS ci_low, round(mean + t * sd / sqrt(n), 6) AS ci_high FROM g LEFT JOIN tq ON dof = n - 1""")
def e08(spark, sf):
    per = ag.signal_detection(kept(spark, sf), ["grp", "session", "property"])
    long = ag.long_measures(per, ["grp", "session", "property"], ["d_prime", "criterion"])
    g = ag.t_interval(ag.group_summary(long, ["grp", "session", "property", "measure"], "value"), "mean", "se", "n")
    return g.select("grp", "session", "property", "measure", r6("mean", "mean"), r6("sd", "sd"), r6("se", "se"), "n",
                    r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("e09_rt_bands", f"""WITH {CLEAN_SQL}
SELECT property, grp, session, condition, CASE WHEN rt IS NULL OR rt <= 0 THEN 'no_time' WHEN rt <= 200 THEN 'fast' WHEN rt >= 4000 THEN 'slow' ELSE 'kept' END AS band,
 CAST(count(*) AS BIGINT) AS n_trials, CAST(sum(correct) AS BIGINT) AS n_correct FROM dedup GROUP BY ALL""")
def e09(spark, sf):
    t = dedup(spark, sf).withColumn("band", rt_band(F.col("rt")))
    return t.groupBy("property", "grp", "session", "condition", "band").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("correct").alias("n_correct"))


@query("e10_filter_census", f"""WITH {CLEAN_SQL}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM valid) AS n_valid, CAST(count(*) AS BIGINT) AS n_unique,
 (SELECT CAST(count(*) AS BIGINT) FROM valid) - CAST(count(*) AS BIGINT) AS n_duplicates, CAST(count(*) FILTER (rt > 200 AND rt < 4000) AS BIGINT) AS n_kept,
 round(100.0 * (count(*) - count(*) FILTER (rt > 200 AND rt < 4000)) / count(*), 6) AS pct_excluded,
 round(max(rt) FILTER (rt > 200 AND rt < 4000), 6) AS max_kept FROM dedup""")
def e10(spark, sf):
    ok = (F.col("rt") > 200) & (F.col("rt") < 4000)
    # one pass: per trial key the row count and the first row's response time, then one aggregate
    per = valid_trials(trials(spark, sf)).groupBy("entity", "session", "property", "k").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("rt", F.struct("ts", "event_id")).alias("rt"))
    a = per.agg(F.sum("_n").alias("n_valid"), F.count(F.lit(1)).alias("n_unique"), F.count_if(ok).alias("n_kept"),
                F.round(F.max(F.when(ok, F.col("rt"))), 6).alias("max_kept"))
    return a.select("n_valid", "n_unique", (F.col("n_valid") - F.col("n_unique")).alias("n_duplicates"), "n_kept",
                    r6(100.0 * (F.col("n_unique") - F.col("n_kept")) / F.col("n_unique"), "pct_excluded"), "max_kept")


@query("e11_sentence_inventory", f"""WITH {CLEAN_SQL}
SELECT session, CAST(count(*) AS BIGINT) AS n_trials, CAST(count(DISTINCT entity) AS BIGINT) AS n_entities,
 CAST(count(DISTINCT property || '|' || CAST(k AS VARCHAR)) AS BIGINT) AS n_distinct_items FROM kept GROUP BY session""")
def e11(spark, sf):
    t = kept(spark, sf).withColumn("item", d.composite_key("property", "k"))
    return t.groupBy("session").agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("entity").alias("n_entities"),
                                    F.countDistinct("item").alias("n_distinct_items"))


@query("e12_item_inventory", f"""WITH {CLEAN_SQL},
i AS (SELECT property, k, count(DISTINCT entity) AS ne, count(*) AS nt, count(DISTINCT condition) = 2 AS both_c FROM kept GROUP BY ALL)
SELECT property, CAST(count(*) AS BIGINT) AS n_items, round(avg(CASE WHEN both_c THEN 1 ELSE 0 END), 6) AS share_both,
 CAST(min(ne) AS BIGINT) AS entities_min, median(ne) AS entities_median, CAST(max(ne) AS BIGINT) AS entities_max, CAST(min(nt) AS BIGINT) AS trials_min,
 median(nt) AS trials_median, CAST(max(nt) AS BIGINT) AS trials_max FROM i GROUP BY property""")
def e12(spark, sf):
    i = kept(spark, sf).groupBy("property", "k").agg(
        F.countDistinct("entity").alias("ne"), F.count(F.lit(1)).alias("nt"), (F.countDistinct("condition") == 2).alias("both_c"))
    g = i.groupBy("property").agg(
        F.count(F.lit(1)).alias("n_items"), r6(F.avg(F.col("both_c").cast("int")), "share_both"),
        F.min("ne").alias("entities_min"), F.max("ne").alias("entities_max"), F.min("nt").alias("trials_min"), F.max("nt").alias("trials_max"))
    for c, n in (("ne", "entities_median"), ("nt", "trials_median")):
        g = g.join(exact_quantiles(i, ["property"], c, {n: 0.5}), "property")
    return g


@query("e13_logged_language_check", """
WITH g AS (SELECT conv_id, coalesce(string_agg(DISTINCT role, '|' ORDER BY role) FILTER (role <> 'system'), '') AS logged FROM conversations GROUP BY conv_id)
SELECT conv_id, logged, CASE WHEN logged = '' THEN 'not_logged' WHEN logged = 'assistant|user' THEN 'match' ELSE 'mismatch' END AS status FROM g""")
def e13(spark, sf):
    role = F.when(F.col("role") != "system", F.col("role"))
    # distinct values per key stay few: the set is of labels, not of rows
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set(role)), "|").alias("logged"))
    status = F.when(F.col("logged") == "", "not_logged").when(F.col("logged") == "assistant|user", "match").otherwise("mismatch")
    return g.withColumn("status", status)


@query("e14_input_gaps", """
WITH m AS (SELECT DISTINCT page_id AS id FROM pages)
SELECT d.source, CASE WHEN d.n_chars > 20000 THEN 'split export' WHEN contains(d.text, ';') THEN 'semicolon file' ELSE 'unread extra' END AS reason,
 CAST(count(*) AS BIGINT) AS n FROM documents d ANTI JOIN m ON d.doc_id = m.id GROUP BY ALL""")
def e14(spark, sf):
    doc = table(spark, sf, "documents")
    listed = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    reason = F.when(F.col("n_chars") > 20000, "split export").when(F.col("text").contains(";"), "semicolon file").otherwise("unread extra")
    return doc.join(listed, "doc_id", "left_anti").groupBy("source", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_GATE_SQL = f"""{TRIALS_SQL},
f AS (SELECT entity, session, CAST(ts AS DATE) AS file, ts, event_id, CASE event_type WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' END AS o,
  event_type = 'click' AS has_test FROM trials),
r AS (SELECT *, lag(o) OVER (PARTITION BY entity, session, file ORDER BY ts, event_id) AS prev FROM f WHERE o IS NOT NULL),
s AS (SELECT entity, session, file, string_agg(o, '->' ORDER BY ts, event_id) AS seq FROM r WHERE prev IS NULL OR prev <> o GROUP BY ALL),
c AS (SELECT entity, session, bool_or(contains(seq, 'no->yes') OR seq LIKE '%->yes') AS second, bool_or(seq = 'yes') AS first, bool_or(seq = 'no') AS failed FROM s GROUP BY ALL),
t AS (SELECT entity, session, bool_or(has_test) AS any_test FROM f GROUP BY ALL),
u AS (SELECT t.entity, t.session, CASE WHEN second THEN 'passed_attempt2' WHEN first THEN 'passed_attempt1' WHEN failed THEN 'failed_gate'
  WHEN second IS NOT NULL OR any_test THEN 'completed_test_no_gate' ELSE 'no_data' END AS outcome FROM t LEFT JOIN c USING (entity, session))"""


@query("e15_gate_flow", f"""WITH {_GATE_SQL}
SELECT session, CAST(count(*) FILTER (outcome IN ('passed_attempt1', 'passed_attempt2', 'failed_gate')) AS BIGINT) AS n_attempted,
 CAST(count(*) FILTER (outcome = 'passed_attempt1') AS BIGINT) AS n_passed_attempt1, CAST(count(*) FILTER (outcome = 'passed_attempt2') AS BIGINT) AS n_passed_attempt2,
 CAST(count(*) FILTER (outcome = 'failed_gate') AS BIGINT) AS n_failed_gate, CAST(count(*) FILTER (outcome = 'completed_test_no_gate') AS BIGINT) AS n_no_gate FROM u GROUP BY session""")
def e15(spark, sf):
    et = F.col("event_type")
    f = trials(spark, sf).select("entity", "session", F.to_date("ts").alias("file"), "ts", "event_id",
                                 F.when(et == "purchase", "yes").when(et == "error", "no").alias("outcome"), (et == "click").alias("has_test"))
    u = ag.gate_outcomes(f, ["entity", "session"], "file", ["ts", "event_id"])
    n = lambda *v: F.count_if(F.col("outcome").isin(*v))
    return u.groupBy("session").agg(
        n("passed_attempt1", "passed_attempt2", "failed_gate").alias("n_attempted"), n("passed_attempt1").alias("n_passed_attempt1"),
        n("passed_attempt2").alias("n_passed_attempt2"), n("failed_gate").alias("n_failed_gate"), n("completed_test_no_gate").alias("n_no_gate"))


@query("e16_stage_flow", """
WITH m AS (SELECT 'enrolled' AS stage, c_custkey AS id FROM customer UNION ALL SELECT DISTINCT 'ordered', o_custkey FROM orders
 UNION ALL SELECT DISTINCT 'finished', o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT 'logged', user_id FROM events)
SELECT stage, CAST(count(*) FILTER (id % 2 = 1) AS BIGINT) AS n_english, CAST(count(*) FILTER (id % 2 = 0) AS BIGINT) AS n_norwegian, CAST(count(*) AS BIGINT) AS n_total FROM m GROUP BY stage""")
def e16(spark, sf):
    o = table(spark, sf, "orders")
    ids = lambda df, c, s: df.select(F.col(c).alias("id")).distinct().withColumn("stage", F.lit(s))
    m = (ids(table(spark, sf, "customer"), "c_custkey", "enrolled").unionByName(ids(o, "o_custkey", "ordered"))
         .unionByName(ids(o.filter("o_orderstatus = 'F'"), "o_custkey", "finished")).unionByName(ids(table(spark, sf, "events"), "user_id", "logged")))
    g = m.withColumn("grp", d.group_from_parity(F.col("id"))).groupBy("stage").pivot("grp", [d.GROUP_ODD, d.GROUP_EVEN])
    w = g.agg(F.count(F.lit(1)))
    a, b = F.coalesce(F.col(d.GROUP_ODD), F.lit(0)), F.coalesce(F.col(d.GROUP_EVEN), F.lit(0))
    return w.select("stage", a.alias("n_english"), b.alias("n_norwegian"), (a + b).alias("n_total"))


@query("e17_metric_table", """
WITH a AS (SELECT avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_acctbal) AS n FROM customer)
SELECT metric, round(v, 6) AS value FROM (SELECT unnest(['mean', 'sd', 'min', 'max', 'n']) AS metric, unnest([mean, sd, lo, hi, n::DOUBLE]) AS v FROM a)
UNION ALL SELECT 'n_' || lower(c_mktsegment), CAST(count(*) AS DOUBLE) FROM customer GROUP BY c_mktsegment""")
def e17(spark, sf):
    c = table(spark, sf, "customer")
    x = "c_acctbal"
    one = c.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).cast("double").alias("n"))
    long = one.unpivot([], ["mean", "sd", "min", "max", "n"], "metric", "value").withColumn("value", F.round("value", 6))
    cats = c.groupBy(F.concat(F.lit("n_"), F.lower("c_mktsegment")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return long.unionByName(cats)


@query("e18_frequency_table", """
SELECT p_type AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_type ORDER BY n DESC, value""")
def e18(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("value"))
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return li.join(p, "l_partkey").select("l_suppkey", "value").distinct().groupBy("value").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


# ten word slots per order: presence, onset and duration follow from the order's keys
_SLOT_SQL = """
s AS (SELECT o_orderkey, o_orderstatus AS session, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 4 END AS tp, i,
  CASE WHEN i <= 3 + o_custkey % 8 THEN 'w' || CAST(i AS VARCHAR) ELSE ' ' END AS word,
  CASE WHEN (o_orderkey + i) % 53 <> 0 THEN i * 745 + (o_orderkey * i) % 97 ELSE NULL END AS onset,
  CASE WHEN (o_orderkey + i) % 29 <> 0 THEN 500 END AS dur FROM orders, (SELECT unnest(range(1, 11)) AS i)),
n AS (SELECT o_orderkey, coalesce(min(i) FILTER (trim(word) = '') - 1, 10) AS nw FROM s GROUP BY o_orderkey),
j AS (SELECT s.*, nw, max(CASE WHEN i = tp THEN onset END) OVER (PARTITION BY s.o_orderkey) AS o0 FROM s JOIN n USING (o_orderkey)),
q AS (SELECT o_orderkey, session, any_value(tp) AS tp, any_value(nw) AS nw, count(*) FILTER (i <= nw AND onset IS NULL) AS miss,
  max(CASE WHEN i = tp THEN dur END) AS d0, max(CASE WHEN i = tp + 1 AND i <= nw THEN onset - o0 END) AS f1, max(CASE WHEN i = tp + 2 AND i <= nw THEN onset - o0 END) AS f2,
  count(*) FILTER (i > tp AND i <= nw AND onset - o0 > 0 AND onset - o0 <= 900) AS n900 FROM j GROUP BY ALL),
u AS (SELECT *, CASE WHEN miss > 0 THEN 'missing_onset' WHEN tp >= nw THEN 'no_following_word' WHEN d0 IS NULL THEN 'missing_duration'
  WHEN f1 <= 0 OR f1 > 800 THEN 'soa_out_of_range' END AS excluded FROM q)"""


@query("e19_onset_census", f"""WITH {_SLOT_SQL}
SELECT session, CAST(count(*) FILTER (excluded IS NULL) AS BIGINT) AS n_trials, CAST(min(f1) FILTER (excluded IS NULL) AS BIGINT) AS next_onset_min,
 median(f1) FILTER (excluded IS NULL) AS next_onset_median, CAST(max(f1) FILTER (excluded IS NULL) AS BIGINT) AS next_onset_max,
 CAST(max(n900) FILTER (excluded IS NULL) AS INT) AS max_within, CAST(count(*) FILTER (excluded IS NULL AND n900 = 1) AS BIGINT) AS n_exactly_one,
 CAST(min(f2) FILTER (excluded IS NULL) AS BIGINT) AS second_onset_min, CAST(count(*) FILTER (excluded = 'missing_onset') AS BIGINT) AS missing_onset,
 CAST(count(*) FILTER (excluded = 'no_following_word') AS BIGINT) AS no_following_word, CAST(count(*) FILTER (excluded = 'missing_duration') AS BIGINT) AS missing_duration,
 CAST(count(*) FILTER (excluded = 'soa_out_of_range') AS BIGINT) AS soa_out_of_range FROM u GROUP BY session""")
def e19(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    slots = lambda value: F.array(*[value(i) for i in range(1, 11)])
    o = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("session"), F.when(k % 2 == 0, 3).otherwise(4).alias("tp"),
        slots(lambda i: F.when(i <= 3 + c % 8, f"w{i}").otherwise(" ")).alias("words"),
        slots(lambda i: F.when((k + i) % 53 != 0, i * 745 + (k * i) % 97)).alias("onsets"),
        slots(lambda i: F.when((k + i) % 29 != 0, 500)).alias("durations"))
    u = ag.following_onsets(o, "words", "onsets", "durations", "tp", 800, 900)
    reasons = ("missing_onset", "no_following_word", "missing_duration", "soa_out_of_range")
    # trials are read once: counts per distinct onset, then sums and quantiles of those
    each = pin(u.groupBy("session", "first_onset").agg(
        F.count_if(F.col("excluded").isNull()).alias("n_trials"), F.max("n_within").alias("max_within"), F.count_if(F.col("n_within") == 1).alias("n_exactly_one"),
        F.min("second_onset").alias("second_onset_min"), *[F.count_if(F.col("excluded") == r).alias(r) for r in reasons]))
    g = each.groupBy("session").agg(
        F.sum("n_trials").alias("n_trials"), F.min("first_onset").alias("next_onset_min"), F.max("first_onset").alias("next_onset_max"),
        F.max("max_within").alias("max_within"), F.sum("n_exactly_one").alias("n_exactly_one"), F.min("second_onset_min").alias("second_onset_min"),
        *[F.sum(r).alias(r) for r in reasons])
    return g.join(exact_quantiles(each, ["session"], "first_onset", {"next_onset_median": 0.5}, copies="n_trials"), "session")


CELLS_SQL = f"""{CLEAN_SQL},
cells AS (SELECT entity, grp, session, property, condition, count(*) AS n_trials FROM kept GROUP BY ALL)"""


def cells(spark, sf):
    return kept(spark, sf).groupBy("entity", "grp", "session", "property", "condition").agg(F.count(F.lit(1)).alias("n_trials"))


PRESENTED = 48


@query("e20_retention", f"""WITH {CELLS_SQL}
SELECT 'per_condition' AS scope, property, session, grp, condition, round(avg(n_trials), 3) AS mean_retained, round(stddev_samp(n_trials), 3) AS sd_retained,
 CAST(count(*) AS BIGINT) AS n_cells, round(100 * (48 - avg(n_trials)) / 48, 3) AS pct_discarded FROM cells GROUP BY ALL
UNION ALL SELECT 'canonical', 'ALL', NULL, 'ALL', 'ALL', round(avg(n_trials), 3), round(stddev_samp(n_trials), 3), CAST(count(*) AS BIGINT), round(100 * (48 - avg(n_trials)) / 48, 3) FROM cells""")
def e20(spark, sf):
    c = cells(spark, sf)
    m = F.avg("n_trials")
    aggs = [F.round(m, 3).alias("mean_retained"), F.round(F.stddev_samp("n_trials"), 3).alias("sd_retained"), F.count(F.lit(1)).alias("n_cells"),
            F.round(100 * (PRESENTED - m) / PRESENTED, 3).alias("pct_discarded")]
    per = c.groupBy("property", "session", "grp", "condition").agg(*aggs).withColumn("scope", F.lit("per_condition"))
    total = c.agg(*aggs).withColumns({"scope": F.lit("canonical"), "property": F.lit("ALL"), "session": F.lit(None).cast("int"), "grp": F.lit("ALL"), "condition": F.lit("ALL")})
    return per.unionByName(total)


@query("e21_flagged_share", f"""WITH {CELLS_SQL}
SELECT property, session, CAST(count(DISTINCT CASE WHEN c_acctbal < 0 THEN entity END) AS BIGINT) AS n_flagged, CAST(count(DISTINCT entity) AS BIGINT) AS n_all,
 CAST(coalesce(sum(CASE WHEN c_acctbal < 0 THEN n_trials END), 0) AS BIGINT) AS trials_flagged, CAST(sum(n_trials) AS BIGINT) AS trials_all,
 round(100.0 * coalesce(sum(CASE WHEN c_acctbal < 0 THEN n_trials END), 0) / sum(n_trials), 3) AS share_pct FROM cells LEFT JOIN customer ON entity = c_custkey GROUP BY ALL""")
def e21(spark, sf):
    flags = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") < 0).alias("flag"))
    c = cells(spark, sf).join(flags, "entity", "left")
    hit = F.coalesce(F.sum(F.when(F.col("flag"), F.col("n_trials"))), F.lit(0))
    return c.groupBy("property", "session").agg(
        F.countDistinct(F.when(F.col("flag"), F.col("entity"))).alias("n_flagged"), F.countDistinct("entity").alias("n_all"),
        hit.alias("trials_flagged"), F.sum("n_trials").alias("trials_all"), F.round(100.0 * hit / F.sum("n_trials"), 3).alias("share_pct"))


@query("e22_grouping_sets", f"""WITH {CELLS_SQL}
SELECT coalesce(grp, 'both') AS grp, coalesce(CAST(session AS VARCHAR), 'all') AS session, coalesce(condition, 'both') AS condition,
 CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(n_trials) AS BIGINT) AS n_trials, round(avg(n_trials), 6) AS cell_mean, round(stddev_samp(n_trials), 6) AS cell_sd,
 CAST(min(n_trials) AS BIGINT) AS cell_min FROM cells GROUP BY GROUPING SETS ((grp, session, condition), (grp, session), (grp, condition), (session, condition))""")
def e22(spark, sf):
    g, s, c = F.col("grp"), F.col("session"), F.col("condition")
    out = cells(spark, sf).groupingSets([[g, s, c], [g, s], [g, c], [s, c]], g, s, c).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_trials").alias("n_trials"), r6(F.avg("n_trials"), "cell_mean"),
        r6(F.stddev_samp("n_trials"), "cell_sd"), F.min("n_trials").alias("cell_min"))
    return out.select(F.coalesce("grp", F.lit("both")).alias("grp"), F.coalesce(F.col("session").cast("string"), F.lit("all")).alias("session"),
                      F.coalesce("condition", F.lit("both")).alias("condition"), "n_cells", "n_trials", "cell_mean", "cell_sd", "cell_min")


_WIDE_SQL = f"""{CELLS_SQL},
wide AS (SELECT entity, grp, session, property, coalesce(sum(n_trials) FILTER (condition = 'Grammatical'), 0) AS n1, coalesce(sum(n_trials) FILTER (condition = 'Ungrammatical'), 0) AS n2 FROM cells GROUP BY ALL)"""


def wide_cells(spark, sf):
    w = cells(spark, sf).groupBy("entity", "grp", "session", "property").pivot("condition", [d.CONTROL, d.VIOLATION]).agg(F.sum("n_trials"))
    return w.select("entity", "grp", "session", "property", F.coalesce(F.col(d.CONTROL), F.lit(0)).alias("n1"), F.coalesce(F.col(d.VIOLATION), F.lit(0)).alias("n2"))


@query("e23_precision_factor", f"""WITH {_WIDE_SQL},
f AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2) END AS f FROM wide)
SELECT grp, session, property, CAST(count(*) AS BIGINT) AS n_entities, CAST(count(*) FILTER (f IS NULL) AS BIGINT) AS zero_cells, round(avg(f), 6) AS f_mean,
 round(max(f), 6) AS f_max, round(sqrt(avg(f * f) / count(f)), 6) AS se_group FROM f GROUP BY ALL""")
def e23(spark, sf):
    f = wide_cells(spark, sf).withColumn("f", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.sqrt(F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))))
    return f.groupBy("grp", "session", "property").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("f").isNull()).alias("zero_cells"), r6(F.avg("f"), "f_mean"), r6(F.max("f"), "f_max"),
        F.round(F.sqrt(F.try_divide(F.avg(F.col("f") * F.col("f")), F.count("f"))), 6).alias("se_group"))


@query("e24_funnel", f"""WITH {CLEAN_SQL},
a AS (SELECT session, grp, count(*) AS presented FROM trials GROUP BY ALL), b AS (SELECT session, grp, count(*) AS labelled FROM valid GROUP BY ALL),
c AS (SELECT session, grp, count(*) AS uniq FROM dedup GROUP BY ALL), e AS (SELECT session, grp, count(*) AS kept FROM kept GROUP BY ALL)
SELECT session, grp, CAST(presented AS BIGINT) AS presented, CAST(labelled AS BIGINT) AS labelled, CAST(uniq AS BIGINT) AS uniq, CAST(kept AS BIGINT) AS kept,
 round(100.0 * labelled / presented, 6) AS pct_labelled, round(100.0 * kept / presented, 6) AS pct_kept FROM a LEFT JOIN b USING (session, grp) LEFT JOIN c USING (session, grp) LEFT JOIN e USING (session, grp)""")
def e24(spark, sf):
    t = trials(spark, sf)
    n = lambda df, name: df.groupBy("session", "grp").agg(F.count(F.lit(1)).alias(name))
    # the later stages are nested, so one de-duplicated frame answers both of them
    ok = (F.col("rt") > 200) & (F.col("rt") < 4000)
    late = dedup(spark, sf).groupBy("session", "grp").agg(F.count(F.lit(1)).alias("uniq"), F.count_if(ok).alias("kept"))
    out = n(t, "presented").join(n(valid_trials(t), "labelled"), ["session", "grp"], "left").join(late, ["session", "grp"], "left")
    return out.select("session", "grp", "presented", "labelled", "uniq", "kept", r6(100.0 * F.col("labelled") / F.col("presented"), "pct_labelled"),
                      r6(100.0 * F.col("kept") / F.col("presented"), "pct_kept"))


@query("e25_presented_cells", f"""WITH {TRIALS_SQL},
x AS (SELECT DISTINCT property, condition, session, entity, k, event_type FROM trials WHERE condition IS NOT NULL)
SELECT property, condition, CAST((SELECT count(*) FROM trials t WHERE t.property = x.property AND t.condition = x.condition) AS BIGINT) AS n_raw,
 CAST(count(*) AS BIGINT) AS n_distinct, CAST(count(*) FILTER (event_type = 'error' AND k % 2 = 0) AS BIGINT) AS n_disagree FROM x GROUP BY property, condition""")
def e25(spark, sf):
    t = trials(spark, sf).filter("condition is not null")
    # distinct rows with their multiplicity: raw and de-duplicated counts come from one shuffle
    x = t.groupBy("property", "condition", "session", "entity", "k", "event_type").agg(F.count(F.lit(1)).alias("_n"))
    return x.groupBy("property", "condition").agg(
        F.sum("_n").alias("n_raw"), F.count(F.lit(1)).alias("n_distinct"),
        F.count_if((F.col("event_type") == "error") & (F.col("k") % 2 == 0)).alias("n_disagree"))
