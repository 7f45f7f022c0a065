"""Section E, second half: audit counts, durations, records and long tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import aggregate as ag
from trialweave.operators import joins as jn
from trialweave.operators.skew import exact_quantiles, with_group_stats
from trialweave.plans.d_joins import ASOF_SQL, HOUR, PAIRS_SQL, asof_events, pair_rows
from trialweave.plans.e1_aggregations import CELLS_SQL, CLEAN_SQL, cells, kept, wide_cells, _WIDE_SQL
from trialweave.plans.standins import SAMPLES_SQL, TRIALS_SQL, markers, r6, samples, trials
from trialweave.registry import query, table


def _n(cond=None):
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


@query("e26_cell_table", """
WITH x AS (SELECT o_custkey AS entity, o_orderpriority AS cell, count(*) AS exported, count(*) FILTER (o_orderstatus <> 'P') AS importable FROM orders GROUP BY ALL),
p AS (SELECT user_id AS entity, count(*) AS presented FROM events GROUP BY 1)
SELECT x.entity, cell, CAST(exported AS BIGINT) AS exported, CAST(importable AS BIGINT) AS importable, CAST(coalesce(presented, 48) AS BIGINT) AS presented,
 presented IS NOT NULL AS presented_from_log, coalesce(c_acctbal < 0, FALSE) AS excluded FROM x LEFT JOIN p USING (entity) LEFT JOIN customer ON x.entity = c_custkey""")
def e26(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("cell")).agg(
        _n().alias("exported"), _n(F.col("o_orderstatus") != "P").alias("importable"))
    p = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(_n().alias("_p"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") < 0).alias("_x"))
    out = x.join(p, "entity", "left").join(c, "entity", "left")
    return out.select("entity", "cell", "exported", "importable", F.coalesce("_p", F.lit(48)).alias("presented"),
                      F.col("_p").isNotNull().alias("presented_from_log"), F.coalesce("_x", F.lit(False)).alias("excluded"))


# parent = the property marker; kept unless a word marker was seen; exported when a sentence was seen
_FATE_SQL = f"""{ASOF_SQL},
fate AS (SELECT recording, seq, code, (pos - prop_marker_pos) // {6 * HOUR}::BIGINT AS lag, CASE WHEN prop_marker IS NULL THEN 'no parent segment'
  WHEN word IS NOT NULL THEN 'parent removed by hand' WHEN sentence IS NULL THEN 'kept parent, no child'
  WHEN sentence % 2 = 0 THEN 'in table but not in file' ELSE 'exported' END AS fate FROM asof_events WHERE code IN (101, 102, 103))"""


def fates(spark, sf):
    e = asof_events(spark, sf)
    lag = F.floor((F.col("pos") - F.col("prop_marker_pos")) / (6 * HOUR))
    fate = (F.when(F.col("prop_marker").isNull(), "no parent segment").when(F.col("word").isNotNull(), "parent removed by hand")
            .when(F.col("sentence").isNull(), "kept parent, no child").when(F.col("sentence") % 2 == 0, "in table but not in file").otherwise("exported"))
    return e.select("recording", "seq", "code", F.when(F.col("prop_marker").isNotNull(), lag).alias("lag"), fate.alias("fate"))


@query("e27_fate_crosstab", f"""WITH {_FATE_SQL}
SELECT lag, CAST(count(*) FILTER (fate = 'exported') AS BIGINT) AS exported, CAST(count(*) FILTER (fate = 'no parent segment') AS BIGINT) AS no_parent,
 CAST(count(*) FILTER (fate = 'parent removed by hand') AS BIGINT) AS removed, CAST(count(*) FILTER (fate = 'kept parent, no child') AS BIGINT) AS no_child,
 CAST(count(*) FILTER (fate = 'in table but not in file') AS BIGINT) AS not_in_file FROM (SELECT CASE WHEN fate <> 'no parent segment' THEN lag END AS lag, fate FROM fate) GROUP BY lag""")
def e27(spark, sf):
    names = {"exported": "exported", "no parent segment": "no_parent", "parent removed by hand": "removed", "kept parent, no child": "no_child",
             "in table but not in file": "not_in_file"}
    w = fates(spark, sf).groupBy("lag").pivot("fate", list(names)).agg(F.count(F.lit(1)))
    return w.select("lag", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in names.items()])


@query("e28_loss_accounting", f"""WITH {ASOF_SQL},
bad AS (SELECT recording, pos AS start, pos + {12 * HOUR}::BIGINT AS stop FROM markers WHERE code IN (7, 8)),
e AS (SELECT recording, seq, prop_marker, word, sentence, pos - prop_marker_pos AS lag, EXISTS (SELECT 1 FROM bad b WHERE b.recording = a.recording AND b.start < a.pos + {HOUR} AND a.pos - {HOUR} < b.stop) AS in_bad
 FROM asof_events a WHERE code IN (101, 102, 103)),
c AS (SELECT recording, CASE WHEN sentence % 2 = 1 AND prop_marker IS NOT NULL THEN 'exported' WHEN prop_marker IS NULL AND in_bad THEN 'lost_bad' WHEN prop_marker IS NULL THEN 'lost_before'
  WHEN word IS NOT NULL THEN 'lost_manual' WHEN lag > {24 * HOUR}::BIGINT THEN 'lag_lost' ELSE 'unexplained' END AS kind FROM e)
SELECT recording, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (kind = 'exported') AS BIGINT) AS exported, CAST(count(*) FILTER (kind = 'lost_bad') AS BIGINT) AS lost_bad,
 CAST(count(*) FILTER (kind = 'lost_before') AS BIGINT) AS lost_before, CAST(count(*) FILTER (kind = 'lost_manual') AS BIGINT) AS lost_manual,
 CAST(count(*) FILTER (kind = 'lag_lost') AS BIGINT) AS lag_lost, CAST(count(*) FILTER (kind = 'unexplained') AS BIGINT) AS unexplained FROM c GROUP BY recording""")
def e28(spark, sf):
    m = markers(spark, sf)
    ev = asof_events(spark, sf).withColumns({"start": F.col("pos") - HOUR, "stop": F.col("pos") + HOUR})
    bad = m.filter(F.col("code").isin(7, 8)).select("recording", F.col("pos").alias("start"), (F.col("pos") + 12 * HOUR).alias("stop"))
    e = jn.overlap_flag(ev, bad, ["recording"], "seq", "in_bad")
    parent = F.col("prop_marker").isNotNull()
    kind = (F.when(F.coalesce((F.col("sentence") % 2 == 1) & parent, F.lit(False)), "exported").when(~parent & F.col("in_bad"), "lost_bad")
            .when(~parent, "lost_before").when(F.col("word").isNotNull(), "lost_manual")
            .when(F.col("pos") - F.col("prop_marker_pos") > 24 * HOUR, "lag_lost").otherwise("unexplained"))
    kinds = ["exported", "lost_bad", "lost_before", "lost_manual", "lag_lost", "unexplained"]
    return e.withColumn("kind", kind).groupBy("recording").agg(_n().alias("n"), *[_n(F.col("kind") == k).alias(k) for k in kinds])


_RULES = {"actual": (0, 24, -1, 6), "child_short": (0, 24, -1, 5), "child_late": (0, 24, 0, 6), "parent_wide": (-2, 28, -1, 6)}


# rules of a single window: no parent window is needed, only that neither a bad interval nor a new segment touches the one
# around the event, or around its word
_SINGLE = {"single_child": ("pos", -1, 6), "single_word": ("word_pos", -1, 3)}
_NESTED_SQL = {r: f"prop_marker IS NOT NULL AND lag + {c0} * {HOUR}::BIGINT >= {p0} * {HOUR}::BIGINT AND lag + {c0 + cl} * {HOUR}::BIGINT <= {p0 + pl} * {HOUR}::BIGINT" for r, (p0, pl, c0, cl) in _RULES.items()}
_SINGLE_SQL = {r: f"{at} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.recording = e.recording AND b.start < e.{at} + {c0 + cl} * {HOUR}::BIGINT AND e.{at} + {c0} * {HOUR}::BIGINT < b.stop)"
               for r, (at, c0, cl) in _SINGLE.items()}


@query("e29_rule_what_if", f"""WITH {ASOF_SQL},
bad AS (SELECT recording, pos AS start, pos + CASE WHEN code IN (7, 8) THEN {12 * HOUR}::BIGINT ELSE 1 END AS stop FROM markers WHERE code IN (5, 6, 7, 8)),
e AS (SELECT recording, prop_marker, word_pos, pos, pos - prop_marker_pos AS lag FROM asof_events WHERE code IN (101, 102, 103)),
f AS (SELECT lag // {6 * HOUR}::BIGINT AS lag_bin, {', '.join(f'{c} AS {r}' for r, c in {**_NESTED_SQL, **_SINGLE_SQL}.items())} FROM e)
""" + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(lag_bin AS BIGINT) AS lag_bin, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({r}) AS BIGINT) AS kept FROM f GROUP BY ALL" for r in (*_RULES, *_SINGLE)))
def e29(spark, sf):
    m = markers(spark, sf)
    e = asof_events(spark, sf).withColumn("lag", F.col("pos") - F.col("prop_marker_pos"))
    long = F.col("code").isin(7, 8)
    bad = m.filter(F.col("code").isin(5, 6, 7, 8)).select("recording", F.col("pos").alias("start"), (F.col("pos") + F.when(long, 12 * HOUR).otherwise(1)).alias("stop"))
    flags = {r: F.coalesce((F.col("lag") + c0 * HOUR >= p0 * HOUR) & (F.col("lag") + (c0 + cl) * HOUR <= (p0 + pl) * HOUR), F.lit(False)) for r, (p0, pl, c0, cl) in _RULES.items()}
    for rule, (at, c0, cl) in _SINGLE.items():
        windows = e.withColumns({"start": F.col(at) + c0 * HOUR, "stop": F.col(at) + (c0 + cl) * HOUR})
        touched = jn.overlap_flag(windows.where(F.col(at).isNotNull()), bad, ["recording"], "seq", rule).select("recording", "seq", rule)
        e = e.join(touched, ["recording", "seq"], "left")
        flags[rule] = F.coalesce(~F.col(rule), F.lit(False))
    wide = e.select(F.floor(F.col("lag") / (6 * HOUR)).alias("lag_bin"), *[c.alias(r) for r, c in flags.items()])
    return wide.unpivot(["lag_bin"], list(flags), "rule", "keep").groupBy("rule", "lag_bin").agg(_n().alias("n"), _n(F.col("keep")).alias("kept"))


@query("e30_projected_counts", """
WITH c AS (SELECT l_suppkey AS cell, count(*) FILTER (l_linenumber = 5) AS n5, count(*) FILTER (l_linenumber = 6) AS n6, count(*) FILTER (l_linenumber NOT IN (5, 6)) AS n_other,
  count(*) FILTER (l_linenumber = 5 AND l_returnflag <> 'N') AS n_cur FROM lineitem GROUP BY 1),
g AS (SELECT sum(n_cur) / sum(n5) AS share, avg((n5 + n6) / n5) AS up FROM c WHERE n5 > 0 AND n_cur <= n5)
SELECT cell, CAST(n5 AS BIGINT) AS n5, CAST(n6 AS BIGINT) AS n6, CAST(n_other AS BIGINT) AS n_other, CAST(n_cur AS BIGINT) AS n_cur,
 CASE WHEN n5 = 0 THEN round_even(n_cur * up, 0) ELSE n_cur + round_even(n6 * CASE WHEN n_cur <= n5 THEN n_cur / greatest(n5, 1) ELSE share END, 0) END AS projected FROM c, g""")
def e30(spark, sf):
    line = F.col("l_linenumber")
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(
        _n(line == 5).alias("n5"), _n(line == 6).alias("n6"), _n(~line.isin(5, 6)).alias("n_other"),
        _n((line == 5) & (F.col("l_returnflag") != "N")).alias("n_cur"))
    ok = c.filter("n5 > 0 and n_cur <= n5")
    g = ok.agg((F.sum("n_cur") / F.sum("n5")).alias("share"), F.avg((F.col("n5") + F.col("n6")) / F.col("n5")).alias("up"))
    share = F.when(F.col("n_cur") <= F.col("n5"), F.col("n_cur") / F.greatest("n5", F.lit(1))).otherwise(F.col("share"))
    projected = F.when(F.col("n5") == 0, F.bround(F.col("n_cur") * F.col("up"), 0)).otherwise(F.col("n_cur") + F.bround(F.col("n6") * share, 0))
    return c.crossJoin(F.broadcast(g)).select("cell", "n5", "n6", "n_other", "n_cur", projected.alias("projected"))


@query("e31_identity_rollup", """
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'none') AS lang, page_id FROM pages)
SELECT host, CAST(count(*) AS BIGINT) AS n_pages, min(page_id) AS first_page, CAST(count(DISTINCT lang) AS BIGINT) AS n_settings,
 string_agg(DISTINCT lang, '|' ORDER BY lang) AS settings FROM p GROUP BY host HAVING count(*) > 1""")
def e31(spark, sf):
    p = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.coalesce(F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")), F.lit("none")).alias("lang"), "page_id")
    g = p.groupBy("host").agg(_n().alias("n_pages"), F.min("page_id").alias("first_page"), F.countDistinct("lang").alias("n_settings"),
                              F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("settings"))
    return g.filter("n_pages > 1")


@query("e32_quantity_table", """
WITH a AS (SELECT count(*)::DOUBLE AS recorded, count(*) FILTER (event_type = 'purchase')::DOUBLE AS exported, count(DISTINCT user_id)::DOUBLE AS recordings, round(avg(value), 6) AS mean_value FROM events)
SELECT quantity, value, unit, note FROM (SELECT unnest(['recorded', 'exported', 'recordings', 'mean_value']) AS quantity, unnest([recorded, exported, recordings, mean_value]) AS value,
 unnest(['events', 'events', 'recordings', 'value']) AS unit, unnest(['all events', 'condition events', 'distinct recordings', 'mean of value']) AS note FROM a)""")
def e32(spark, sf):
    e = table(spark, sf, "events")
    one = e.agg(_n().alias("recorded"), _n(F.col("event_type") == "purchase").alias("exported"), F.countDistinct("user_id").alias("recordings"),
                r6(F.avg("value"), "mean_value"))
    notes = {"recorded": ("events", "all events"), "exported": ("events", "condition events"), "recordings": ("recordings", "distinct recordings"),
             "mean_value": ("value", "mean of value")}
    out = ag.quantity_table(one, notes)
    return with_group_stats(out, ["quantity"], _n=F.count(F.lit(1))).filter(F.assert_true(F.col("_n") == 1).isNull()).drop("_n")


@query("e33_error_metrics", f"""WITH {PAIRS_SQL},
e AS (SELECT entity, b - a AS err FROM pair_rows)
SELECT entity, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(err * err)), 6) AS rmse, round(quantile_cont(abs(err), 0.9999), 6) AS p9999, round(max(abs(err)), 6) AS max_abs FROM e GROUP BY entity""")
def e33(spark, sf):
    e = pair_rows(spark, sf).select("entity", (F.col("b") - F.col("a")).alias("err")).withColumn("abs_err", F.abs("err"))
    m = ag.error_metrics(e, ["entity"], "err", exact_quantiles(e, ["entity"], "abs_err", {"p9999": 0.9999}))
    return m.select("entity", "n", r6("rmse", "rmse"), r6("p9999", "p9999"), r6("max_abs", "max_abs"))


@query("e34_modal_position", """
WITH p AS (SELECT l_linenumber AS sensor, l_quantity AS x, CAST(round(l_discount * 100) AS DOUBLE) AS y, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT sensor, x, y FROM p QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY n DESC, x, y) = 1)
SELECT m.sensor, m.x, m.y, CAST((SELECT count(*) FROM p q WHERE q.sensor = m.sensor) AS BIGINT) AS n_variants,
 round((SELECT max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FROM p a, p b WHERE a.sensor = m.sensor AND b.sensor = m.sensor), 6) AS spread FROM m""")
def e34(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("sensor"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"))
    mode = ag.modal_value(p, "sensor", ["x", "y"])
    return mode.join(ag.planar_spread(p, "sensor", "x", "y"), "sensor").select("sensor", "x", "y", "n_variants", r6("spread", "spread"))


_BIN_SQL = f"""{SAMPLES_SQL},
base AS (SELECT entity, session, condition, marker, sensor, avg(CASE WHEN time_ms < 0 THEN amplitude END) AS b FROM samples GROUP BY ALL),
bins AS (SELECT entity, session, condition, marker, sensor, (time_ms + 100) // 40 AS bin, avg(amplitude - coalesce(b, 0)) AS v FROM samples JOIN base USING (entity, session, condition, marker, sensor) GROUP BY ALL)"""


def binned(spark, sf):
    keys = ["entity", "session", "condition", "marker", "sensor"]
    return ag.binned_waveforms(samples(spark, sf), keys, F.floor((F.col("time_ms") + 100) / 40), "amplitude", "v")


@query("e35_time_bins", f"""WITH {_BIN_SQL} SELECT session, condition, sensor, bin, CAST(count(*) AS BIGINT) AS n_trials, round(avg(v), 6) AS mean_value FROM bins GROUP BY ALL""")
def e35(spark, sf):
    return binned(spark, sf).groupBy("session", "condition", "sensor", "bin").agg(_n().alias("n_trials"), r6(F.avg("v"), "mean_value"))


@query("e36_trial_completeness", f"""WITH {_BIN_SQL} SELECT entity, session, condition, marker, CAST(count(v) AS BIGINT) AS n_observed FROM bins GROUP BY ALL""")
def e36(spark, sf):
    # the count of observed cells needs no baseline: distinct (sensor, bin) pairs with a value
    unit = ["entity", "session", "condition", "marker"]
    c = samples(spark, sf).select(*unit, "sensor", F.floor((F.col("time_ms") + 100) / 40).alias("bin")).distinct()
    return c.groupBy(*unit).agg(_n().alias("n_observed"))


@query("e37_task_duration", """
SELECT user_id, CAST(ts AS DATE) AS day, event_type, CAST(count(DISTINCT event_id) AS BIGINT) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE, 6) AS duration_min
FROM events GROUP BY ALL HAVING count(*) > 1""")
def e37(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", d.micros(F.col("ts")).alias("us")).distinct()
    g = e.groupBy("user_id", "day", "event_type").agg(_n().alias("n_events"), F.min("us").alias("a"), F.max("us").alias("b")).filter("n_events > 1")
    return g.select("user_id", "day", "event_type", "n_events", r6((F.col("b") - F.col("a")) / F.lit(60_000_000.0), "duration_min"))


PHASES = ["signup", "view", "click", "purchase"]
_PHASE_SQL = f"""{TRIALS_SQL},
u AS (SELECT entity, session, event_type AS phase, list_position(['signup', 'view', 'click', 'purchase'], event_type) AS idx, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS l FROM trials WHERE event_type <> 'error' GROUP BY ALL),
v AS (SELECT a.*, (SELECT min(b.s) FROM u b WHERE b.entity = a.entity AND b.session = a.session AND b.idx > a.idx AND b.s > a.s) AS nxt FROM u a),
ph AS (SELECT entity, session, phase, s, coalesce(nxt, CASE WHEN l > s THEN l END) AS e, CASE WHEN nxt IS NOT NULL THEN 'next phase start' ELSE 'last phase event' END AS boundary FROM v)"""


def phases(spark, sf):
    t = trials(spark, sf).select("entity", "session", "event_type", d.micros(F.col("ts")).alias("us"))
    out = ag.phase_durations(t, ["entity", "session"], PHASES, "us", "event_type")
    return out.withColumn("duration_min", (F.col("end") - F.col("start")) / F.lit(60_000_000.0))


@query("e38_phase_duration", f"""WITH {_PHASE_SQL} SELECT entity, session, phase, boundary, round((e - s) / 60000000.0::DOUBLE, 6) AS duration_min FROM ph WHERE e > s""")
def e38(spark, sf):
    return phases(spark, sf).select("entity", "session", "phase", "boundary", r6("duration_min", "duration_min"))


@query("e39_median_duration", f"""WITH {_PHASE_SQL},
m AS (SELECT session, phase, median((e - s) / 60000000.0::DOUBLE) AS med FROM ph WHERE e > s GROUP BY ALL),
x AS (SELECT s AS session, p AS phase FROM (SELECT unnest([2, 3, 4, 6, 7]) AS s), (SELECT unnest(['signup', 'view', 'click', 'purchase']) AS p))
SELECT session, phase, round(med, 6) AS median_min, CASE WHEN m.med IS NULL THEN 'expected, not recorded' ELSE 'recorded' END AS state FROM x FULL JOIN m USING (session, phase)""")
def e39(spark, sf):
    m = exact_quantiles(phases(spark, sf), ["session", "phase"], "duration_min", {"med": 0.5})
    grid = spark.createDataFrame([(s, p) for s in (*d.SESSIONS, 7) for p in PHASES], "session int, phase string")
    j = grid.join(m, ["session", "phase"], "full_outer")
    return j.select("session", "phase", r6("med", "median_min"), F.when(F.col("med").isNull(), "expected, not recorded").otherwise("recorded").alias("state"))


@query("e40_off_scale", f"""WITH {_PHASE_SQL} SELECT session, phase, CAST(count(*) AS BIGINT) AS n FROM ph WHERE (e - s) / 60000000.0::DOUBLE > 3000 GROUP BY ALL""")
def e40(spark, sf):
    return phases(spark, sf).filter("duration_min > 3000").groupBy("session", "phase").agg(_n().alias("n"))


@query("e41_fit_record", f"""WITH {CLEAN_SQL}
SELECT property, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT entity) AS BIGINT) AS n_entities, CAST(count(*) FILTER (coalesce(c_acctbal < 0, FALSE)) AS BIGINT) AS excluded_rows,
 CAST(count(*) FILTER (coalesce(c_mktsegment = 'BUILDING', FALSE)) AS BIGINT) AS reprocessed_rows FROM kept LEFT JOIN customer ON entity = c_custkey GROUP BY property""")
def e41(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") < 0).alias("x"), (F.col("c_mktsegment") == "BUILDING").alias("r"))
    return kept(spark, sf).join(c, "entity", "left").groupBy("property").agg(
        _n().alias("n_rows"), F.countDistinct("entity").alias("n_entities"), _n(F.col("x")).alias("excluded_rows"), _n(F.col("r")).alias("reprocessed_rows"))


@query("e42_stratum_ratio", """
WITH y AS (SELECT o_orderpriority AS stratum, CAST(date_part('year', o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT stratum, CAST(sum(n) AS BIGINT) AS total, min(y) AS first_year, max(y) AS last_year, round(1.0 * arg_max(n, y) / arg_min(n, y), 6) AS ratio FROM y GROUP BY stratum""")
def e42(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stratum"), F.year("o_orderdate").alias("y")).agg(_n().alias("n"))
    return y.groupBy("stratum").agg(F.sum("n").alias("total"), F.min("y").alias("first_year"), F.max("y").alias("last_year"),
                                    r6(F.max_by("n", "y") / F.min_by("n", "y"), "ratio"))


@query("e43_step_spread", f"""WITH {ASOF_SQL},
s AS (SELECT (pos - prop_marker_pos) // {HOUR} AS step FROM asof_events WHERE code IN (101, 102, 103) AND prop_marker IS NOT NULL)
SELECT CAST(step AS BIGINT) AS step_hours, CAST(count(*) AS BIGINT) AS n, round((SELECT avg(step) FROM s), 6) AS mean_step FROM s GROUP BY step""")
def e43(spark, sf):
    s = asof_events(spark, sf).filter("prop_marker is not null").select(F.floor((F.col("pos") - F.col("prop_marker_pos")) / HOUR).alias("step_hours"))
    g = s.groupBy("step_hours").agg(_n().alias("n"))
    mean = g.agg((F.sum(F.col("step_hours") * F.col("n")) / F.sum("n")).alias("m"))
    return g.crossJoin(F.broadcast(mean)).select("step_hours", "n", r6("m", "mean_step"))


@query("e44_presence_matrix", f"""WITH {TRIALS_SQL}
SELECT entity, bool_or(session = 2) AS attended_2, bool_or(session = 3) AS attended_3, bool_or(session = 4) AS attended_4, bool_or(session = 6) AS attended_6,
 bool_or(event_type = 'purchase') AS usable_condition FROM trials GROUP BY entity""")
def e44(spark, sf):
    return trials(spark, sf).groupBy("entity").agg(*[F.bool_or(F.col("session") == s).alias(f"attended_{s}") for s in d.SESSIONS],
                                                   F.bool_or(F.col("event_type") == "purchase").alias("usable_condition"))


@query("e45_binomial_pairs", f"""WITH {_WIDE_SQL},
p AS (SELECT *, n1 - n2 AS diff, (n1 + n2) / 96.0::DOUBLE AS p FROM wide WHERE n1 + n2 > 0)
SELECT session, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff), 6) AS sd_diff, round(sqrt(avg(2 * 48 * p * (1 - p))), 6) AS binomial_sd,
 CAST(count(*) FILTER (diff > 0) AS BIGINT) AS first_larger, CAST(count(*) FILTER (diff = 0) AS BIGINT) AS equal_n, CAST(count(*) FILTER (diff < 0) AS BIGINT) AS second_larger FROM p GROUP BY session""")
def e45(spark, sf):
    p = wide_cells(spark, sf).filter("n1 + n2 > 0").withColumns({"diff": F.col("n1") - F.col("n2"), "p": (F.col("n1") + F.col("n2")) / 96.0})
    x = F.col("diff")
    return p.groupBy("session").agg(
        _n().alias("n_pairs"), r6(F.avg("diff"), "mean_diff"), r6(F.stddev_samp("diff"), "sd_diff"),
        r6(F.sqrt(F.avg(2 * 48 * F.col("p") * (1 - F.col("p")))), "binomial_sd"), _n(x > 0).alias("first_larger"), _n(x == 0).alias("equal_n"), _n(x < 0).alias("second_larger"))


@query("e46_position_shift", f"""WITH {TRIALS_SQL},
per AS (SELECT session, entity, condition, avg(k / 100.0::DOUBLE) AS all_pos, avg(CASE WHEN correct = 1 THEN k / 100.0::DOUBLE END) AS exp_pos FROM trials WHERE condition IS NOT NULL GROUP BY ALL),
w AS (SELECT session, entity, max(exp_pos - all_pos) FILTER (condition = 'Grammatical') AS a, max(exp_pos - all_pos) FILTER (condition = 'Ungrammatical') AS b FROM per GROUP BY ALL)
SELECT CAST(session AS VARCHAR) AS session, condition, round(avg(all_pos), 6) AS pos_recorded, round(avg(exp_pos), 6) AS pos_exported, round(avg(exp_pos - all_pos), 6) AS shift FROM per GROUP BY ALL
UNION ALL SELECT CAST(session AS VARCHAR), 'difference', NULL, NULL, round(avg(a - b), 6) FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY session""")
def e46(spark, sf):
    x = F.col("k") / F.lit(100.0)
    per = trials(spark, sf).filter("condition is not null").groupBy("session", "entity", "condition").agg(
        F.avg(x).alias("a"), F.avg(F.when(F.col("correct") == 1, x)).alias("e")).withColumn("s", F.col("e") - F.col("a"))
    sess = F.col("session").cast("string").alias("session")
    one = per.groupBy(sess, "condition").agg(r6(F.avg("a"), "pos_recorded"), r6(F.avg("e"), "pos_exported"), r6(F.avg("s"), "shift"))
    diff = jn.paired_difference(per, ["session", "entity"], "condition", "s", d.VIOLATION, d.CONTROL)
    null = F.lit(None).cast("double")
    two = diff.groupBy(sess).agg(r6(F.avg("difference"), "shift")).select(
        "session", F.lit("difference").alias("condition"), null.alias("pos_recorded"), null.alias("pos_exported"), "shift")
    return one.unionByName(two)


@query("e47_weighted_share", """
WITH c AS (SELECT l_suppkey, count(*) AS w, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, avg(l_discount) - 0.05 AS est, stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1),
b AS (SELECT *, est - 1.645 * se AS lo, est + 1.645 * se AS hi FROM c)
SELECT round(sum(w * share) / sum(w), 6) AS weighted_share, CAST(count(*) FILTER (lo > -0.003 AND hi < 0.003) AS BIGINT) AS n_pass, CAST(count(*) FILTER (lo > 0 OR hi < 0) AS BIGINT) AS n_excluding_zero,
 CAST(count(*) AS BIGINT) AS n_cells, arg_max(l_suppkey, greatest(abs(lo), abs(hi))) AS furthest_cell FROM b""")
def e47(spark, sf):
    x = F.col("l_discount")
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        _n().alias("w"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("share"), (F.avg(x) - 0.05).alias("est"),
        (F.stddev_samp(x) / F.sqrt(_n())).alias("se"))
    b = c.withColumns({"lo": F.col("est") - 1.645 * F.col("se"), "hi": F.col("est") + 1.645 * F.col("se")})
    lo, hi = F.col("lo"), F.col("hi")
    return b.agg(r6(F.sum(F.col("w") * F.col("share")) / F.sum("w"), "weighted_share"), _n((lo > -0.003) & (hi < 0.003)).alias("n_pass"),
                 _n((lo > 0) | (hi < 0)).alias("n_excluding_zero"), _n().alias("n_cells"),
                 F.max_by("l_suppkey", F.greatest(F.abs(lo), F.abs(hi))).alias("furthest_cell"))


@query("e48_mean_retained_wide", f"""WITH {CELLS_SQL},
g AS (SELECT property, condition, session, grp, avg(n_trials) AS m FROM cells GROUP BY ALL)
SELECT property, condition, round(avg(m) FILTER (session = 2), 6) AS s2, round(avg(m) FILTER (session = 3), 6) AS s3, round(avg(m) FILTER (session = 4), 6) AS s4, round(avg(m) FILTER (session = 6), 6) AS s6 FROM g GROUP BY ALL""")
def e48(spark, sf):
    g = cells(spark, sf).groupBy("property", "condition", "session", "grp").agg(F.avg("n_trials").alias("m"))
    w = g.groupBy("property", "condition").pivot("session", list(d.SESSIONS)).agg(F.avg("m"))
    return w.select("property", "condition", *[r6(F.col(str(s)), f"s{s}") for s in d.SESSIONS])


@query("e49_coverage_census", """
SELECT source, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (lang = 'fr') AS BIGINT) AS fr, CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS de,
 CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids, CAST(sum(n_chars) AS BIGINT) AS total_chars, max(n_chars) AS longest FROM documents GROUP BY source""")
def e49(spark, sf):
    doc = table(spark, sf, "documents")
    return doc.groupBy("source").agg(*[_n(F.col("lang") == x).alias(x) for x in ("en", "fr", "de")], F.countDistinct("doc_id").alias("n_ids"),
                                     F.sum("n_chars").alias("total_chars"), F.max("n_chars").alias("longest"))


@query("e50_power_summary", """
WITH p AS (SELECT label, list_sum([x * x FOR x IN embedding::DOUBLE[]]) AS power FROM embeddings)
SELECT label, round(avg(power), 6) AS mean_power, round(median(power), 6) AS median_power, round(min(power), 6) AS min_power, round(max(power), 6) AS max_power,
 round(avg(CASE WHEN power BETWEEN 0.8 AND 1.2 THEN 1 ELSE 0 END), 6) AS in_range, CAST(count(*) FILTER (power IS NULL) AS BIGINT) AS n_null FROM p GROUP BY label""")
def e50(spark, sf):
    power = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    p = table(spark, sf, "embeddings").select("label", power.alias("power"))
    g = p.groupBy("label").agg(r6(F.avg("power"), "mean_power"), r6(F.min("power"), "min_power"), r6(F.max("power"), "max_power"),
                               r6(F.avg(F.col("power").between(0.8, 1.2).cast("int")), "in_range"), _n(F.col("power").isNull()).alias("n_null"))
    med = exact_quantiles(p, ["label"], "power", {"m": 0.5})
    return g.join(med, "label").withColumn("median_power", F.round("m", 6)).drop("m")
