"""Section F: window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions.design import micros
from trialweave.operators import windows as wn
from trialweave.operators.recode import zscore
from trialweave.operators.skew import first_per_key, mid_ranks, scan_last, scan_shift, scan_sum
from trialweave.plans.e1_aggregations import WAVE_SQL, waves
from trialweave.plans.e2_audit_tables import PHASES
from trialweave.plans.standins import MARKERS_SQL, SAMPLES_SQL, TRIALS_SQL, markers, r6, samples, trials
from trialweave.registry import query, table

HOUR = 3_600_000_000


@query("f01_entity_zscore", f"""WITH {SAMPLES_SQL},
m AS (SELECT entity, session, condition, marker, avg(amplitude) AS v FROM samples WHERE time_ms BETWEEN 400 AND 898 GROUP BY ALL),
s AS (SELECT entity, avg(v) AS mu, stddev_samp(v) AS sd FROM m GROUP BY entity)
SELECT entity, session, condition, marker, round(CASE WHEN sd IS NULL OR sd = 0 THEN 0 ELSE (v - mu) / sd END, 6) AS z FROM m JOIN s USING (entity)""")
def f01(spark, sf):
    keys = ["entity", "session", "condition", "marker"]
    m = samples(spark, sf).filter("time_ms between 400 and 898").groupBy(*keys).agg(F.avg("amplitude").alias("v"))
    return zscore(m, ["entity"], "v", "z").select(*keys, r6("z", "z"))


@query("f02_baseline_subtraction", f"WITH {WAVE_SQL} SELECT entity, session, condition, time_ms, round(v, 6) AS corrected FROM wave")
def f02(spark, sf):
    return waves(spark, sf).select("entity", "session", "condition", "time_ms", r6("mean_value", "corrected"))


@query("f03_first_row_per_key", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def f03(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return first_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).drop("l_extendedprice")


@query("f04_duplicate_counts", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(n AS BIGINT) AS n_copies, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_extra FROM k GROUP BY n""")
def f04(spark, sf):
    k = wn.duplicate_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return k.groupBy("n_copies").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_extra").alias("n_extra"))


_RUN_SQL = """
l AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS p, event_type IS DISTINCT FROM lag(event_type) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM l)"""


@query("f05_run_lengths", f"WITH {_RUN_SQL} SELECT user_id, CAST(run_no AS BIGINT) AS run_no, any_value(event_type) AS event_type, CAST(count(*) AS BIGINT) AS run_length FROM g GROUP BY user_id, run_no")
def f05(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return wn.runs(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run_no", "event_type", "run_length")


@query("f05_run_text", """
WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM l WHERE p IS NULL OR p <> role)
SELECT conv_id, (n - 1) // 1000 AS part, string_agg(role, '->' ORDER BY turn) AS sequence FROM r GROUP BY ALL""")
def f05_text(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return wn.run_text(wn.runs(c, ["conv_id"], ["turn"], "role"), ["conv_id"], "role")


@query("f06_islands", f"""WITH {WAVE_SQL},
t AS (SELECT session, condition, time_ms, avg(v) AS stat FROM wave GROUP BY ALL),
a AS (SELECT *, stat > 2 AS above, row_number() OVER (PARTITION BY session, condition ORDER BY time_ms) - row_number() OVER (PARTITION BY session, condition, stat > 2 ORDER BY time_ms) AS g FROM t)
SELECT session, condition, min(time_ms) AS start, max(time_ms) AS stop, CAST(count(*) AS BIGINT) AS n_points, round(sum(stat - 2), 6) AS mass,
 CAST(row_number() OVER (PARTITION BY session, condition ORDER BY min(time_ms)) AS BIGINT) AS cluster_id FROM a WHERE above GROUP BY session, condition, g""")
def f06(spark, sf):
    t = waves(spark, sf).groupBy("session", "condition", "time_ms").agg(F.avg("mean_value").alias("stat"))
    return wn.islands(t, ["session", "condition"], "time_ms", "stat", F.lit(2.0)).withColumn("mass", F.round("mass", 6))


@query("f07_interval_merge", f"""WITH {MARKERS_SQL},
i AS (SELECT recording, pos AS start, pos + (seq % 9 + 1) * {HOUR} AS stop FROM markers),
r AS (SELECT *, max(stop) OVER (PARTITION BY recording ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY start) AS grp FROM r)
SELECT recording, min(start) AS start, max(stop) AS stop, CAST(count(*) AS BIGINT) AS n_starts FROM g GROUP BY recording, grp""")
def f07(spark, sf):
    i = markers(spark, sf).select("recording", F.col("pos").alias("start"), (F.col("pos") + (F.col("seq") % 9 + 1) * HOUR).alias("stop"))
    return wn.merge_intervals(i, ["recording"]).select("recording", "start", "stop", "n_starts")


@query("f08_sliding_range", """
WITH w AS (SELECT user_id, event_id, value, count(*) OVER f AS n, max(value) OVER f - min(value) OVER f AS spread, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step
 FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN n = 10 THEN spread END, 6) AS spread, round(step, 6) AS step, coalesce(CASE WHEN n = 10 THEN spread END > 150, FALSE) OR coalesce(step > 100, FALSE) AS flagged FROM w""")
def f08(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    d = wn.sliding_frames(e, ["user_id"], ["ts", "event_id"], 10, spread=lambda w: F.max("value").over(w) - F.min("value").over(w))
    d = scan_shift(d, ["user_id"], ["ts", "event_id"], _p=F.col("value"))
    step = F.abs(F.col("value") - F.col("_p"))
    no = F.lit(False)
    return d.select("user_id", "event_id", r6("spread", "spread"), r6(step, "step"), (F.coalesce(F.col("spread") > 150, no) | F.coalesce(step > 100, no)).alias("flagged"))


@query("f09_event_order", """
SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS event_order, round(row_number() OVER w / count(*) OVER (PARTITION BY user_id), 9) AS order_fraction
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def f09(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return wn.order_fractions(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_order", r6("order_fraction", "order_fraction", 9))


@query("f10_inversions", f"""WITH {TRIALS_SQL}, l AS (SELECT entity, k, lag(k) OVER (PARTITION BY entity ORDER BY ts, event_id) AS p FROM trials)
SELECT entity, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (k < p) AS BIGINT) AS n_inversions FROM l GROUP BY entity""")
def f10(spark, sf):
    return wn.inversions(trials(spark, sf).select("entity", "ts", "event_id", "k"), ["entity"], ["ts", "event_id"], "k")


@query("f11_gap_then_return", """
WITH a AS (SELECT DISTINCT o_custkey AS entity, CAST(date_part('year', o_orderdate) AS INT) AS y FROM orders), l AS (SELECT *, lag(y) OVER (PARTITION BY entity ORDER BY y) AS p FROM a)
SELECT entity, CAST(count(*) AS BIGINT) AS n_years, bool_or(coalesce(y - p > 1, FALSE)) AS gap_then_return FROM l GROUP BY entity""")
def f11(spark, sf):
    # distinct years per entity are few, so the span decides: a gap exists when years are missing inside it
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.countDistinct(F.year("o_orderdate")).alias("n_years"), (F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate")) + 1).alias("span"))
    return a.select("entity", "n_years", (F.col("span") > F.col("n_years")).alias("gap_then_return"))


@query("f12_mid_rank", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS mr FROM lineitem)
SELECT l_returnflag, l_quantity, CAST(count(*) AS BIGINT) AS n, min(mr)::DOUBLE AS mid_rank FROM r GROUP BY ALL""")
def f12(spark, sf):
    r = mid_ranks(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return r.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.min("mid_rank").alias("mid_rank"))


@query("f13_prefix_sums", """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running_total FROM orders""")
def f13(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return scan_sum(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], t=F.col("o_totalprice")).select("o_custkey", "o_orderkey", F.round("t", 2).alias("running_total"))


@query("f14_next_start", """
WITH p AS (SELECT user_id, event_id, ts, event_type FROM events),
n AS (SELECT *, first_value(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p)
SELECT user_id, event_id, CAST(nxt - epoch_us(ts) AS BIGINT) AS to_next_us FROM n""")
def f14(spark, sf):
    us = micros(F.col("ts"))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", us.alias("us"))
    d = scan_last(e, ["user_id"], ["ts", "event_id"], reverse=True, nxt=F.when(F.col("event_type") == PHASES[0], F.col("us")))
    return d.select("user_id", "event_id", (F.col("nxt") - F.col("us")).alias("to_next_us"))


PVAL_SQL = """
pv AS (SELECT l_suppkey AS test, CAST(l_suppkey % 3 AS BIGINT) AS family, 2 * (1 - avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) - 1.3 AS raw, count(*) AS n FROM lineitem GROUP BY 1),
pp AS (SELECT test, family, least(1, greatest(0.0001, abs(raw) * sqrt(n) / 10)) AS p FROM pv)"""


def p_values(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("test")).agg(
        (2 * (1 - F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))) - 1.3).alias("raw"), F.count(F.lit(1)).alias("n"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0001), F.abs("raw") * F.sqrt("n") / 10))
    return g.select("test", (F.col("test") % 3).alias("family"), p.alias("p"))


ADJUST_SQL = f"""{PVAL_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r, count(*) OVER (PARTITION BY family) AS m FROM pp),
adj AS (SELECT test, family, p, least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC)) AS p_bh, least(1, max(p * (m - r + 1)) OVER (PARTITION BY family ORDER BY r)) AS p_holm FROM r)"""


@query("f15_adjusted_p", f"WITH {ADJUST_SQL} SELECT test, family, round(p, 9) AS p, round(p_bh, 9) AS p_bh, round(p_holm, 9) AS p_holm FROM adj")
def f15(spark, sf):
    a = wn.adjust_p(p_values(spark, sf), ["family"], "p", "test")
    return a.select("test", "family", *[r6(c, c, 9) for c in ("p", "p_bh", "p_holm")])


@query("f16_odd_even_split", f"""WITH {TRIALS_SQL}, h AS (SELECT entity, k, CASE WHEN row_number() OVER (PARTITION BY entity, session ORDER BY ts, event_id) % 2 = 1 THEN 'odd' ELSE 'even' END AS half FROM trials)
SELECT entity, half, CAST(count(*) AS BIGINT) AS n, round(avg(k), 6) AS mean_k FROM h GROUP BY ALL""")
def f16(spark, sf):
    h = wn.alternate_split(trials(spark, sf).select("entity", "session", "ts", "event_id", "k"), ["entity", "session"], ["ts", "event_id"])
    return h.groupBy("entity", "half").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("k"), "mean_k"))


@query("f17_best_candidate", """
SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) = 1""")
def f17(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate")
    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    best = wn.best_candidate(o, ["o_custkey"], [F.col("o_orderpriority"), (F.col("o_orderstatus") != "F").cast("int"), -day, F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@query("f18_greedy_segments", f"""WITH RECURSIVE {MARKERS_SQL},
p AS (SELECT DISTINCT recording, pos AS start FROM markers WHERE code IN (1, 2, 3, 101, 102, 103)),
g(recording, start) AS (SELECT recording, min(start) FROM p GROUP BY recording
  UNION ALL SELECT g.recording, (SELECT min(p.start) FROM p WHERE p.recording = g.recording AND p.start >= g.start + {24 * HOUR}::BIGINT) AS nxt FROM g WHERE g.start IS NOT NULL)
SELECT recording, CAST(start AS BIGINT) AS start FROM g WHERE start IS NOT NULL""")
def f18(spark, sf):
    m = markers(spark, sf).filter(F.col("code").isin(1, 2, 3, 101, 102, 103)).select("recording", F.col("pos").alias("start"))
    return wn.greedy_segments(m, "recording", "start", 24 * HOUR)


