"""Section C: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import filters as fl
from trialweave.plans.standins import SAMPLES_SQL, TRIALS_SQL, WINDOWS_SQL, r6, samples, trials, windows
from trialweave.registry import query, table

VALID = "property IS NOT NULL AND condition IS NOT NULL AND correct IS NOT NULL"


@query("c01_block_filter", f"""WITH {TRIALS_SQL}
SELECT property, session, CAST(count(*) AS BIGINT) AS n FROM trials WHERE event_type <> 'signup' AND property IS NOT NULL GROUP BY ALL""")
def c01(spark, sf):
    t = trials(spark, sf).filter((F.col("event_type") != "signup") & F.col("property").isNotNull())
    return t.groupBy("property", "session").agg(F.count(F.lit(1)).alias("n"))


@query("c02_valid_rows", f"WITH {TRIALS_SQL} SELECT event_id, property, condition, correct FROM trials WHERE {VALID}")
def c02(spark, sf):
    return fl.valid_trials(trials(spark, sf)).select("event_id", "property", "condition", "correct")


@query("c03_response_time_rule", f"""WITH {TRIALS_SQL}
SELECT 'finite' AS rule, CAST(count(*) AS BIGINT) AS n, round(avg(rt), 6) AS mean_rt FROM trials WHERE rt > 0
UNION ALL SELECT 'screen', CAST(count(*) AS BIGINT), round(avg(rt), 6) FROM trials WHERE rt > 200 AND rt < 4000""")
def c03(spark, sf):
    t = trials(spark, sf)
    agg = lambda f, n: f.agg(F.lit(n).alias("rule"), F.count(F.lit(1)).alias("n"), r6(F.avg("rt"), "mean_rt"))
    return agg(fl.rt_rule(t, "rt", False), "finite").unionByName(agg(fl.rt_rule(t, "rt", True), "screen"))


@query("c04_window_filter", f"""WITH {SAMPLES_SQL}, {WINDOWS_SQL}
SELECT window_name, condition, CAST(count(*) AS BIGINT) AS n, round(avg(amplitude), 6) AS mean_amplitude
FROM samples JOIN windows ON time_ms BETWEEN min_ms AND max_ms GROUP BY ALL
UNION ALL SELECT 'baseline', condition, CAST(count(*) AS BIGINT), round(avg(amplitude), 6) FROM samples WHERE time_ms < 0 GROUP BY ALL""")
def c04(spark, sf):
    s = samples(spark, sf)
    base = s.filter("time_ms < 0").withColumn("window_name", F.lit("baseline"))
    both = fl.in_windows(s, windows(spark)).unionByName(base)
    return both.groupBy("window_name", "condition").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("amplitude"), "mean_amplitude"))


_LISTED_SQL = "listed AS (SELECT s_suppkey AS entity, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS session FROM supplier WHERE s_acctbal < 1000)"


@query("c05_exclusion_list", f"""WITH {SAMPLES_SQL}, {_LISTED_SQL}
SELECT source, 'list' AS rule, CAST(count(*) AS BIGINT) AS n FROM samples s WHERE NOT (source <> 'overlay' AND EXISTS
   (SELECT 1 FROM listed l WHERE l.entity = s.entity AND l.session = s.session)) GROUP BY source
UNION ALL SELECT source, 'list and overlay', CAST(count(*) AS BIGINT) FROM samples s WHERE NOT EXISTS
   (SELECT 1 FROM listed l WHERE l.entity = s.entity AND l.session = s.session) GROUP BY source""")
def c05(spark, sf):
    s = samples(spark, sf).select("entity", "session", "source")
    k = F.col("s_suppkey")
    listed = table(spark, sf, "supplier").filter("s_acctbal < 1000").select(
        k.alias("entity"), F.element_at(F.array(*[F.lit(x) for x in d.SESSIONS]), (k % 4 + 1).cast("int")).alias("session"))
    out = [fl.drop_listed(s, listed, ["entity", "session"], also_overlay=o).groupBy("source").agg(
        F.lit(n).alias("rule"), F.count(F.lit(1)).alias("n")) for o, n in ((False, "list"), (True, "list and overlay"))]
    return out[0].unionByName(out[1])


@query("c06_complete_cases", f"""WITH {TRIALS_SQL} SELECT event_id FROM trials
WHERE property IS NOT NULL AND condition IS NOT NULL AND correct IS NOT NULL AND rt IS NOT NULL""")
def c06(spark, sf):
    return trials(spark, sf).na.drop(subset=["property", "condition", "correct", "rt"]).select("event_id")


@query("c07_complete_patterns", f"""WITH {SAMPLES_SQL},
cells AS (SELECT entity, session, condition, marker, region, time_ms // 400 AS bin, avg(amplitude) AS v FROM samples WHERE time_ms >= 0 GROUP BY ALL),
full_units AS (SELECT entity, session, condition, marker FROM cells GROUP BY ALL HAVING count(v) = 9)
SELECT entity, session, condition, marker, CAST(count(*) AS BIGINT) AS n_cells FROM cells SEMI JOIN full_units USING (entity, session, condition, marker) GROUP BY ALL""")
def c07(spark, sf):
    unit = ["entity", "session", "condition", "marker"]
    cells = samples(spark, sf).filter("time_ms >= 0").groupBy(*unit, "region", F.floor(F.col("time_ms") / 400).alias("bin")).agg(
        F.avg("amplitude").alias("v"))
    return fl.complete_units(cells, unit, "v", 9).groupBy(*unit).agg(F.count(F.lit(1)).alias("n_cells"))


@query("c08_common_sensors", f"""WITH {TRIALS_SQL},
x AS (SELECT 'k' || CAST(k AS VARCHAR) AS sensor, session FROM trials),
keep AS (SELECT sensor FROM x GROUP BY sensor HAVING count(DISTINCT session) = (SELECT count(DISTINCT session) FROM x) AND sensor NOT IN ('k1', 'k2'))
SELECT sensor, CAST(count(*) AS BIGINT) AS n FROM x SEMI JOIN keep USING (sensor) GROUP BY sensor""")
def c08(spark, sf):
    t = trials(spark, sf)
    x = t.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("sensor"), "session")
    return fl.common_sensors(x, "sensor", "session", ("k1", "k2")).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


@query("c09_drop_all_null", f"""WITH {TRIALS_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM trials WHERE NOT (condition IS NULL AND correct IS NULL)""")
def c09(spark, sf):
    return trials(spark, sf).select("condition", "correct").na.drop("all").agg(F.count(F.lit(1)).alias("n"))


@query("c10_minimum_cells", f"""WITH {TRIALS_SQL}
SELECT property, session, condition, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT entity) AS BIGINT) AS n_entities,
 count(*) >= 20 AND count(DISTINCT entity) >= 3 AS kept FROM trials GROUP BY ALL""")
def c10(spark, sf):
    return fl.minimum_cells(trials(spark, sf), ["property", "session", "condition"], "entity", 20, 3)


@query("c11_informative_strata", f"""WITH {TRIALS_SQL},
v AS (SELECT * FROM trials WHERE {VALID}),
s AS (SELECT entity, session, property, avg(correct) AS m FROM v GROUP BY ALL)
SELECT v.event_id FROM v JOIN s USING (entity, session, property) WHERE m > 0 AND m < 1""")
def c11(spark, sf):
    return fl.informative_strata(fl.valid_trials(trials(spark, sf)), ["entity", "session", "property"], "correct").select("event_id")


@query("c12_post_stimulus_peak", f"""WITH {SAMPLES_SQL},
w AS (SELECT condition, time_ms, avg(amplitude) AS v FROM samples GROUP BY ALL)
SELECT condition, round(max(v), 6) AS peak, arg_max(time_ms, v) AS peak_ms FROM w WHERE time_ms >= 0 GROUP BY condition""")
def c12(spark, sf):
    w = samples(spark, sf).filter("time_ms >= 0").groupBy("condition", "time_ms").agg(F.avg("amplitude").alias("v"))
    return w.groupBy("condition").agg(r6(F.max("v"), "peak"), F.max_by("time_ms", "v").alias("peak_ms"))
