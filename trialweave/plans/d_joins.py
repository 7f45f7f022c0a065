"""Section D: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators import joins as jn
from trialweave.operators.skew import small_side
from trialweave.plans.standins import MARKERS_SQL, SAMPLES_SQL, TRIAL_KEY, TRIALS_SQL, markers, r6, samples, trials
from trialweave.registry import query, table


@query("d01_pairs_and_report", """
WITH a AS (SELECT doc_id FROM documents), b AS (SELECT DISTINCT doc_id + 7 AS doc_id FROM labels)
SELECT doc_id, 'paired' AS state FROM a JOIN b USING (doc_id)
UNION ALL SELECT doc_id, 'missing right' FROM a ANTI JOIN b USING (doc_id)
UNION ALL SELECT doc_id, 'missing left' FROM b ANTI JOIN a USING (doc_id)""")
def d01(spark, sf):
    a = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "labels").select((F.col("doc_id") + 7).alias("doc_id")).distinct()
    pairs, report = jn.pair_with_report(a, b, "doc_id")
    return pairs.select("doc_id", F.lit("paired").alias("state")).unionByName(
        report.select("doc_id", F.concat(F.lit("missing "), "missing").alias("state")))


@query("d02_covariate_chain", """
SELECT r_name, n_name, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def d02(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey").select("c_custkey", "n_nationkey")
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    j = jn.checked_left_join(o, c, ["c_custkey"], "customer")
    j = jn.checked_left_join(j, n, ["n_nationkey"], "nation")
    j = jn.checked_left_join(j, table(spark, sf, "region"), ["r_regionkey"], "region")
    return j.groupBy("r_name", "n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("d03_two_hop_score", f"""WITH {TRIALS_SQL}
SELECT event_id, entity, c_nationkey AS hop_id, n_regionkey AS score FROM trials
LEFT JOIN customer ON entity = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def d03(spark, sf):
    t = trials(spark, sf).select("event_id", "entity")
    hop = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("hop_id"))
    score = table(spark, sf, "nation").select(F.col("n_nationkey").alias("hop_id"), F.col("n_regionkey").alias("score"))
    out = jn.checked_left_join(jn.checked_left_join(t, hop, ["entity"]), score, ["hop_id"])
    return out.select("event_id", "entity", "hop_id", "score")


_KEY_SQL = "entity, session, condition, marker"


@query("d04_attach_baseline", f"""WITH {SAMPLES_SQL},
b AS (SELECT {_KEY_SQL}, avg(amplitude) AS base FROM samples WHERE time_ms < 0 GROUP BY ALL),
w AS (SELECT {_KEY_SQL}, avg(amplitude) AS m FROM samples WHERE time_ms BETWEEN 200 AND 498 GROUP BY ALL)
SELECT {_KEY_SQL}, round(m, 6) AS window_mean, round(base, 6) AS baseline FROM w LEFT JOIN b USING ({_KEY_SQL})""")
def d04(spark, sf):
    # one conditional aggregate replaces the co-partitioned self-join
    g = samples(spark, sf).groupBy(*TRIAL_KEY).agg(
        F.avg(F.when(F.col("time_ms").between(200, 498), F.col("amplitude"))).alias("m"),
        F.avg(F.when(F.col("time_ms") < 0, F.col("amplitude"))).alias("base"))
    return g.filter("m is not null").select(*TRIAL_KEY, r6("m", "window_mean"), r6("base", "baseline"))


@query("d05_paired_difference", f"""WITH {SAMPLES_SQL},
m AS (SELECT entity, session, condition, avg(amplitude) AS v FROM samples WHERE time_ms BETWEEN 400 AND 898 GROUP BY ALL)
SELECT a.entity, a.session, round(b.v - a.v, 6) AS difference FROM m a JOIN m b ON a.entity = b.entity AND a.session = b.session
WHERE a.condition = 'Grammatical' AND b.condition = 'Ungrammatical'""")
def d05(spark, sf):
    m = samples(spark, sf).filter("time_ms between 400 and 898").groupBy("entity", "session", "condition").agg(F.avg("amplitude").alias("v"))
    out = jn.paired_difference(m, ["entity", "session"], "condition", "v", d.CONTROL, d.VIOLATION)
    return out.select("entity", "session", r6("difference", "difference"))


@query("d06_stage_membership", """
WITH enrolled AS (SELECT c_custkey AS id FROM customer), ordered AS (SELECT DISTINCT o_custkey AS id FROM orders),
 finished AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), logged AS (SELECT DISTINCT user_id AS id FROM events)
SELECT 'ordered and logged' AS stage, CAST(count(*) AS BIGINT) AS n FROM (SELECT id FROM ordered INTERSECT SELECT id FROM logged)
UNION ALL SELECT 'enrolled not ordered', CAST(count(*) AS BIGINT) FROM enrolled ANTI JOIN ordered USING (id)
UNION ALL SELECT 'ordered and finished', CAST(count(*) AS BIGINT) FROM ordered SEMI JOIN finished USING (id)
UNION ALL SELECT 'logged not enrolled', CAST(count(*) AS BIGINT) FROM logged ANTI JOIN enrolled USING (id)""")
def d06(spark, sf):
    o = table(spark, sf, "orders")
    enrolled = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    ordered = o.select(F.col("o_custkey").alias("id")).distinct()
    finished = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    logged = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    n = lambda df, s: df.agg(F.lit(s).alias("stage"), F.count(F.lit(1)).alias("n"))
    return (n(ordered.intersect(logged), "ordered and logged")
            .unionByName(n(enrolled.join(ordered, "id", "left_anti"), "enrolled not ordered"))
            .unionByName(n(ordered.join(finished, "id", "left_semi"), "ordered and finished"))
            .unionByName(n(logged.join(enrolled, "id", "left_anti"), "logged not enrolled")))


@query("d07_reconcile", """
WITH a AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 b AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT id, CAST(a.n AS BIGINT) AS left_value, CAST(b.n AS BIGINT) AS right_value,
 CASE WHEN a.n IS NULL THEN 'right_only' WHEN b.n IS NULL THEN 'left_only' ELSE 'both' END AS origin FROM a FULL JOIN b USING (id)""")
def d07(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return jn.reconcile(a, b, ["id"], "n")


# three successive condition events share a stamp and segments re-export them with a jitter, so stamps repeat and
# segments compete for events; every seventh segment is far off
_CLOCK_SQL = f"""{MARKERS_SQL},
ev AS (SELECT recording, code, CASE WHEN seq % 5 <> 0 THEN seq % 4 END AS branch, seq // 3 * 2100 AS abs_us, seq AS event_id FROM markers WHERE code IN (101, 102, 103)),
sg AS (SELECT recording, code, seq % 4 AS branch, seq // 3 * 2100 + (seq % 3 - 1) * 900 + CASE WHEN seq % 7 = 0 THEN 500000 ELSE 0 END AS abs_us, seq AS segment_id FROM markers WHERE code IN (101, 102, 103)),
en AS (SELECT *, row_number() OVER (PARTITION BY recording, code ORDER BY abs_us, event_id) AS i FROM ev),
sn AS (SELECT *, row_number() OVER (PARTITION BY recording, code ORDER BY abs_us, segment_id) AS j FROM sg),
walk(recording, code, i, j, event_id, segment_id, dd) AS (
 SELECT DISTINCT recording, code, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM en
 UNION ALL
 SELECT recording, code, CASE WHEN en.abs_us <= sn.abs_us + 2000 THEN i + 1 ELSE i END, CASE WHEN sn.abs_us <= en.abs_us + 2000 THEN j + 1 ELSE j END,
  CASE WHEN abs(en.abs_us - sn.abs_us) <= 2000 THEN en.event_id END, CASE WHEN abs(en.abs_us - sn.abs_us) <= 2000 THEN sn.segment_id END, abs(en.abs_us - sn.abs_us)
 FROM (SELECT recording, code, i, j FROM walk) JOIN en USING (recording, code, i) JOIN sn USING (recording, code, j)),
c AS (SELECT recording, code, event_id, segment_id, dd FROM walk WHERE event_id IS NOT NULL)"""


def _clock_sides(spark, sf):
    m = markers(spark, sf).filter(F.col("code").isin(*d.CONDITION_CODES))
    at = F.floor(F.col("seq") / 3) * 2100
    branch = F.col("seq") % 4
    ev = m.select("recording", "code", F.when(F.col("seq") % 5 != 0, branch).alias("branch"), at.alias("abs_us"), F.col("seq").alias("event_id"))
    shift = (F.col("seq") % 3 - 1) * 900 + F.when(F.col("seq") % 7 == 0, 500_000).otherwise(0)
    sg = m.select("recording", "code", branch.alias("branch"), (at + shift).alias("abs_us"), F.col("seq").alias("segment_id"))
    return ev, sg


@query("d08_clock_match", f"""WITH RECURSIVE {_CLOCK_SQL}
SELECT event_id, segment_id, recording, code, dd AS clock_difference FROM c""")
def d08(spark, sf):
    ev, sg = _clock_sides(spark, sf)
    return jn.clock_match(ev, sg, ["recording", "code"], "abs_us", "event_id", "segment_id", 2000)


# an event without a branch marker is a candidate for segments of every branch
@query("d09_unique_fallback", f"""WITH RECURSIVE {_CLOCK_SQL},
e AS (SELECT * FROM ev WHERE event_id NOT IN (SELECT event_id FROM c)), s AS (SELECT * FROM sg WHERE segment_id NOT IN (SELECT segment_id FROM c)),
s1 AS (SELECT recording, code, branch, min(segment_id) AS segment_id FROM s GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT s1.*, e.event_id, count(*) OVER (PARTITION BY segment_id) AS n FROM s1 JOIN e ON e.recording = s1.recording AND e.code = s1.code AND (e.branch = s1.branch OR e.branch IS NULL))
SELECT recording, code, branch, event_id, segment_id FROM p WHERE n = 1 QUALIFY count(*) OVER (PARTITION BY event_id) = 1""")
def d09(spark, sf):
    ev, sg = _clock_sides(spark, sf)
    hit = jn.clock_match(ev, sg, ["recording", "code"], "abs_us", "event_id", "segment_id", 2000).select("event_id", "segment_id")
    return jn.unique_fallback(ev, sg, hit, ["recording", "code", "branch"], "event_id", "segment_id", open_key="branch")


@query("d10_occurrence_join", f"""WITH {TRIALS_SQL},
l AS (SELECT event_id AS left_id, ts, entity, session, property FROM trials WHERE event_type = 'purchase'),
r AS (SELECT event_id AS right_id, ts, entity, session, property FROM trials WHERE event_type = 'click'),
a AS (SELECT *, row_number() OVER (PARTITION BY entity, session, property ORDER BY ts, left_id) AS occ FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, session, property ORDER BY ts, right_id) AS occ FROM r),
f AS (SELECT left_id, right_id FROM a JOIN b USING (entity, session, property, occ)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY ts, left_id) AS occ FROM l WHERE left_id NOT IN (SELECT left_id FROM f)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY ts, right_id) AS occ FROM r WHERE right_id NOT IN (SELECT right_id FROM f))
SELECT left_id, right_id, 'full key' AS match_type FROM f
UNION ALL SELECT left_id, right_id, 'short key' FROM a2 JOIN b2 USING (entity, property, occ)""")
def d10(spark, sf):
    t = trials(spark, sf).select("event_id", "ts", "entity", "session", "property", "event_type")
    l = t.filter("event_type = 'purchase'").withColumnRenamed("event_id", "left_id")
    r = t.filter("event_type = 'click'").withColumnRenamed("event_id", "right_id")
    return jn.occurrence_join(l, r, ["entity", "session", "property"], ["entity", "property"], ["ts", "left_id"],
                              ["ts", "right_id"], "left_id", "right_id")


@query("d11_sequence_alignment", f"""WITH RECURSIVE {TRIALS_SQL},
a AS (SELECT entity, session, row_number() OVER (PARTITION BY entity, session ORDER BY epoch_us(ts), event_id) - 1 AS i, event_id AS left_id, k % 10 AS code FROM trials WHERE event_type = 'click'),
b AS (SELECT entity, session, row_number() OVER (PARTITION BY entity, session ORDER BY epoch_us(ts), event_id) - 1 AS j, event_id AS right_id, k % 10 AS code FROM trials WHERE event_type = 'view'),
pr AS (SELECT a.entity, a.session, i, j FROM a JOIN b ON a.entity = b.entity AND a.session = b.session AND a.code IS NOT DISTINCT FROM b.code),
rn AS (SELECT entity, session, i - j AS d, min(i) AS i0, max(i) + 1 AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY entity, session, i - j ORDER BY i) AS g FROM pr) GROUP BY entity, session, i - j, g),
walk(entity, session, alo, ahi, blo, bhi, m) AS (
 SELECT entity, session, 0::BIGINT, n, 0::BIGINT, m, min({{'s': i0 - i1, 'i': i0, 'j': i0 - d}}) FROM (SELECT entity, session, count(*) AS n FROM a GROUP BY ALL) JOIN (SELECT entity, session, count(*) AS m FROM b GROUP BY ALL) USING (entity, session) JOIN rn USING (entity, session) GROUP BY ALL
 UNION ALL
 SELECT entity, session, alo, ahi, blo, bhi, min({{'s': greatest(i0, alo, blo + d) - least(i1, ahi, bhi + d), 'i': greatest(i0, alo, blo + d), 'j': greatest(i0, alo, blo + d) - d}})
 FROM (SELECT entity, session, c.alo, c.ahi, c.blo, c.bhi FROM (SELECT entity, session, unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j}}, {{'alo': m.i - m.s, 'ahi': ahi, 'blo': m.j - m.s, 'bhi': bhi}}]) AS c FROM walk))
 JOIN rn USING (entity, session) WHERE least(i1, ahi, bhi + d) > greatest(i0, alo, blo + d) GROUP BY ALL),
hit AS (SELECT entity, session, m.i + k AS i, m.j + k AS j FROM (SELECT entity, session, m, unnest(range(0, -m.s)) AS k FROM walk)),
num AS (SELECT *, CASE WHEN i = lag(i) OVER w + 1 AND j = lag(j) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY entity, session ORDER BY i))
SELECT entity, session, left_id, right_id, CAST(sum(fresh) OVER (PARTITION BY entity, session ORDER BY i) - 1 AS INT) AS block_no FROM num JOIN a USING (entity, session, i) JOIN b USING (entity, session, j)""")
def d11(spark, sf):
    # two code sequences of one recording session: recorded clicks and logged views, coded by k modulo 10
    t = trials(spark, sf).select("entity", "session", d.micros(F.col("ts")).alias("us"), (F.col("k") % 10).alias("code"), "event_id", "event_type")
    side = lambda kind, name: t.filter(F.col("event_type") == kind).withColumnRenamed("event_id", name)
    return jn.align_sequences(side("click", "left_id"), side("view", "right_id"), ["entity", "session"], "us", "code", "left_id", "right_id")


ASOF_SQL = f"""{MARKERS_SQL},
b AS (SELECT *, sum(CASE WHEN code IN (5, 6, 7, 8, 254, 255) THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY pos, seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bid FROM markers),
asof_events AS (SELECT recording, seq, code, pos,
  last_value(CASE WHEN code IN (1, 2, 3) THEN code END IGNORE NULLS) OVER w AS prop_marker,
  last_value(CASE WHEN code IN (1, 2, 3) THEN pos END IGNORE NULLS) OVER w AS prop_marker_pos,
  last_value(CASE WHEN code BETWEEN 110 AND 253 THEN code END IGNORE NULLS) OVER w AS sentence,
  last_value(CASE WHEN code BETWEEN 40 AND 99 THEN code END IGNORE NULLS) OVER w AS word,
  last_value(CASE WHEN code BETWEEN 40 AND 99 THEN pos END IGNORE NULLS) OVER w AS word_pos
 FROM (SELECT *, coalesce(bid, 0) AS g FROM b) WINDOW w AS (PARTITION BY recording, g ORDER BY pos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def asof_events(spark, sf):
    m = markers(spark, sf)
    c = F.col("code")
    out = jn.as_of_within_boundary(
        m, ["recording"], ["pos", "seq"], c.isin(*d.BOUNDARY_CODES), F.col("pos"),
        prop_marker=F.when(c.isin(*d.PROPERTY_CODES), c), sentence=F.when(c.between(*d.SENTENCE_CODES), c),
        word=F.when(c.between(*d.WORD_CODES), c))
    return out.filter(c.isin(*d.CONDITION_CODES))


@query("d12_as_of_in_boundary", f"""WITH {ASOF_SQL}
SELECT recording, seq, code, prop_marker, sentence, word, CAST((pos - prop_marker_pos) // 2000 AS BIGINT) AS lag_samples
FROM asof_events WHERE code IN (101, 102, 103)""")
def d12(spark, sf):
    return asof_events(spark, sf).select("recording", "seq", "code", "prop_marker", "sentence", "word",
                                         F.floor((F.col("pos") - F.col("prop_marker_pos")) / 2000).alias("lag_samples"))


HOUR = 3_600_000_000


@query("d13_interval_overlap", f"""WITH {MARKERS_SQL},
e AS (SELECT recording, seq, pos - {HOUR} AS start, pos + 2 * {HOUR}::BIGINT AS stop FROM markers WHERE code IN (101, 102, 103)),
bad AS (SELECT recording, pos AS start, pos + (seq % 5 + 1) * {HOUR} AS stop FROM markers WHERE code IN (5, 6))
SELECT recording, seq, EXISTS (SELECT 1 FROM bad WHERE bad.recording = e.recording AND bad.start < e.stop AND e.start < bad.stop) AS overlaps FROM e""")
def d13(spark, sf):
    m = markers(spark, sf)
    e = m.filter(F.col("code").isin(101, 102, 103)).select("recording", "seq", (F.col("pos") - HOUR).alias("start"), (F.col("pos") + 2 * HOUR).alias("stop"))
    bad = m.filter(F.col("code").isin(5, 6)).select("recording", F.col("pos").alias("start"), (F.col("pos") + (F.col("seq") % 5 + 1) * HOUR).alias("stop"))
    return jn.overlap_flag(e, bad, ["recording"], "seq").select("recording", "seq", "overlaps")


@query("d14_parent_child", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n,
 CAST(count(*) FILTER (l_shipdate >= o_orderdate AND l_shipdate + INTERVAL 30 DAY <= o_orderdate + INTERVAL 120 DAY) AS BIGINT) AS inside,
 CAST(count(*) FILTER (l_shipdate < o_orderdate) AS BIGINT) AS starts_early
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def d14(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    ship = F.col("l_shipdate")
    start, end = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 120 DAYS")
    fits = (ship >= start) & (ship + F.expr("INTERVAL 30 DAYS") <= end)
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("inside"), F.count_if(ship < start).alias("starts_early"))


@query("d15_markers_in_segments", f"""WITH {MARKERS_SQL},
s AS (SELECT recording, seq AS segment_id, pos - 2 * {HOUR} AS start FROM markers WHERE code IN (101, 102, 103))
SELECT m.recording, segment_id, m.seq, m.code, CAST(m.pos - s.start AS BIGINT) AS relative FROM markers m JOIN s
ON m.recording = s.recording AND m.pos >= s.start AND m.pos < s.start + 6 * {HOUR}::BIGINT""")
def d15(spark, sf):
    m = markers(spark, sf)
    s = m.filter(F.col("code").isin(101, 102, 103)).select("recording", F.col("seq").alias("segment_id"), (F.col("pos") - 2 * HOUR).alias("start"))
    return jn.points_in_segments(m, s, ["recording"], "pos", 6 * HOUR).select("recording", "segment_id", "seq", "code", "relative")


PAIRS_SQL = f"""{SAMPLES_SQL},
pair_rows AS (SELECT entity, session, time_ms, avg(CASE WHEN condition = 'Grammatical' THEN amplitude END) AS a,
   avg(CASE WHEN condition = 'Ungrammatical' THEN amplitude END) AS b FROM samples GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY session, time_ms) AS i, count(*) OVER (PARTITION BY entity) AS n FROM pair_rows),
rotated AS (SELECT l.entity, l.session, l.time_ms, l.a, l.b, r.b AS rotated FROM numbered l JOIN numbered r ON l.entity = r.entity AND r.i = l.i % l.n + 1)"""


def pair_rows(spark, sf):
    c = F.col("condition")
    p = samples(spark, sf).groupBy("entity", "session", "time_ms").agg(
        F.avg(F.when(c == d.CONTROL, F.col("amplitude"))).alias("a"), F.avg(F.when(c == d.VIOLATION, F.col("amplitude"))).alias("b"))
    return p.filter("a is not null and b is not null")


@query("d16_equal_stamp_pairs", f"""WITH {PAIRS_SQL} SELECT entity, CAST(count(*) AS BIGINT) AS n, round(avg(b - a), 6) AS paired_shift,
 round(avg(abs(rotated - a)), 6) AS control_spread FROM rotated GROUP BY entity""")
def d16(spark, sf):
    r = jn.rotated_pairs(pair_rows(spark, sf), ["entity"], ["session", "time_ms"], "a", "b")
    return r.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("b") - F.col("a")), "paired_shift"),
                                   r6(F.avg(F.abs(F.col("rotated") - F.col("a"))), "control_spread"))


@query("d17_expected_grid", f"""WITH {TRIALS_SQL},
found AS (SELECT property, session, grp, count(*) AS n FROM trials WHERE condition IS NOT NULL GROUP BY ALL),
grid AS (SELECT p.property, s.session, g.grp FROM (VALUES ('gender'), ('agreement'), ('marking')) p(property),
 (VALUES (2), (3), (4), (6), (7)) s(session), (SELECT DISTINCT grp FROM trials) g)
SELECT property, session, grp, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN found USING (property, session, grp)""")
def d17(spark, sf):
    t = trials(spark, sf)
    found = t.filter("condition is not null").groupBy("property", "session", "grp").agg(F.count(F.lit(1)).alias("n"))
    levels = spark.createDataFrame([("gender",), ("agreement",), ("marking",)], "property string")
    sessions = spark.createDataFrame([(s,) for s in (*d.SESSIONS, 7)], "session int")
    grid = levels.crossJoin(sessions).crossJoin(t.select("grp").distinct())  # a fixed 3 x 5 grid times the group labels
    return grid.join(found, ["property", "session", "grp"], "left").select("property", "session", "grp", F.coalesce("n", F.lit(0)).alias("n"))


@query("d18_edge_distance", f"""WITH {MARKERS_SQL},
e AS (SELECT recording, pos FROM markers WHERE code IN (5, 6, 7, 8))
SELECT m.recording, m.seq, CAST((SELECT min(abs(e.pos - m.pos)) FROM e WHERE e.recording = m.recording) AS BIGINT) AS edge_distance
FROM markers m WHERE code IN (101, 102, 103)""")
def d18(spark, sf):
    m = markers(spark, sf)
    edges = m.filter(F.col("code").isin(5, 6, 7, 8)).select("recording", F.col("pos").alias("edge"))
    pts = m.filter(F.col("code").isin(101, 102, 103))
    return jn.edge_distance(pts, edges, ["recording"], "pos", "seq")


@query("d19_coordinates_and_difference", """
WITH g AS (SELECT s_nationkey, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS b
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)
SELECT n_name, n_regionkey, round(b - a, 8) AS difference FROM g JOIN nation ON s_nationkey = n_nationkey""")
def d19(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    flag = F.col("l_returnflag")
    per_supplier = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.sum(F.when(flag == f, F.col("l_discount"))).alias(f"s{f}") for f in "AR"],
        *[F.count(F.when(flag == f, F.col("l_discount"))).alias(f"n{f}") for f in "AR"])
    g = per_supplier.join(small_side(s), "l_suppkey").groupBy("s_nationkey").agg(
        (F.sum("sR") / F.sum("nR") - F.sum("sA") / F.sum("nA")).alias("diff"))
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return g.join(small_side(n), "s_nationkey").select("n_name", "n_regionkey", r6("diff", "difference", 8))


@query("d20_family_merge", """
WITH f AS (SELECT l_suppkey AS term, l_linestatus AS family, avg(l_extendedprice) AS est, quantile_cont(l_extendedprice, 0.975) - quantile_cont(l_extendedprice, 0.025) AS width
  FROM lineitem GROUP BY ALL)
SELECT a.term, round(a.est, 4) AS est_main, round(b.est, 4) AS est_alt, round(b.est - a.est, 4) AS shift, round(b.width / a.width, 6) AS width_ratio
FROM f a JOIN f b USING (term) WHERE a.family = 'F' AND b.family = 'O'""")
def d20(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("term"), F.col("l_linestatus").alias("family")).agg(
        F.avg("l_extendedprice").alias("est"), F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    f = f.withColumn("width", F.col("q")[1] - F.col("q")[0])
    g = f.groupBy("term").agg(*[F.max(F.when(F.col("family") == k, F.col(c))).alias(f"{c}_{n}")
                                for k, n in (("F", "main"), ("O", "alt")) for c in ("est", "width")])
    return g.filter("est_main is not null and est_alt is not null").select(
        "term", r6("est_main", "est_main", 4), r6("est_alt", "est_alt", 4),
        r6(F.col("est_alt") - F.col("est_main"), "shift", 4), r6(F.col("width_alt") / F.col("width_main"), "width_ratio"))


@query("d21_key_attach", """
WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), h AS (SELECT o_custkey, count(*) AS m FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
SELECT user_id, c_mktsegment, CAST(n AS BIGINT) AS n_events, CAST(m AS BIGINT) AS n_large_orders FROM e JOIN customer ON user_id = c_custkey LEFT JOIN h ON user_id = o_custkey""")
def d21(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    h = table(spark, sf, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n_large_orders"))
    return e.join(c, "user_id").join(h, "user_id", "left").select("user_id", "c_mktsegment", "n_events", "n_large_orders")


@query("d22_stale_totals", """
WITH mine AS (SELECT o_orderstatus AS stage, count(*) AS n FROM orders GROUP BY 1),
 stored AS (SELECT CASE l_linestatus WHEN 'F' THEN 'F' ELSE 'O' END AS stage, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(m.stage, s.stage) AS stage, CAST(m.n AS BIGINT) AS computed, CAST(s.n AS BIGINT) AS stored,
 CASE WHEN s.n IS NULL THEN 'not stored' WHEN m.n IS NULL THEN 'unverifiable' WHEN m.n <> s.n THEN 'mismatch' ELSE 'ok' END AS state
FROM mine m FULL JOIN stored s ON m.stage = s.stage""")
def d22(spark, sf):
    mine = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count(F.lit(1)).alias("computed"))
    stored = table(spark, sf, "lineitem").groupBy(F.when(F.col("l_linestatus") == "F", "F").otherwise("O").alias("stage")).agg(
        F.countDistinct("l_orderkey").alias("stored"))
    state = (F.when(F.col("stored").isNull(), "not stored").when(F.col("computed").isNull(), "unverifiable")
             .when(F.col("computed") != F.col("stored"), "mismatch").otherwise("ok"))
    return mine.join(stored, "stage", "full_outer").withColumn("state", state)
