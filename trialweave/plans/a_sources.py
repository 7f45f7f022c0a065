"""Section A: scans, sources and sinks. Spark derives the files from the given tables, then the readers scan them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import design as d
from trialweave.operators.filters import drop_listed
from trialweave.plans.e1_aggregations import CELLS_SQL, cells
from trialweave.plans.standins import MARKERS_SQL, SAMPLES_SQL, TRIALS_SQL, markers, r6, samples, trials
from trialweave.registry import query, table
from trialweave.runtime import pin, scratch_dir
from trialweave.sources import logs as lg
from trialweave.sources import recordings as rd
from trialweave.sources import store as so

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _n(c=None):
    return F.count(F.lit(1)) if c is None else F.count_if(c)


def _write_logs(spark, sf, label):
    """Trial rows as text logs, one folder per session; two sessions use semicolons and lack a column."""
    root = scratch_dir(spark, label)
    t = trials(spark, sf).select("session", "event_id", "entity", F.coalesce("condition", F.lit("undefined")).alias("condition"),
                                 F.coalesce(F.col("correct").cast("string"), F.lit("NA")).alias("correct"), F.col("rt").cast("string").alias("response_time"))
    for sep, sessions, cols in ((",", (2, 3), t.columns), (";", (4, 6), [c for c in t.columns if c != "response_time"])):
        t.filter(F.col("session").isin(*sessions)).select(*cols).write.mode("append").option("header", "true").option("sep", sep).partitionBy("session").csv(root)
    return root


_SESSION = "session=([0-9]+)"


@query("a01_sniffed_log_scan", f"""WITH {TRIALS_SQL} SELECT session, CAST(count(*) AS BIGINT) AS n, CAST(count(condition) AS BIGINT) AS n_condition, CAST(sum(correct) AS BIGINT) AS n_correct,
 CAST(count(CASE WHEN session IN (2, 3) THEN rt END) AS BIGINT) AS n_rt, CAST(sum(event_id) AS BIGINT) AS id_sum FROM trials GROUP BY session""")
def a01(spark, sf):
    raw = lg.read_logs(spark, _write_logs(spark, sf, "logs"))
    x = raw.withColumn("session", F.regexp_extract("_file", _SESSION, 1).cast("int"))
    return x.groupBy("session").agg(_n().alias("n"), F.count("condition").alias("n_condition"), F.sum(F.col("correct").try_cast("int")).alias("n_correct"),
                                    F.count("response_time").alias("n_rt"), F.sum(F.col("event_id").try_cast("bigint")).alias("id_sum"))


@query("a02_fixed_comma_scan", f"""WITH {TRIALS_SQL} SELECT entity, CAST(count(condition) AS BIGINT) AS n_condition, CAST(sum(correct) AS BIGINT) AS n_correct FROM trials WHERE session IN (2, 3) GROUP BY entity""")
def a02(spark, sf):
    root = _write_logs(spark, sf, "logs")
    raw = lg.read_logs(spark, [f"{root}/session=2", f"{root}/session=3"], cols=["entity", "condition", "correct"], delimiter=",")
    return raw.groupBy(F.col("entity").try_cast("bigint").alias("entity")).agg(F.count("condition").alias("n_condition"), F.sum(F.col("correct").try_cast("int")).alias("n_correct"))


@query("a03_log_names", """
WITH n AS (SELECT o_orderkey, 'Session ' || CAST(o_custkey % 5 + 2 AS VARCHAR) || '/' || CASE o_orderstatus WHEN 'F' THEN 'subject-' || CAST(o_custkey AS VARCHAR) || '.csv'
  WHEN 'O' THEN 'Subject-' || CAST(o_custkey AS VARCHAR) || '-Test.csv' ELSE 'notes-' || CAST(o_custkey AS VARCHAR) || '.csv' END AS rel FROM orders)
SELECT coalesce(part, 'unparsed') AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(entity) AS BIGINT) AS n_parsed, CAST(sum(entity) AS BIGINT) AS id_sum, CAST(sum(session) AS BIGINT) AS session_sum FROM (
 SELECT TRY_CAST(nullif(regexp_extract(rel, '(?i)/subject-([0-9]+)(-[a-z]+)?[.]csv$', 1), '') AS BIGINT) AS entity, CAST(regexp_extract(rel, 'Session ([0-9]+)', 1) AS INT) AS session,
 CASE WHEN regexp_matches(rel, '(?i)/subject-[0-9]+(-[a-z]+)?[.]csv$') THEN lower(replace(regexp_extract(rel, '(?i)/subject-([0-9]+)(-[a-z]+)?[.]csv$', 2), '-', '')) END AS part FROM n) GROUP BY 1""")
def a03(spark, sf):
    c = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("subject-"), c, F.lit(".csv"))).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("Subject-"), c, F.lit("-Test.csv"))).otherwise(F.concat(F.lit("notes-"), c, F.lit(".csv")))
    rel = F.concat(F.lit("Session "), (F.col("o_custkey") % 5 + 2).cast("string"), F.lit("/"), name)
    f = lg.log_fields(table(spark, sf, "orders").select(rel.alias("relative")))
    return f.groupBy(F.coalesce("part", F.lit("unparsed")).alias("part")).agg(
        _n().alias("n"), F.count("entity").alias("n_parsed"), F.sum("entity").alias("id_sum"), F.sum("session").alias("session_sum"))


@query("a04_recursive_discovery", "SELECT DISTINCT 'label=' || CAST(label AS VARCHAR) AS record FROM embeddings")
def a04(spark, sf):
    root = scratch_dir(spark, "tree")
    table(spark, sf, "embeddings").select("vec_id", "label").write.partitionBy("label").parquet(root)
    f = lg.list_files(spark, root, r"\.parquet$")
    return f.select(F.regexp_extract("relative", "^([^/]+)/", 1).alias("record")).distinct()


@query("a05_sorted_listing", "SELECT DISTINCT 'S' || CAST(label AS VARCHAR) AS folder FROM embeddings WHERE label IN (1, 3) ORDER BY folder")
def a05(spark, sf):
    root = scratch_dir(spark, "tree")
    table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("S"), "label").alias("folder")).write.partitionBy("folder").parquet(root)
    f = lg.list_files(spark, root).withColumn("folder", F.regexp_extract("relative", "^folder=([^/]+)/", 1))
    return f.filter(F.col("folder").rlike("(?i)^s[13]$")).select("folder").distinct().orderBy("folder")


@query("a06_batch_exports_first", """
WITH b AS (SELECT DISTINCT o_custkey AS entity, o_orderstatus AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), n AS (SELECT DISTINCT o_custkey AS entity, o_orderstatus AS v FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
SELECT * FROM b UNION SELECT * FROM n WHERE entity NOT IN (SELECT entity FROM b)""")
def a06(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("v"), "o_orderpriority")
    first = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return lg.batch_first(o.filter(first).drop("o_orderpriority"), o.filter(~first).drop("o_orderpriority"), "entity")


def _marker_lines(spark, sf):
    m = markers(spark, sf)
    code = F.concat(F.lit("S"), F.lpad(F.col("code").cast("string"), 3, " "))
    line = F.format_string("Mk%d=Stimulus,%s,%d,1,0", F.col("seq") + 1, code, F.floor(F.col("pos") / 2000) + 1)
    noise = F.when(F.col("seq") % 50 == 0, F.concat(F.lit("; comment\n"), line)).otherwise(line)
    return m.select((F.col("recording") % 8).alias("folder"), noise.alias("value"))


@query("a07_marker_scan", f"""WITH {MARKERS_SQL} SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(sum(seq + 1) AS BIGINT) AS seq_sum, CAST(sum(pos // 2000) AS BIGINT) AS position_sum FROM markers GROUP BY code""")
def a07(spark, sf):
    root = scratch_dir(spark, "markers")
    _marker_lines(spark, sf).write.partitionBy("folder").text(root)
    m = rd.read_markers(spark, root, recursiveFileLookup="true")
    return m.groupBy("code").agg(_n().alias("n"), F.sum("seq").alias("seq_sum"), F.sum("position").alias("position_sum"))


@query("a08_header_scan", """
SELECT s_suppkey AS id, CAST(s_suppkey % 4 + 1 AS INT) AS n_channels, 2000.0::DOUBLE AS interval_us, s_suppkey * 600 AS data_points, 'CH_' || s_name AS first_channel, round(s_suppkey % 4 + 1 + 0.5, 3)::DOUBLE AS last_resolution FROM supplier""")
def a08(spark, sf):
    k = F.col("s_suppkey")
    chans = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(
        F.lit("Ch"), i.cast("string"), F.lit("="), F.when(i == 1, F.concat(F.lit("CH_"), "s_name")).otherwise("x"), F.lit(",,"), (i + 0.5).cast("string"), F.lit(",µV"))), "\n")
    body = F.concat(F.lit("Header\n[Common Infos]\nDataFile=d.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels="), (k % 4 + 1).cast("string"), F.lit("\nSamplingInterval=2000\nDataPoints="),
                    (k * 600).cast("string"), F.lit("\n[Channel Infos]\n"), chans, F.lit("\n[Comment]\nNumberOfChannels=99\n"))
    h = rd.header_fields(table(spark, sf, "supplier").select(k.alias("id"), body.alias("value")))
    return h.select("id", "n_channels", "interval_us", "data_points", F.col("channels")[0].alias("first_channel"), F.element_at("resolutions", -1).alias("last_resolution"))


@query("a09_ascii_signal_scan", """
WITH v AS (SELECT label, i, round(embedding[i]::DOUBLE, 5) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT 'c' || CAST((i - 1) // 16 AS VARCHAR) AS sensor, CAST(-100 + ((i - 1) % 8) * 2 AS INT) AS time_ms, CAST(count(*) AS BIGINT) AS n, round(sum(x), 5) AS total FROM v GROUP BY ALL""")
def a09(spark, sf):
    root = scratch_dir(spark, "ascii")
    e = table(spark, sf, "embeddings").select("label", "embedding")
    # four sensors of sixteen samples per vector: two trials of eight samples on one line
    number = lambda x: F.replace(F.format_string("%.5f", x.cast("double")), F.lit("."), F.lit(","))
    lines = e.select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.slice("embedding", c * 16 + 1, F.lit(16)), number))).alias("c", "v"))
    lines.select("label", F.concat(F.lit("c"), F.col("c").cast("string"), F.lit(" "), F.array_join("v", " ")).alias("value")).write.partitionBy("label").text(root)
    s = rd.ascii_samples(spark.read.text(root).select("value"), 8, -100, 2)
    return s.groupBy("sensor", F.col("time_ms").cast("int").alias("time_ms")).agg(_n().alias("n"), F.round(F.sum("amplitude"), 5).alias("total"))


@query("a10_binary_recording", """
WITH v AS (SELECT vec_id, (i - 1) % 8 AS c, embedding[i]::DOUBLE * ((i - 1) % 8 + 1) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT vec_id, CAST(c AS INT) AS channel, round(sum(x), 4) AS total, CAST(count(*) AS INT) AS n_samples FROM v GROUP BY ALL""")
def a10(spark, sf):
    # the bytes of a multiplexed float32 recording: each vector is 8 samples of 8 channels
    def pack(batches):
        import numpy as np

        for pdf in batches:
            yield pdf[["vec_id"]].assign(content=[np.asarray(v, dtype="<f4").tobytes() for v in pdf["embedding"]])

    raw = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "vec_id bigint, content binary")
    out = rd.decode_multiplexed(raw, "vec_id", "content", [float(i) for i in range(1, 9)])
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "channel", r6(total, "total", 4), F.size("samples").alias("n_samples"))


# signups are logged without their last two fields; the record that ends the file of an even part was cut in transfer;
# views carry a quoted line break, and a quoted comma, in their last field
@query("a11_truncated_records", """
WITH e AS (SELECT *, event_id % 8 AS part, event_id = max(event_id) OVER (PARTITION BY event_id % 8) AS ends FROM events),
s AS (SELECT *, event_type = 'signup' OR (ends AND part % 2 = 0) AS short FROM e)
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(count(*) FILTER (short AND ends) AS BIGINT) AS n_cut, CAST(count(*) FILTER (short AND NOT ends) AS BIGINT) AS n_padded,
 CAST(sum(event_id) FILTER (NOT (short AND ends)) AS BIGINT) AS id_sum, CAST(count(*) FILTER (NOT short) AS BIGINT) AS n_typed, CAST(count(*) FILTER (NOT short AND event_type = 'view') AS BIGINT) AS n_broken FROM s""")
def a11(spark, sf):
    root = scratch_dir(spark, "cut")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 8).alias("part"))
    ends = e.groupBy("part").agg(F.max("event_id").alias("event_id")).filter("part % 2 = 0").withColumn("ends", F.lit(True))
    e = e.join(ends, ["part", "event_id"], "left")
    last = F.when(F.col("event_type") == "view", F.lit('"vi\new, ""twice"""')).otherwise(F.col("event_type"))
    whole = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), last)
    value = F.when((F.col("event_type") == "signup") | F.col("ends"), F.col("event_id").cast("string")).otherwise(whole)
    e.select("event_id", "part", value.alias("value")).repartition(8, "part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(root)
    good, note = lg.read_truncated(spark, root, "event_id bigint, user_id bigint, event_type string")
    broken = F.count_if(F.col("event_type") == F.lit('vi\new, "twice"')).alias("n_broken")
    return good.agg(F.sum("event_id").alias("id_sum"), F.count("event_type").alias("n_typed"), broken).crossJoin(note.agg(*[F.sum(c).alias(c) for c in ("n_records", "n_padded", "n_cut")]))


@query("a12_header_patterns", "SELECT c_custkey AS id, c_acctbal AS score, c_mktsegment AS grp FROM customer")
def a12(spark, sf):
    c = lg.locate_columns(table(spark, sf, "customer"), {"id": "custkey$", "score": "^c_acct", "grp": "SEGMENT"})
    # the same rows as a headless sheet: an item row with a line break, a label row, then the data
    sheet = c.select(F.lit(3).alias("row"), F.col("id").cast("string").alias("c1"), F.col("score").cast("string").alias("c2"), F.col("grp").alias("c3"))
    heads = spark.createDataFrame([(1, "Participant\nID", "Score", "Group"), (2, None, "Language 1", "Segment")], sheet.schema)
    layout = {(1, "c1"): "Participant ID", (1, "c3"): "Group", (2, "c2"): "^Language [1-4]$"}
    rows = lg.check_layout(heads.unionByName(sheet), "row", layout).where("row > 2")
    return rows.select(F.col("c1").cast("bigint").alias("id"), F.col("c2").cast("double").alias("score"), F.col("c3").alias("grp"))


_ROSTER_SQL = """
ro AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE c_custkey END AS entity, 'H' || CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS home, CASE c_mktsegment WHEN 'BUILDING' THEN 'Mini-English' WHEN 'MACHINERY' THEN 'Mini-Norwegian' WHEN 'FURNITURE' THEN '' ELSE
  CASE WHEN c_custkey % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END END AS grp FROM customer)"""


@query("a13_roster_constraints", f"""WITH {_ROSTER_SQL}
SELECT 'id without group' AS check_name, CAST(count(*) AS BIGINT) AS n FROM ro WHERE entity IS NOT NULL AND grp = '' UNION ALL SELECT 'group without id', CAST(count(*) AS BIGINT) FROM ro WHERE entity IS NULL AND grp <> ''
UNION ALL SELECT 'parity mismatch', CAST(count(*) AS BIGINT) FROM ro WHERE entity IS NOT NULL AND grp <> '' AND grp <> CASE WHEN entity % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END
UNION ALL SELECT 'duplicate home', CAST(count(*) AS BIGINT) FROM (SELECT home FROM ro GROUP BY home HAVING count(*) > 1)""")
def a13(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    raw = table(spark, sf, "customer").select(
        F.when(k % 50 != 7, k).cast("string").alias("entity"), F.concat(F.lit("H"), F.bround("c_acctbal", 0).cast("bigint").cast("string")).alias("home"),
        F.when(seg == "BUILDING", d.GROUP_ODD).when(seg == "MACHINERY", d.GROUP_EVEN).when(seg == "FURNITURE", "").otherwise(d.group_from_parity(k)).alias("grp"))
    _, bad = so.roster(raw, ["home"], "entity", "grp")
    return bad.groupBy("check_name").agg(_n().alias("n"))


@query("a14_schema_checked_read", "SELECT o_orderstatus AS level, CAST(count(*) AS BIGINT) AS n, TRUE AS has_schema, FALSE AS has_other FROM orders GROUP BY 1")
def a14(spark, sf):
    path = f"{sf}/orders.parquet"
    df = so.read_if(spark, path, ["o_orderkey", "o_orderstatus"])
    other = so.read_if(spark, path, ["o_orderkey", "absent_column"])
    return df.groupBy(F.col("o_orderstatus").alias("level")).agg(_n().alias("n")).select("level", "n", F.lit(df is not None).alias("has_schema"), F.lit(other is not None).alias("has_other"))


@query("a15_legacy_counts", """
WITH k(label, key) AS (VALUES ('ECONOMY', 'gender'), ('STANDARD', 'agreement'), ('PROMO', 'marking'))
SELECT p_type AS label, coalesce(key, 'unknown') AS key, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p_size NOT BETWEEN 1 AND 45) AS BIGINT) AS n_outside FROM part LEFT JOIN k ON p_type = label GROUP BY ALL""")
def a15(spark, sf):
    keys = spark.createDataFrame([("ECONOMY", "gender"), ("STANDARD", "agreement"), ("PROMO", "marking")], "label string, key string")
    p = table(spark, sf, "part").withColumnRenamed("p_type", "label").join(F.broadcast(keys), "label", "left")
    return p.groupBy("label", F.coalesce("key", F.lit("unknown")).alias("key")).agg(_n().alias("n"), _n(~F.col("p_size").between(1, 45)).alias("n_outside"))


@query("a16_cell_files", f"""WITH {CELLS_SQL}, w(win) AS (VALUES ('w1'), ('w2')),
fi AS (SELECT win, entity, session, property, condition, n_trials FROM cells, w WHERE win = 'w1' OR n_trials > 1),
tr AS (SELECT *, count(*) AS c FROM fi GROUP BY ALL),
df AS (SELECT count(*) AS n FROM (SELECT entity, session, property, condition, n_trials, c, count(*) AS files FROM tr GROUP BY ALL HAVING count(*) < (SELECT count(DISTINCT win) FROM tr)))
SELECT win, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_repeated, (SELECT n = 0 FROM df) AS files_agree, (SELECT count(DISTINCT win) = 2 FROM tr) AS all_present FROM tr GROUP BY win""")
def a16(spark, sf):
    root = scratch_dir(spark, "cells")
    c = cells(spark, sf)
    both = c.withColumn("win", F.explode(F.when(F.col("n_trials") > 1, F.array(F.lit("w1"), F.lit("w2"))).otherwise(F.array(F.lit("w1")))))
    so.write_cells(both, root, sf, ["win"])
    return so.cell_set_checks(spark.read.parquet(root), ["win"], ["entity", "session", "property", "condition", "n_trials"], 2)


@query("a17_event_arrays", "SELECT label, CAST(count(*) AS BIGINT) AS n_epochs, CAST(sum(len(embedding)) AS BIGINT) AS n_values, round(sum(embedding[10]::DOUBLE), 5) AS tenth FROM embeddings GROUP BY label")
def a17(spark, sf):
    root = scratch_dir(spark, "epochs")
    table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("epoch")).write.partitionBy("label").parquet(root)
    e = spark.read.parquet(root)
    return e.groupBy("label").agg(_n().alias("n_epochs"), F.sum(F.size("epoch")).alias("n_values"), F.round(F.sum(F.element_at("epoch", 10)), 5).alias("tenth"))


# A configured exclusion list of entities.
LISTED = (3, 7, 14, 48, 53)


@query("a18_configured_list", f"WITH {SAMPLES_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n FROM samples WHERE entity NOT IN {LISTED} OR source = 'overlay' GROUP BY source")
def a18(spark, sf):
    listed = spark.createDataFrame([(x,) for x in LISTED], "entity bigint")
    return drop_listed(samples(spark, sf).select("entity", "source"), listed, ["entity"]).groupBy("source").agg(_n().alias("n"))


@query("a19_overlay_rows", """
WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice * 2, 2) AS v FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
SELECT 'overlay' AS source, CAST(count(*) AS BIGINT) AS n, round(sum(v), 2) AS total FROM o UNION ALL SELECT 'legacy', CAST(count(*) AS BIGINT), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM o)""")
def a19(spark, sf):
    o = table(spark, sf, "orders")
    flagged = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    legacy = o.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"))
    overlay = o.join(flagged, "o_custkey", "left_semi").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("v"))
    return so.overlay_rows(legacy, overlay, ["o_custkey"]).groupBy("source").agg(_n().alias("n"), F.round(F.sum("v"), 2).alias("total"))


# one overlay file per supplier; files of suppliers in debt have one byte changed after the manifest was written, the first
# nation's never arrived, and the last nation's are not listed
_OVERLAY_SQL = """
su AS (SELECT s.*, n_nationkey = (SELECT min(n_nationkey) FROM nation) AS lost, n_nationkey = (SELECT max(n_nationkey) FROM nation) AS unlisted, 'r' || CAST(s_nationkey AS VARCHAR) AS record FROM supplier s JOIN nation ON s_nationkey = n_nationkey),
lg AS (SELECT s_name AS stem, record FROM su),
mf AS (SELECT s_name AS stem, record, CASE WHEN s_acctbal > 9000 THEN 'other' WHEN s_acctbal > 6000 THEN 'markers_rebuilt' ELSE 'reprocessed' END AS kind, CASE WHEN s_acctbal BETWEEN 4000 AND 5000 THEN 'fail' ELSE 'pass' END AS status,
  sha256(s_name || ' ' || s_suppkey || chr(10)) AS sha FROM su WHERE NOT unlisted),
dk AS (SELECT s_name AS stem, sha256(s_name || CASE WHEN s_acctbal < 0 THEN '_' ELSE ' ' END || s_suppkey || chr(10)) AS sha FROM su WHERE NOT lost),
sc AS (SELECT DISTINCT 'r' || CAST(s_nationkey AS VARCHAR) AS record FROM supplier WHERE s_acctbal > 8000), rp AS (SELECT * FROM mf WHERE kind = 'reprocessed')"""


@query("a20_overlay_admission", f"""WITH {_OVERLAY_SQL},
v AS (SELECT 'not passing' AS rule, stem FROM mf WHERE status <> 'pass' UNION ALL SELECT 'not in the manifest', stem FROM dk ANTI JOIN mf USING (stem) UNION ALL SELECT 'not on disk', stem FROM mf ANTI JOIN dk USING (stem)
 UNION ALL SELECT 'hash differs', mf.stem FROM mf JOIN dk USING (stem) WHERE mf.sha <> dk.sha UNION ALL SELECT 'unknown kind', stem FROM mf WHERE kind = 'other' UNION ALL SELECT 'out of scope', stem FROM rp WHERE record NOT IN (SELECT record FROM sc)
 UNION ALL SELECT 'record incomplete', stem FROM lg WHERE record IN (SELECT record FROM rp) AND stem NOT IN (SELECT stem FROM rp))
SELECT rule, stem FROM v""")
def a20(spark, sf):
    nations = table(spark, sf, "nation").agg(F.min("n_nationkey").alias("lost"), F.max("n_nationkey").alias("unlisted"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(nations))  # one row
    debt = F.col("s_acctbal") < 0
    body = lambda gap: F.concat("s_name", gap, F.col("s_suppkey").cast("string"))
    root = scratch_dir(spark, "overlay")
    bodies = s.where("s_nationkey <> lost").select("s_name", body(F.when(debt, F.lit("_")).otherwise(F.lit(" "))).alias("value"))
    # a file costs far more than its few bytes: a given number of tasks is not merged by size, and grows with the files
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bodies.count() // 200))
    bodies.repartition(tasks, "s_name").write.partitionBy("s_name").text(root)
    stem = F.regexp_extract(F.url_decode("file"), "s_name=([^/]*)", 1)
    disk = pin(so.disk_hashes(spark, root).where(F.col("file").endswith(".txt")).withColumn("file", stem))  # files are read once, compared four times
    record = F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("record")
    legacy = s.select(F.col("s_name").alias("file"), record)
    kind = F.when(F.col("s_acctbal") > 9000, "other").when(F.col("s_acctbal") > 6000, "markers_rebuilt").otherwise("reprocessed")
    status = F.when(F.col("s_acctbal").between(4000, 5000), "fail").otherwise("pass")
    written = F.sha2(F.encode(F.concat(body(F.lit(" ")), F.lit("\n")), "UTF-8"), 256)
    manifest = s.where("s_nationkey <> unlisted").select(F.col("s_name").alias("file"), record, kind.alias("kind"), status.alias("status"), F.lit("as_legacy").alias("conventions"), written.alias("sha256"))
    scope = s.where("s_acctbal > 8000").select(record).distinct()
    return so.overlay_violations(manifest, disk, legacy, scope).select("rule", F.col("file").alias("stem"))


@query("a21_content_manifest", """
SELECT doc_id, sha1('blob '::BLOB || CAST(octet_length(encode(text)) AS VARCHAR)::BLOB || '\\x00'::BLOB || encode(text)) AS blob, CASE WHEN lang = 'de' THEN 'differs' ELSE 'ok' END AS state FROM documents""")
def a21(spark, sf):
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), "lang")
    manifest = t.select("path", so.git_blob_id(F.col("content")).alias("blob"))
    # the copy: German files lost a byte, French ones gained carriage returns
    cr = F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("\r\n")), "UTF-8")
    copy = t.select("path", F.when(F.col("lang") == "de", F.concat("content", F.unhex(F.lit("20")))).when(F.col("lang") == "fr", cr).otherwise(F.col("content")).alias("content"))
    state = so.verify_manifest(manifest, copy)
    return manifest.join(state, "path").select(F.col("path").alias("doc_id"), "blob", "state")


@query("a22_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a22(spark, sf):
    path = so.write_csv(table(spark, sf, "nation"), scratch_dir(spark, "csv"), sf)
    return spark.read.option("header", "true").schema("n_nationkey int, n_name string, n_regionkey int").csv(path)


@query("a23_partitioned_cells", f"WITH {CELLS_SQL} SELECT property, session, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(n_trials) AS BIGINT) AS n_trials FROM cells GROUP BY ALL")
def a23(spark, sf):
    path = so.write_cells(cells(spark, sf), scratch_dir(spark, "cells"), sf, ["property", "session"])
    return spark.read.parquet(path).groupBy("property", "session").agg(_n().alias("n_cells"), F.sum("n_trials").alias("n_trials"))


@query("a24_variant_outputs", "SELECT 'main' AS variant, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'screened', CAST(count(*) AS BIGINT) FROM supplier WHERE s_acctbal > 0")
def a24(spark, sf):
    s, path = table(spark, sf, "supplier"), scratch_dir(spark, "variants")
    so.write_variant(s, path, sf, "main")
    so.write_variant(s, path, sf, "screened")
    so.write_variant(s.filter("s_acctbal > 0"), path, sf, "screened")  # replaces only its own partition
    return spark.read.parquet(path).groupBy("variant").agg(_n().alias("n"))


@query("a25_write_guard", "SELECT TRUE AS refused_inside, TRUE AS allowed_outside, CAST(count(*) AS BIGINT) AS n FROM region")
def a25(spark, sf):
    def refused(path):
        try:
            so.guard_output(path, sf)
        except ValueError:
            return True
        return False

    return table(spark, sf, "region").agg(F.lit(refused(f"{sf}/x/../out")).alias("refused_inside"), F.lit(not refused(scratch_dir(spark, "out"))).alias("allowed_outside"), _n().alias("n"))


@query("a28_table_profile", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in _TABLES) + """)
SELECT table_name, column_name, CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string'
 WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' WHEN data_type = 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS class, n_rows, CASE WHEN table_name IN ('part', 'pages') THEN 'starts with p' WHEN table_name = 'lineitem' THEN 'order lines' ELSE 'any table' END AS description
FROM c JOIN (SELECT table_name, column_name, data_type FROM information_schema.columns) USING (table_name)""")
def a28(spark, sf):
    p = so.profile({t: table(spark, sf, t) for t in _TABLES}, [(".*", "any table"), ("p.*s?", "starts with p"), ("line.*em", "order lines")])
    return p.select("table_name", "column_name", "class", "n_rows", "description")


# one export per supplier, property and condition, cut into a header, marker lines and value lines of SEG values a trial
_SEG = 4
_EXPORT_SQL = """
ex AS (SELECT l_suppkey AS pid, 1 + l_linenumber % 3 AS prop, 1 + l_partkey % 3 AS cond, count(*) AS n, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS odd, min(l_shipdate) AS d0, count(DISTINCT 110 + l_partkey % 140) AS codes,
  count(*) - count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS marked, count(*) FILTER (l_discount = 0.1) AS wrong FROM lineitem GROUP BY ALL)"""


def _exports(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pid"), (1 + F.col("l_linenumber") % 3).alias("prop"), (1 + F.col("l_partkey") % 3).alias("cond"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
        (110 + F.col("l_partkey") % 140).alias("sentence"), (F.col("l_quantity") > 45).alias("odd"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("bare"), (F.col("l_discount") == 0.1).alias("wrong"))
    return li.withColumn("stem", F.concat(F.col("pid").cast("string"), F.lit("_trialbytrial_S"), F.col("prop").cast("string"), F.lit("_S10"), F.col("cond").cast("string")))


@query("a29_export_inventory", f"""WITH {_EXPORT_SQL}
SELECT CAST(pid AS VARCHAR) || '_trialbytrial_S' || prop || '_S10' || cond AS stem, 1 AS has_txt, CASE WHEN odd = 0 THEN 0 ELSE 1 END AS has_vhdr, 1 AS has_vmrk, odd > 0 AS complete,
 CASE WHEN odd > 0 THEN (n + odd % 2)::DOUBLE END AS n_seg_vhdr, CAST(n AS BIGINT) AS n_newseg, n::DOUBLE AS n_seg_txt, coalesce(odd % 2 = 0 AND odd > 0, false) AS counts_agree,
 CAST(n AS BIGINT) AS sentence_lines, CAST(codes AS BIGINT) AS distinct_codes, CAST(n AS BIGINT) AS segs_one_sentence, CAST(n - wrong AS BIGINT) AS segs_one_cond, CAST(marked AS BIGINT) AS segs_one_time0, CAST(wrong AS BIGINT) AS wrong_cond FROM ex""")
def a29(spark, sf):
    e = _exports(spark, sf)
    per = pin(e.groupBy("stem", "cond").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("odd")))  # read three times
    points = (F.col("n") + F.col("odd") % 2) * _SEG  # a header may promise one segment more than was written
    headers = per.where("odd > 0").select("stem", F.concat(F.lit("NumberOfChannels=2\nDataPoints="), points.cast("string"), F.lit(f"\nSegmentDataPoints={_SEG}\n")).alias("value"))
    values = per.select("stem", F.explode(F.array(F.lit("Fz"), F.lit("Cz"))).alias("sensor"), "n").select("stem", F.concat(F.col("sensor"), F.repeat(F.lit(" 1,5"), (F.col("n") * _SEG).cast("int"))).alias("value"))
    s = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), 3, " "))
    wrong = F.when(F.col("wrong"), s(101 + F.col("cond") % 3)).otherwise(s(100 + F.col("cond")))
    at = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    lines = [("New Segment", F.lit("")), ("Stimulus", s(F.col("sentence"))), ("Stimulus", wrong), ("Time 0", F.when(~F.col("bare"), F.lit("")))]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(lines)])
    marks = e.select("stem", "cond", *at, F.explode(rows).alias("m")).where("m.text IS NOT NULL")
    marks = marks.select("stem", F.struct(*at, "m.i").alias("line"), F.concat(F.lit("Mk1="), F.col("m.kind"), F.lit(","), F.col("m.text"), F.lit(",1,1,0")).alias("value"))
    wanted = per.select("stem", (100 + F.col("cond")).cast("int").alias("cond_code"))
    return rd.export_inventory(values, headers, marks, wanted, _SEG)


@query("a29_near_names", f"""WITH {_EXPORT_SQL},
kn AS (SELECT CAST(pid AS VARCHAR) || '_trialbytrial_S' || prop || '_S10' || cond || '.vmrk' AS name FROM ex),
st AS (SELECT *, CAST(pid AS VARCHAR) || '_trialbytrial_S' || prop || '_S10' || cond AS stem FROM ex),
ns AS (SELECT replace(stem, 'by', 'yb') || '.vmrk' AS name FROM st WHERE odd = 0 UNION SELECT replace(stem, '_S10', 'S10') || '.vmrk' FROM st WHERE odd = 1 UNION SELECT stem || '.vmrk.bak' FROM st WHERE odd = 2 UNION SELECT replace(stem, 'trialby', 'trialx') || '.vmrk' FROM st WHERE odd = 3)
SELECT ns.name, kn.name AS near, CAST(levenshtein(ns.name, kn.name) AS INT) AS edits FROM ns JOIN kn ON levenshtein(ns.name, kn.name) <= 2""")
def a29b(spark, sf):
    per = _exports(spark, sf).groupBy("stem").agg(F.count_if("odd").alias("odd"))
    name = lambda c: F.concat(c, F.lit(".vmrk"))
    stem = F.col("stem")
    strange = F.when(F.col("odd") == 0, name(F.replace(stem, F.lit("by"), F.lit("yb")))).when(F.col("odd") == 1, name(F.replace(stem, F.lit("_S10"), F.lit("S10")))) \
        .when(F.col("odd") == 2, F.concat(stem, F.lit(".vmrk.bak"))).when(F.col("odd") == 3, name(F.replace(stem, F.lit("trialby"), F.lit("trialx"))))
    return rd.near_names(per.select(strange.alias("name")).where("name IS NOT NULL"), per.select(name(stem).alias("name")))
