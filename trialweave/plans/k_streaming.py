"""Section K: streaming twins of batch operators on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.plans.standins import TRIALS_SQL, markers, r6
from trialweave.plans.d_joins import ASOF_SQL
from trialweave.registry import query, table
from trialweave.streaming import jobs


def _stream(spark, sf):
    return jobs.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def _events(spark, sf, delay="1 hour"):
    return jobs.with_clock(_stream(spark, sf), "ts", delay)


@query("k01_first_row_stream", f"""WITH {TRIALS_SQL} SELECT entity AS user_id, event_type, k, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM trials
QUALIFY row_number() OVER (PARTITION BY entity, event_type, k ORDER BY ts, event_id) = 1""")
def k01(spark, sf):
    e = _stream(spark, sf).withColumn("k", F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).try_cast("int"))
    rows = e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "user_id", "event_type", "k", "value")
    return jobs.run_first_rows(rows, ["user_id", "event_type", "k"], ["ts", "event_id"], "k01")


@query("k02_bin_means_stream", """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bin_start, round(avg(value), 6) AS mean_value, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY ALL""")
def k02(spark, sf):
    out = jobs.run_to_keyed_table(jobs.bin_means(_events(spark, sf), ["event_type"], "ts", "1 day", "value"), ["w", "event_type"], "k02")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("bin_start"), r6("mean_value", "mean_value"), "n")


@query("k03_last_marker_stream", f"""WITH {ASOF_SQL} SELECT recording, seq, code, prop_marker, CAST(pos - prop_marker_pos AS BIGINT) AS lag_us FROM asof_events WHERE code IN (101, 102, 103)""")
def k03(spark, sf):
    m = markers(spark, sf, _stream(spark, sf)).withColumn("code", F.col("code").cast("int"))
    return jobs.run_last_marker(m, "k03")


@query("k04_duration_stream", """SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bin_start, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def k04(spark, sf):
    out = jobs.run_to_keyed_table(jobs.durations(_events(spark, sf), ["user_id", "event_type"], "ts", "1 day"), ["w", "user_id", "event_type"], "k04")
    return out.select("user_id", "event_type", F.col("w.start").cast("timestamp_ntz").alias("bin_start"), "span_us", "n")
