"""How the study's notions meet the given tables, as Spark frames and as matching SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.functions import design as d
from trialweave.registry import table

# --- judgement trials: one row per event -------------------------------------------------
TRIALS_SQL = """
trials AS (
  SELECT event_id, ts, user_id AS entity, event_type, value, k,
         CASE least((CAST(date_part('day', ts) AS INT) - 1) // 8, 3)
              WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS session,
         CASE k % 3 WHEN 0 THEN 'gender' WHEN 1 THEN 'agreement' WHEN 2 THEN 'marking' END AS property,
         CASE WHEN event_type IN ('click', 'view') THEN 'Grammatical'
              WHEN event_type IN ('purchase', 'error') THEN 'Ungrammatical' END AS condition,
         CASE WHEN k >= 90 THEN NULL WHEN k >= 30 THEN 1 WHEN k >= 0 THEN 0 END AS correct,
         value * 50 AS rt,
         CASE WHEN user_id % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END AS grp
  FROM (SELECT *, CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS INT) AS k FROM events)
)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn(
        "k", F.nullif(F.regexp_extract("props", '"k": *(-?[0-9]+)', 1), F.lit("")).try_cast("int")
    )
    slot = F.least(F.floor((F.dayofmonth("ts") - 1) / 8).cast("int"), F.lit(3))
    return e.select(
        "event_id", "ts", F.col("user_id").alias("entity"), "event_type", "value", "k",
        F.element_at(F.array(*[F.lit(s) for s in d.SESSIONS]), slot + 1).alias("session"),
        F.when(F.col("k") % 3 == 0, "gender").when(F.col("k") % 3 == 1, "agreement")
        .when(F.col("k") % 3 == 2, "marking").alias("property"),
        F.when(F.col("event_type").isin("click", "view"), d.CONTROL)
        .when(F.col("event_type").isin("purchase", "error"), d.VIOLATION).alias("condition"),
        F.when(F.col("k") >= 90, None).when(F.col("k") >= 30, 1).when(F.col("k") >= 0, 0).alias("correct"),
        (F.col("value") * 50).alias("rt"),
        d.group_from_parity(F.col("user_id")).alias("grp"),
    )


# --- long sample series: one row per line item ------------------------------------------
SAMPLES_SQL = """
samples AS (
  SELECT l_suppkey AS entity,
         CASE l_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS session,
         CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_orderkey // 4 % 2 = 0) THEN 'Grammatical' ELSE 'Ungrammatical' END AS condition,
         CASE WHEN l_quantity <= 25 THEN 'm1' ELSE 'm2' END AS marker,
         'c' || CAST(l_linenumber AS VARCHAR) AS sensor,
         CASE WHEN l_linenumber <= 3 THEN 'midline anterior' WHEN l_linenumber <= 5 THEN 'midline medial'
              ELSE 'midline posterior' END AS region,
         (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) % 600) * 2 - 100 AS time_ms,
         l_extendedprice / 997 AS amplitude,
         CASE l_linestatus WHEN 'O' THEN 'overlay' ELSE 'legacy' END AS source
  FROM lineitem
)"""
WINDOWS_SQL = """
windows(window_name, min_ms, max_ms) AS (VALUES ('200_500', 200, 498), ('300_600', 300, 598), ('400_900', 400, 898))"""
TRIAL_KEY = ["entity", "session", "condition", "marker"]
N_REGIONS = 3


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    control = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.floor(F.col("l_orderkey") / 4) % 2 == 0))
    line = F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("entity"),
        F.element_at(F.array(*[F.lit(s) for s in d.SESSIONS]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("session"),
        F.when(control, d.CONTROL).otherwise(d.VIOLATION).alias("condition"),
        F.when(F.col("l_quantity") <= 25, "m1").otherwise("m2").alias("marker"),
        F.concat(F.lit("c"), line.cast("string")).alias("sensor"),
        F.when(line <= 3, "midline anterior").when(line <= 5, "midline medial").otherwise("midline posterior").alias("region"),
        ((F.datediff("l_shipdate", F.lit("1995-01-01")) % 600) * 2 - 100).alias("time_ms"),
        (F.col("l_extendedprice") / 997).alias("amplitude"),
        F.when(F.col("l_linestatus") == "O", "overlay").otherwise("legacy").alias("source"),
    )


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(d.WINDOWS), "window_name string, min_ms int, max_ms int")


# --- marker stream: one recording per user, codes from the event type and k --------------
MARKERS_SQL = """
markers AS (
  SELECT user_id AS recording, event_id AS seq, epoch_us(ts) AS pos,
         CASE event_type WHEN 'signup' THEN 5 + (k % 4)
                         WHEN 'view' THEN 1 + (k % 3)
                         WHEN 'click' THEN 40 + (k % 60)
                         WHEN 'error' THEN 110 + k
                         WHEN 'purchase' THEN 101 + (k % 3) END AS code
  FROM (SELECT *, CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS INT) AS k FROM events)
)"""


def markers(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    t = (table(spark, sf_dir, "events") if events is None else events).withColumn(
        "k", F.nullif(F.regexp_extract("props", '"k": *(-?[0-9]+)', 1), F.lit("")).try_cast("int")
    )
    k, et = F.col("k"), F.col("event_type")
    return t.select(
        F.col("user_id").alias("recording"), F.col("event_id").alias("seq"),
        d.micros(F.col("ts")).alias("pos"),
        F.when(et == "signup", 5 + k % 4).when(et == "view", 1 + k % 3).when(et == "click", 40 + k % 60)
        .when(et == "error", 110 + k).when(et == "purchase", 101 + k % 3).alias("code"),
    )


# --- patterns: 64 numbers per vector = 8 time bins x 8 channels --------------------------
N_CHANNELS = 8
N_BINS = 8
PATTERNS_SQL = """
patterns AS (
  SELECT vec_id AS trial, vec_id // 25 AS entity,
         CASE (label // 2) % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS session,
         CASE WHEN (vec_id // 25) % 2 = 1 THEN 'Mini-English' ELSE 'Mini-Norwegian' END AS grp,
         label % 2 AS y, embedding FROM embeddings
)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial and time bin with the channel vector."""
    e = table(spark, sf_dir, "embeddings")
    entity = F.floor(F.col("vec_id") / 25).cast("bigint")
    base = e.select(
        F.col("vec_id").alias("trial"), entity.alias("entity"),
        F.element_at(F.array(*[F.lit(s) for s in d.SESSIONS]), (F.floor(F.col("label") / 2) % 4 + 1).cast("int")).alias("session"),
        d.group_from_parity(entity).alias("grp"), (F.col("label") % 2).alias("y"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    bins = F.transform(
        F.sequence(F.lit(0), F.lit(N_BINS - 1)), lambda b: F.slice(F.col("embedding"), b * N_CHANNELS + 1, N_CHANNELS)
    )
    return base.select("trial", "entity", "session", "grp", "y", F.posexplode(bins).alias("time_bin", "pattern"))


# --- posterior draws: one parameter value per draw ---------------------------------------
# The model terms the draws carry, in the order of the first eight vector slots.
TERMS = (
    "b_Intercept", "b_z_recoded_grammaticality", "b_z_recoded_session", "b_z_recoded_mini_language",
    "b_z_recoded_grammaticality:z_recoded_session", "b_z_recoded_mini_language:z_recoded_grammaticality",
    "b_z_recoded_session:z_recoded_mini_language",
    "b_z_recoded_session:z_recoded_grammaticality:z_recoded_mini_language",
)
_term_case = " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(TERMS))
DRAWS_SQL = f"""
draws AS (
  SELECT 'm' || CAST(label AS VARCHAR) AS model, vec_id % 4 AS chain, vec_id // 4 * 8 + g AS iter,
         CASE i {_term_case} END AS parameter, CAST(embedding[g * 8 + i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(0, 8)) AS g)
)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # one vector holds eight draws of eight terms
    pairs = F.array(*[
        F.struct(F.lit(g).alias("g"), F.lit(t).alias("parameter"), F.element_at(F.col("embedding"), g * 8 + i + 1).cast("double").alias("value"))
        for g in range(8) for i, t in enumerate(TERMS)
    ])
    return e.select(
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), (F.col("vec_id") % 4).alias("chain"),
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("iter"), F.explode(pairs).alias("p"),
    ).select("model", "chain", (F.col("iter") * 8 + F.col("p.g")).alias("iter"), "p.parameter", "p.value")


def draws_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), (F.col("vec_id") % 4).alias("chain"),
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("iter"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"), "embedding",
    ).select(
        "model", "chain", (F.col("iter") * 8 + F.col("g")).alias("iter"),
        *[F.element_at(F.col("embedding"), F.col("g") * 8 + i + 1).cast("double").alias(t) for i, t in enumerate(TERMS)],
    )


def r6(col, name: str | None = None, digits: int = 6):
    c = F.round(col, digits)
    return c.alias(name) if name else c
