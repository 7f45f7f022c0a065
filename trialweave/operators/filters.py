"""Row filters: validity, response-time rule, exclusion lists, completeness, cell floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialweave.functions import design as d
from trialweave.operators.recode import require_columns
from trialweave.operators.skew import null_safe_join, small_side, with_group_stats


def valid_trials(df: DataFrame) -> DataFrame:
    """Known property and condition, outcome 0 or 1."""
    known = F.col("condition").isin(d.CONTROL, d.VIOLATION) & F.col("property").isNotNull()
    return df.filter(F.coalesce(known & F.col("correct").isin(0, 1), F.lit(False)))


def finite_positive(col: Column) -> Column:
    return F.coalesce(~F.isnan(col) & (col > 0) & (col < float("inf")), F.lit(False))


def rt_rule(df: DataFrame, rt: str, screen: bool) -> DataFrame:
    """Finite and positive, or the open interval of the screen."""
    x = F.col(rt)
    lo, hi = d.RT_SCREEN_MS
    return df.filter(finite_positive(x) & ((x > lo) & (x < hi) if screen else F.lit(True)))


def rt_band(rt: Column) -> Column:
    lo, hi = d.RT_SCREEN_MS
    return F.when(~finite_positive(rt), "no_time").when(rt <= lo, "fast").when(rt >= hi, "slow").otherwise("kept")


def in_windows(df: DataFrame, windows: DataFrame, time: str = "time_ms") -> DataFrame:
    """One row per sample and window; windows overlap, so a sample may appear several times."""
    cond = F.col(time).between(F.col("min_ms"), F.col("max_ms"))
    return df.join(F.broadcast(windows), cond).drop("min_ms", "max_ms")


def drop_listed(df: DataFrame, listed: DataFrame, keys: list[str], source: str = "source",
                also_overlay: bool = False) -> DataFrame:
    """Exclusion list: listed legacy rows always go, listed overlay rows only under the switch."""
    require_columns(df, keys)
    marks = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    out = null_safe_join(df, small_side(marks), keys)
    gone = F.coalesce(F.col("_listed"), F.lit(False))
    if not also_overlay and source in df.columns:
        gone = gone & (F.coalesce(F.col(source), F.lit("legacy")) != "overlay")
    return out.filter(~gone).drop("_listed")


def complete_units(df: DataFrame, unit: list[str], value: str, n_expected: int) -> DataFrame:
    """Rows of units whose every expected cell is observed."""
    full = df.groupBy(*unit).agg(F.count(value).alias("_n")).filter(F.col("_n") == n_expected).drop("_n")
    return df.join(full, unit, "left_semi")


def common_sensors(df: DataFrame, sensor: str, session: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sensors recorded in every contributing session."""
    seen = df.select(sensor, session).distinct()
    per = seen.groupBy(sensor).agg(F.count(F.lit(1)).alias("_n"))
    total = seen.agg(F.countDistinct(session).alias("_t"))
    keep = per.crossJoin(F.broadcast(total)).filter((F.col("_n") == F.col("_t")) & ~F.col(sensor).isin(*skip) if skip
                                                   else F.col("_n") == F.col("_t"))
    return df.join(keep.select(sensor), sensor, "left_semi")


def minimum_cells(df: DataFrame, cell: list[str], entity: str, min_rows: int, min_entities: int) -> DataFrame:
    """Cells that pass both floors, with their counts."""
    g = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"))
    return g.withColumn("kept", (F.col("n_rows") >= min_rows) & (F.col("n_entities") >= min_entities))


def informative_strata(df: DataFrame, stratum: list[str], y: str) -> DataFrame:
    """Drop strata where the outcome is all 0 or all 1."""
    return with_group_stats(df, stratum, _y=F.avg(y)).filter((F.col("_y") > 0) & (F.col("_y") < 1)).drop("_y")
