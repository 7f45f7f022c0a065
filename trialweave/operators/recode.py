"""Projections and recodes: label maps, standardisation, covariate fill, re-referencing, clocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from trialweave.functions import design as d
from trialweave.operators.skew import null_safe_join, scan_last, with_group_stats


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def recode(col: Column, mapping: dict, default: Column | None = None) -> Column:
    out = None
    for key, label in mapping.items():
        out = F.when(col == key, F.lit(label)) if out is None else out.when(col == key, F.lit(label))
    return out.otherwise(default) if default is not None else out


def text_class(col: Column, needles: list[tuple[str, str]], default: str) -> Column:
    """First matching substring class of the lower-cased, trimmed text."""
    text = F.lower(F.trim(col))
    out = None
    for needle, label in needles:
        hit = text.contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def blank_to_null(df: DataFrame, tokens: tuple[str, ...] = ("",)) -> DataFrame:
    """Null tokens become null in every string column."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*tokens), F.col(c)) for c in strings})


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def zscore(df: DataFrame, keys: list[str], value: str, name: str, null_in_constant: bool = True) -> DataFrame:
    """(x - mean) / sample SD within a group; constant or single-row groups give 0, all-null gives null."""
    out = with_group_stats(df, keys, _m=F.avg(value), _s=F.stddev_samp(value))
    zero = F.lit(0.0)
    flat = F.when(F.col(value).isNotNull(), zero) if null_in_constant else zero
    z = (
        F.when(F.col("_m").isNull(), F.lit(None).cast("double"))
        .when(F.col("_s").isNull() | (F.col("_s") == 0), flat)
        .otherwise((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), zero))
    )
    return out.withColumn(name, z).drop("_m", "_s")


def fill_from_entities(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Fill a missing covariate with the mean over entities (one value per entity), with a flag."""
    per_entity = df.groupBy(entity).agg(F.max(value).alias("_v"))
    mean = per_entity.agg(F.avg("_v").alias("_mean"))  # one row
    out = df.crossJoin(F.broadcast(mean))
    return out.withColumns({
        f"{value}_imputed": F.col(value).isNull(), value: F.coalesce(F.col(value), F.col("_mean")),
    }).drop("_mean")


def subtract_reference(df, unit: list[str], sensor: str, value: str, refs: tuple[str, ...], divisor: float,
                       targets: Column, scale: dict[str, float] | None = None, name: str = "rereferenced") -> DataFrame:
    """Per sample: subtract sum(reference sensors)/divisor from the target sensors; optional gains."""
    ref = F.sum(F.when(F.col(sensor).isin(*refs), F.col(value)))
    out = with_group_stats(df, unit, _ref=ref)
    v = F.when(targets, F.col(value) - F.col("_ref") / F.lit(divisor)).otherwise(F.col(value))
    for s, gain in (scale or {}).items():
        v = F.when(F.col(sensor) == s, F.col(value) * F.lit(gain)).otherwise(v)
    return out.withColumn(name, v).drop("_ref")


def rereference(df, unit: list[str], sensor: str, value: str, refs: tuple[str, ...], applies_to: tuple[str, ...],
                implicit: str | None = None, implicit_included: bool = False, keep_remaining: bool = False) -> DataFrame:
    """Subtract the mean of the reference sensors (or sum/(n+1)) and recover the implicit sensor."""
    n = len(refs) + (1 if implicit_included else 0)
    ref = df.groupBy(*unit).agg((F.sum(F.when(F.col(sensor).isin(*refs), F.col(value))) / n).alias("_ref"))
    body = null_safe_join(df, ref, unit)
    hit = F.col(sensor).isin(*applies_to)
    body = body if keep_remaining else body.filter(hit)
    body = body.withColumn(value, F.when(hit, F.col(value) - F.col("_ref")).otherwise(F.col(value)))
    body = body.select(*unit, sensor, value)
    if implicit is None:
        return body
    extra = ref.select(*unit, F.lit(implicit).alias(sensor), (-F.col("_ref")).alias(value))
    return body.unionByName(extra)


def plane_x_y(theta: Column, phi: Column) -> tuple[Column, Column]:
    """Spherical angles in degrees to planar x (right) and y (anterior)."""
    radius = F.abs(theta) / 90
    turned = F.radians(F.when(theta >= 0, phi).otherwise(phi + 180))
    return radius * F.cos(turned), radius * F.sin(turned)


def absolute_clock(df, keys, order, is_segment: Column, segment_clock: Column, position: Column, step_us: int,
                   name: str = "abs_us") -> DataFrame:
    """Clock of a sample position from the last dated segment marker at or before it."""
    seg = F.when(is_segment, F.struct(segment_clock.alias("us"), position.alias("pos")))
    out = scan_last(df, keys, order, inclusive=True, _seg=seg)
    return out.withColumn(name, F.col("_seg.us") + (position - F.col("_seg.pos")) * step_us).drop("_seg")


def days_between(later: Column, earlier: Column) -> Column:
    """Days rounded half-even to one decimal."""
    us = d.micros(later) - d.micros(earlier)
    return F.bround(us / F.lit(86_400_000_000.0), 1)


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def trial_position_fields(df, trial: str, n_trials: str, block: Column, rt: str) -> DataFrame:
    """log(RT+1), session fraction, half flag, block position and nearness of a break."""
    pos = F.col("pos_in_block")
    to_break = block - 1 - pos
    far = F.lit(999)
    before = F.when(F.col("block_no") > 0, pos).otherwise(far)
    after = F.when(F.col(trial) + to_break < F.col(n_trials), to_break).otherwise(far)
    out = df.withColumns({
        "log_rt": F.log(F.greatest(F.col(rt), F.lit(0.0)) + 1),
        "trial_prop": F.col(trial) / F.col(n_trials),
        "pos_in_block": F.pmod(F.col(trial) - 1, block).cast("bigint"),
        "block_no": F.floor((F.col(trial) - 1) / block),
    })
    return out.withColumns({
        "second_half": (F.col("trial_prop") > 0.5).cast("double"),
        "first_after_break": ((pos == 0) & (F.col("block_no") > 0)).cast("int"),
        "near_break": (F.least(before, after) <= 2).cast("int"),
    })


def language_norm(col: Column) -> Column:
    """Drop a trailing parenthetical, then title case."""
    return F.initcap(F.lower(F.regexp_replace(F.trim(col), r"\s*\(.*\)\s*$", "")))


# Prefixes of the two languages every participant has.
PRIOR_LANGUAGE = r"^(english|norw|norsk|bokm|nynorsk)"


def is_prior_language(col: Column) -> Column:
    return F.coalesce(F.lower(col).rlike(PRIOR_LANGUAGE), F.lit(False))


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def retention_code(df, cell: list[str], session: str, name: str = "retention") -> DataFrame:
    """+0.5 at a cell's last session, -0.5 before; null when the cell has fewer than three sessions."""
    out = with_group_stats(df, cell, _last=F.max(session), _n=F.countDistinct(session))
    code = F.when(F.col("_n") >= 3, F.when(F.col(session) == F.col("_last"), 0.5).otherwise(-0.5))
    return out.withColumn(name, code).drop("_last", "_n")


# The naming pattern of a model id.
MODEL_ID = r"^(erp|accuracy)_(gender|agreement|marking)(?:_([0-9]+_[0-9]+))?(?:_(midline|lateral))?((?:_[a-z]+)*)$"


def model_fields(col: Column) -> dict[str, Column]:
    """Family, property, window, region and variant tag of a model id."""
    part = lambda i: F.nullif(F.regexp_extract(col, MODEL_ID, i), F.lit(""))
    tail = F.regexp_extract(col, MODEL_ID, 5)
    return {
        "family": part(1), "property": part(2), "window_name": part(3), "macroregion": part(4),
        "structure": F.when(tail.contains("_maxranef"), "maximal").otherwise("base"),
        "prior": F.when(tail.contains("_weakprior"), "weak").otherwise("informative"),
        "is_variant": tail != "",
    }


def contrast_columns(df: DataFrame) -> DataFrame:
    """Sum-coded condition and group, 0-based session position."""
    return df.withColumns({
        "c_condition": d.sum_code(F.col("condition"), d.CONTROL, d.VIOLATION),
        "c_group": d.sum_code(F.col("grp"), d.GROUP_EVEN, d.GROUP_ODD),
        "c_session": d.level_index(F.col("session"), d.SESSIONS),
    })
