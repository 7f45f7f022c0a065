"""Building blocks that stay parallel when one key holds a large share of the rows.

* ``with_group_stats`` replaces an unordered window: partial aggregation, then a join that
  adaptive execution may broadcast (by measured size) or split on a hot key.
* the ``scan_*`` functions replace an ordered running window: groups under ``group_limit``
  rows use one plain window; otherwise rows are cut into ordered chunks, each chunk is
  scanned on its own and a one-row-per-chunk carry links the chunks. Both give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialweave.runtime import pin

LIMIT_CONF = "spark.trialweave.window.maxGroupRows"
DEFAULT_LIMIT = 2_000_000
SMALL_INPUT_BYTES = 64 << 20


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one map-side combined count, one scalar to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]
    return int(top or 0)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Attach per-group aggregates to every row without gathering a group in one task."""
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    if not keys:
        return df.crossJoin(F.broadcast(agg))  # exactly one row
    return null_safe_join(df, agg, keys)


def range_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Cut the rows, ordered by keys then order, into contiguous chunks of about equal size.

    The chunk number is fixed by a checkpoint, so every branch that reads it agrees.
    """
    n = chunks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in keys + order])
    return pin(ranged.withColumn("_chunk", F.spark_partition_id()))


def _order(order: list[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def groups_fit(df: DataFrame, keys: list[str]) -> bool:
    """Whether every group may be handled by one task: a small planner estimate, else a count."""
    return split_by_size(df, SMALL_INPUT_BYTES) or largest_group(df, keys) <= group_limit(df)


def _plain(df: DataFrame, keys: list[str], chunked: bool | None) -> bool:
    return groups_fit(df, keys) if chunked is None else not chunked


def scan_last(df, keys, order, reverse=False, inclusive=False, chunked=None, **values: Column) -> DataFrame:
    """Last non-null value of each expression on the rows before (or up to) the current row.

    ``reverse`` looks forward instead: the first non-null value on the following rows.
    ``keys + order`` must order the rows totally.
    """
    end = 0 if inclusive else -1
    if _plain(df, keys, chunked):
        w = W.partitionBy(*keys).orderBy(*_order(order, reverse)).rowsBetween(W.unboundedPreceding, end)
        return df.withColumns({n: F.last(c, True).over(w) for n, c in values.items()})
    d = range_chunks(df.withColumns({f"_v_{n}": c for n, c in values.items()}), keys, order)
    rank = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    summary = d.groupBy(*keys, "_chunk").agg(
        *[pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_s_{n}") for n in values]
    )
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    across = W.partitionBy(*keys).orderBy(chunk_order).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", *[F.last(f"_s_{n}", True).over(across).alias(f"_c_{n}") for n in values]
    )
    w = W.partitionBy(*keys, "_chunk").orderBy(*_order(order, reverse)).rowsBetween(W.unboundedPreceding, end)
    out = null_safe_join(d, carry, keys + ["_chunk"])
    out = out.withColumns({n: F.coalesce(F.last(f"_v_{n}", True).over(w), F.col(f"_c_{n}")) for n in values})
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def _scan_agg(df, keys, order, fn, merge, end, chunked, reverse, values):
    if _plain(df, keys, chunked):
        w = W.partitionBy(*keys).orderBy(*_order(order, reverse)).rowsBetween(W.unboundedPreceding, end)
        return df.withColumns({n: fn(c).over(w) for n, c in values.items()})
    d = range_chunks(df.withColumns({f"_v_{n}": c for n, c in values.items()}), keys, order)
    summary = d.groupBy(*keys, "_chunk").agg(*[fn(F.col(f"_v_{n}")).alias(f"_s_{n}") for n in values])
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    across = W.partitionBy(*keys).orderBy(chunk_order).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", *[fn(F.col(f"_s_{n}")).over(across).alias(f"_c_{n}") for n in values])
    w = W.partitionBy(*keys, "_chunk").orderBy(*_order(order, reverse)).rowsBetween(W.unboundedPreceding, end)
    out = null_safe_join(d, carry, keys + ["_chunk"])
    out = out.withColumns({n: merge(fn(F.col(f"_v_{n}")).over(w), F.col(f"_c_{n}")) for n in values})
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def scan_sum(df, keys, order, reverse=False, inclusive=True, chunked=None, **values: Column) -> DataFrame:
    """Running sum per key (null before the first non-null value)."""
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return _scan_agg(df, keys, order, F.sum, both, 0 if inclusive else -1, chunked, reverse, values)


def scan_max(df, keys, order, reverse=False, inclusive=True, chunked=None, **values: Column) -> DataFrame:
    return _scan_agg(df, keys, order, F.max, F.greatest, 0 if inclusive else -1, chunked, reverse, values)


def scan_min(df, keys, order, reverse=False, inclusive=True, chunked=None, **values: Column) -> DataFrame:
    return _scan_agg(df, keys, order, F.min, F.least, 0 if inclusive else -1, chunked, reverse, values)


def scan_index(df, keys, order, name="row_no", chunked=None) -> DataFrame:
    """1-based position of each row within its key."""
    out = scan_sum(df, keys, order, chunked=chunked, **{name: F.lit(1).cast("bigint")})
    return out


def scan_shift(df, keys, order, reverse=False, chunked=None, **values: Column) -> DataFrame:
    """Value on the row before (``reverse``: after) the current one, nulls included."""
    wrapped = scan_last(
        df, keys, order, reverse=reverse, chunked=chunked, **{f"_w_{n}": F.struct(c.alias("v")) for n, c in values.items()}
    )
    out = wrapped.withColumns({n: F.col(f"_w_{n}").getField("v") for n in values})
    return out.drop(*[f"_w_{n}" for n in values])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order: a combinable minimum, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str = "mid_rank", chunked=None) -> DataFrame:
    """Average rank for ties. Ties are counted first, so only distinct values are ordered."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan_sum(counts, keys, [value], inclusive=False, chunked=chunked, _before=F.col("_n"))
    ranked = ranked.select(
        *keys, value, (F.coalesce("_before", F.lit(0)) + (F.col("_n") + 1) / 2).alias(name)
    )
    return null_safe_join(df, ranked, keys + [value])


def split_by_size(df: DataFrame, limit_bytes: int = 8 << 20) -> bool:
    """True when the optimizer's size estimate of ``df`` is within ``limit_bytes``."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size) <= limit_bytes


def small_side(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise the planner and AQE choose the join."""
    return F.broadcast(df) if split_by_size(df, limit_bytes) else df


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], chunked=None, copies: str | None = None) -> DataFrame:
    """Type-7 quantiles. Values are counted first (``copies``: a row stands for so many); large groups are ranked across tasks instead."""
    count = F.count(F.lit(1)) if copies is None else F.sum(copies)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("_n"))
    if _plain(counts, keys, chunked):
        q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()]), F.col("_n")).alias("_q")
        return counts.groupBy(*keys).agg(q).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    cum = scan_sum(counts, keys, [value], chunked=True, _c=F.col("_n"))
    cum = with_group_stats(cum, keys, _total=F.sum("_n"))
    aggs = []
    for n, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(p)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_total") - 1)
        aggs += [F.min(F.when(F.col("_c") > lo, F.col(value))).alias(f"_lo_{n}"),
                 F.min(F.when(F.col("_c") > hi, F.col(value))).alias(f"_hi_{n}"), F.max(h - lo).alias(f"_f_{n}")]
    g = cum.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
                             for n in probs])
