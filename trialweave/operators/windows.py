"""Ordered and partitioned analytics that hold when one key owns a large share of the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialweave.runtime import pin
from trialweave.operators.skew import (
    groups_fit, scan_index, scan_last, scan_max, scan_min, scan_shift, scan_sum, with_group_stats,
)


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Copies per key and the rows beyond the first."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))
    return g.withColumn("n_extra", F.col("n_copies") - 1)


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, *extra: Column) -> DataFrame:
    """Run-length encoding: one row per maximal run of equal values, in order."""
    d = scan_shift(df, keys, order, _prev=F.struct(F.col(value).alias("x")))
    start = F.col("_prev").isNull() | ~F.col("_prev.x").eqNullSafe(F.col(value))
    d = scan_sum(d.withColumn("_start", start.cast("bigint")).drop("_prev"), keys, order, run_no=F.col("_start"))
    return d.groupBy(*keys, "run_no").agg(
        F.first(value).alias(value), F.count(F.lit(1)).alias("run_length"),
        F.min(F.struct(*order)).alias("first_at"), F.max(F.struct(*order)).alias("last_at"), *extra)


def run_text(run_rows: DataFrame, keys: list[str], value: str, sep: str = "->", size: int = 1000) -> DataFrame:
    """The collapsed sequence per key as text, in numbered parts of at most ``size`` runs (from 0)."""
    listed = F.array_sort(F.collect_list(F.struct("run_no", value)))
    part = F.floor((F.col("run_no") - 1) / size).alias("part")
    return run_rows.groupBy(*keys, part).agg(F.array_join(F.transform(listed, lambda r: r[value]), sep).alias("sequence"))


def islands(df: DataFrame, keys: list[str], order: str, stat: str, threshold: Column) -> DataFrame:
    """Contiguous stretches above a threshold: span, length and mass (sum of stat - threshold)."""
    d = df.withColumn("_above", F.coalesce(F.col(stat) > threshold, F.lit(False))).withColumn("_over", F.col(stat) - threshold)
    out = runs(d, keys, [order], "_above", F.sum("_over").alias("mass"))
    out = out.filter("_above").select(*keys, "run_no", F.col(f"first_at.{order}").alias("start"), F.col(f"last_at.{order}").alias("stop"),
                                      F.col("run_length").alias("n_points"), "mass")
    return scan_index(out, keys, ["run_no"], "cluster_id").drop("run_no")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Merge touching or overlapping intervals per key."""
    d = df.groupBy(*keys, start).agg(F.max(stop).alias(stop))  # equal starts collapse before ordering
    d = scan_max(d, keys, [start], inclusive=False, _reach=F.col(stop))
    fresh = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    d = scan_sum(d.withColumn("_new", fresh.cast("bigint")), keys, [start], _g=F.col("_new"))
    return d.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("n_starts")).drop("_g")


def sliding_frames(df: DataFrame, keys: list[str], order: list[str], size: int, block_rows: int = 500_000,
                   blocked: bool | None = None, **exprs) -> DataFrame:
    """Aggregates over the row and the next size-1 rows, kept only where the frame is full.

    Large groups are cut into blocks of ``block_rows`` that also carry the next block's first size-1
    rows, so a frame never needs more than one block.
    """
    full = lambda w: F.count(F.lit(1)).over(w) == size
    if blocked is None:
        blocked = not groups_fit(df, keys)
    if not blocked:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, size - 1)
        return df.withColumns({n: F.when(full(w), fn(w)) for n, fn in exprs.items()})
    d = scan_index(df, keys, order, "_i")
    block = F.floor((F.col("_i") - 1) / block_rows)
    inner = (F.col("_i") - 1) % block_rows
    homes = F.when((inner < size - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    d = d.withColumns({"_home": block, "_b": F.explode(homes)})
    w = W.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(0, size - 1)
    d = d.withColumns({n: F.when(full(w), fn(w)) for n, fn in exprs.items()})
    return d.filter("_home = _b").drop("_i", "_home", "_b")


def order_fractions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    d = scan_index(df, keys, order, "event_order")
    d = with_group_stats(d, keys, _n=F.count(F.lit(1)))
    return d.withColumn("order_fraction", F.col("event_order") / F.col("_n")).drop("_n")


def inversions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    d = scan_shift(df, keys, order, _prev=F.col(value))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < F.col("_prev")).alias("n_inversions"))


def adjust_p(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Holm and Benjamini-Hochberg within a family (null p stays out of the family)."""
    d = scan_index(df.filter(F.col(p).isNotNull()), family, [p, tie], "_r")
    d = with_group_stats(d, family, _m=F.count(F.lit(1)))
    d = d.withColumns({"_bh": F.col(p) * F.col("_m") / F.col("_r"), "_ho": F.col(p) * (F.col("_m") - F.col("_r") + 1)})
    d = scan_min(d, family, ["_r"], reverse=True, p_bh=F.col("_bh"))
    d = scan_max(d, family, ["_r"], p_holm=F.col("_ho"))
    one = F.lit(1.0)
    return d.withColumns({"p_bh": F.least(one, "p_bh"), "p_holm": F.least(one, "p_holm")}).drop("_r", "_m", "_bh", "_ho")


def alternate_split(df: DataFrame, keys: list[str], order: list[str], name: str = "half") -> DataFrame:
    d = scan_index(df, keys, order, "_i")
    return d.withColumn(name, F.when(F.col("_i") % 2 == 1, "odd").otherwise("even")).drop("_i")


def best_candidate(df: DataFrame, keys: list[str], ranking: list[Column]) -> DataFrame:
    """Row with the smallest ranking tuple per key (negate a column for descending order)."""
    rest = [c for c in df.columns if c not in keys]
    names = [f"_o{i}" for i in range(len(ranking))]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[c.alias(n) for c, n in zip(ranking, names)], *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def greedy_segments(df: DataFrame, key: str, start: str, length: int, doubling: bool | None = None) -> DataFrame:
    """Keep a segment only when it starts at or after the end of the previously kept one.

    A gap of ``length`` between neighbours resets the rule, so stretches between such gaps are
    independent. Short stretches stream through sorted partitions; long ones follow next-pointers by
    doubling.
    """
    pts = df.select(key, start).distinct()
    d = scan_shift(pts, [key], [start], _prev=F.col(start))
    fresh = F.col("_prev").isNull() | (F.col(start) - F.col("_prev") >= length)
    d = scan_sum(d.withColumn("_f", fresh.cast("bigint")), [key], [start], stretch=F.col("_f")).select(key, "stretch", start)
    if doubling is None:
        doubling = not groups_fit(d, [key, "stretch"])
    key_type = df.schema[key].dataType.simpleString()
    if not doubling:
        def keep(batches):
            at, free = None, None  # the stretch in hand and the end of its last kept segment
            for pdf in batches:
                out = []
                for name, part in pdf.groupby([key, "stretch"], sort=False):
                    if name != at:
                        at, free = name, None
                    s = part[start].to_numpy()
                    i = 0 if free is None else int(s.searchsorted(free))
                    while i < len(s):
                        out.append((name[0], s[i]))
                        free = s[i] + length
                        i = int(s.searchsorted(free))
                yield pd.DataFrame(out, columns=[key, start])

        near = d.repartition(key, "stretch").sortWithinPartitions(key, "stretch", start)
        return near.mapInPandas(keep, f"{key} {key_type}, {start} bigint")
    g = [key, "stretch"]
    probes = d.select(*g, (F.col(start) + length).alias("_at"), F.lit(0).alias("_kind"), F.col(start).alias("_own"))
    marks = d.select(*g, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.col(start).alias("_own"))
    both = scan_last(probes.unionByName(marks), g, ["_at", "_kind", "_own"], reverse=True, _next=F.when(F.col("_kind") == 1, F.col("_own")))
    jump = pin(both.filter("_kind = 0 and _next is not null").select(*g, F.col("_own").alias("src"), F.col("_next").alias("dst")))
    reached = pin(d.groupBy(*g).agg(F.min(start).alias("src")))
    while jump.limit(1).count():
        reached = pin(reached.unionByName(reached.join(jump, g + ["src"]).select(*g, F.col("dst").alias("src"))).distinct())
        far = jump.select(*g, F.col("src").alias("dst"), F.col("dst").alias("_far"))
        jump = pin(jump.join(far, g + ["dst"]).select(*g, "src", F.col("_far").alias("dst")))
    return reached.select(key, F.col("src").alias(start))


