"""Multivariate pattern classification over groups: additive statistics, leave-one-entity-out, nulls, clusters.

Nothing here gathers a group: discriminants are built from sums that add over entities, so a fold is
"total minus own". The permutation grid takes all draws of an entity's labels as one bit matrix (``permute``): its class
sums per draw, and its held-out scores per draw, are one matrix product per time bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trialweave.operators.permute import SPLIT, Buckets, Chunks, draw_constants, label_chunks, label_matrix, list_rows, strata_of, stratum_name, sum_arrays
from trialweave.operators.skew import exact_quantiles, mid_ranks, null_safe_join, scan_index, small_side, with_group_stats
from trialweave.operators.stats import auc_from_counts, hash_order
from trialweave.operators.windows import adjust_p, islands
from trialweave.runtime import pin

# Ridge multiple of the mean channel variance, and the floor that keeps the matrix definite.
RIDGE = 1e-3
RIDGE_FLOOR = 1e-8


def balanced_rows(labels: DataFrame, keys: list[str], entity: str, y: str, unit: str, seed: int) -> DataFrame:
    """Undersample the majority class within each entity; entities lacking a class leave the training set.

    The draw is keyed by entity (not redrawn per fold): balance is within entity, so every fold that
    trains on an entity uses the same rows of it.
    """
    d = with_group_stats(labels, keys + [entity], _n1=F.count_if(F.col(y) == 1), _n0=F.count_if(F.col(y) == 0))
    d = d.withColumn("_h", hash_order(seed, *[F.col(k) for k in keys], F.col(unit)))
    d = scan_index(d, keys + [entity, y], ["_h", unit], "_r")
    return d.withColumn("in_training", F.col("_r") <= F.least("_n0", "_n1")).drop("_r", "_h", "_n0", "_n1")


def _moment_vector(pattern: str, y: str, p: int) -> Column:
    """[n0, n1, sum x | 0, sum x | 1, upper triangle of x x'] of one row."""
    x = F.col(pattern)
    zero = F.array_repeat(F.lit(0.0), p)
    one = F.col(y) == 1
    flags = F.when(one, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    sums = F.when(one, F.concat(zero, x)).otherwise(F.concat(x, zero))
    outer = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, F.lit(p)), lambda b: a * b)))
    return F.concat(flags, sums, outer)


def class_moments(rows: DataFrame, keys: list[str], pattern: str, y: str, p: int) -> DataFrame:
    """Additive class statistics per key (vector sums with map-side combining)."""
    v = rows.select(*keys, array_to_vector(_moment_vector(pattern, y, p)).alias("_v"))
    g = v.groupBy(*keys).agg(Summarizer.metrics("sum").summary(F.col("_v")).alias("_s"))
    return g.select(*keys, vector_to_array("_s.sum").alias("moments"))


def add_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(Summarizer.metrics("sum").summary(array_to_vector("moments")).alias("_s"), F.count(F.lit(1)).alias("n_entities"))
    return g.select(*keys, vector_to_array("_s.sum").alias("moments"), "n_entities")


def discriminant(moments: np.ndarray, p: int, ridge: float = RIDGE) -> np.ndarray:
    """Ridge-regularised Fisher weights from stacked moment vectors; NaN where unsolvable."""
    m = np.asarray(moments, float)
    n0, n1 = m[:, 0], m[:, 1]
    s0, s1 = m[:, 2:2 + p], m[:, 2 + p:2 + 2 * p]
    full = np.zeros((len(m), p, p))
    iu = np.triu_indices(p)
    full[:, iu[0], iu[1]] = m[:, 2 + 2 * p:]
    full = full + np.transpose(np.triu(full, 1), (0, 2, 1))
    ok = (n0 > 0.5) & (n1 > 0.5) & (n0 + n1 > 2.5)  # counts, up to the rounding of vector sums
    a0, a1 = np.where(ok, n0, 1.0)[:, None], np.where(ok, n1, 1.0)[:, None]
    m0, m1 = s0 / a0, s1 / a1
    scatter = full - a0[:, :, None] * m0[:, :, None] * m0[:, None, :] - a1[:, :, None] * m1[:, :, None] * m1[:, None, :]
    sw = scatter / np.where(ok, n0 + n1 - 2, 1.0)[:, None, None]
    lift = ridge * np.trace(sw, axis1=1, axis2=2) / p + RIDGE_FLOOR
    sw = sw + lift[:, None, None] * np.eye(p)
    try:
        w = np.linalg.solve(sw, (m1 - m0)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        w = np.full((len(m), p), np.nan)
        for i in range(len(m)):
            try:
                w[i] = np.linalg.solve(sw[i], m1[i] - m0[i])
            except np.linalg.LinAlgError:
                pass
    w[~ok] = np.nan
    return w


def weights_of(moments: Column, p: int) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(s: pd.Series) -> pd.Series:
        w = discriminant(np.stack(s.to_numpy()), p)
        return pd.Series([r.tolist() if np.isfinite(r).all() else None for r in w])

    return solve(moments)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def fold_weights(rows: DataFrame, keys: list[str], entity: str, pattern: str, y: str, p: int) -> DataFrame:
    """Weights of every leave-one-entity-out fold: the total's moments minus the held-out entity's."""
    own = class_moments(rows.filter("in_training"), keys + [entity], pattern, y, p)
    total = add_moments(own, keys).withColumnRenamed("moments", "_total")
    j = null_safe_join(own, total, keys, "inner").filter("n_entities >= 3")  # two other entities with both classes
    j = j.withColumn("_train", F.zip_with("_total", "moments", lambda a, b: a - b)).filter("_train[0] + _train[1] >= 4")
    return j.select(*keys, entity, weights_of(F.col("_train"), p).alias("weights")).filter("weights is not null")


def leave_one_entity_out(rows: DataFrame, keys: list[str], entity: str, pattern: str, y: str, p: int) -> DataFrame:
    """Mean held-out AUC per key (``rows`` carry ``in_training``)."""
    w = fold_weights(rows, keys, entity, pattern, y, p)
    test = null_safe_join(rows.select(*keys, entity, pattern, y), w, keys + [entity], "inner")
    scored = test.select(*keys, entity, y, dot(pattern, "weights").alias("_score"))
    folds = auc_from_counts(scored, keys + [entity], "_score", y).filter("auc is not null")
    return folds.groupBy(*keys).agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_folds"))


def _patterns_of(rows: pa.Table, p: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per time bin: row numbers and their patterns."""
    bins = rows.column("time_bin").to_numpy()
    flat = rows.column("pattern").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    return {int(t): (np.flatnonzero(bins == t), flat[bins == t]) for t in np.unique(bins)}


def _trials_of(rows: pa.Table, unit: str, y: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct units, their labels, and each row's unit number."""
    units, first, at = np.unique(rows.column(unit).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    return units.tolist(), rows.column(y).to_numpy()[first], at


def _mid_ranks(scores: np.ndarray) -> np.ndarray:
    """Average ranks within each column."""
    order = np.argsort(scores, axis=0, kind="stable")
    value = np.take_along_axis(scores, order, axis=0)
    at = np.arange(len(scores))[:, None]
    new = np.vstack([np.ones((1, scores.shape[1]), bool), value[1:] != value[:-1]])
    last = np.vstack([new[1:], np.ones((1, scores.shape[1]), bool)])
    low = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    high = np.minimum.accumulate(np.where(last, at, len(scores))[::-1], axis=0)[::-1]
    ranks = np.empty(scores.shape)
    np.put_along_axis(ranks, order, (low + high) / 2 + 1, axis=0)
    return ranks


def stratum_moments(x: np.ndarray, train: np.ndarray, bits: np.ndarray, p: int) -> np.ndarray:
    """draws × moments of the training rows of one time bin; ``train`` and ``bits`` are draws × rows."""
    upper = np.triu_indices(p)
    wide = np.hstack([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]])
    one = (train & bits).astype(np.float64) @ wide
    zero = (train & ~bits).astype(np.float64) @ wide
    return np.hstack([zero[:, :1], one[:, :1], zero[:, 1 : p + 1], one[:, 1 : p + 1], zero[:, p + 1 :] + one[:, p + 1 :]])


def _blocks_of(moments: np.ndarray, block: int) -> list[np.ndarray]:
    return [moments[start : start + block].ravel() for start in range(0, len(moments), block)]


def draw_moments(placed: DataFrame, chunks: Chunks, keys: list[str], entity: str, unit: str, y: str, n_draws: int, seed: int, p: int, block: int) -> DataFrame:
    """Per key, entity, time bin and block of draws: the training rows' class moments, draw after draw in one array."""
    strata = [*keys, entity]
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in strata)
    constants = draw_constants(seed, n_draws)

    def run(rows: pa.Table, split: dict | None) -> pa.Table:
        units, labels, at = _trials_of(rows, unit, y)
        bits, train = label_matrix(stratum_name(rows, strata), units, labels, seed, constants, split)
        out, bins, blocks = [], [], []
        for t, (own, x) in _patterns_of(rows, p).items() if train.any() else ():
            parts = _blocks_of(stratum_moments(x, train[:, at[own]], bits[:, at[own]], p), block)
            out += parts
            bins += [t] * len(parts)
            blocks += range(len(parts))
        lists = pa.array(out, pa.list_(pa.float64()))
        return pa.Table.from_arrays([*(pa.array([rows.column(c)[0].as_py()] * len(out), rows.schema.field(c).type) for c in strata), pa.array(bins, pa.int32()), pa.array(blocks, pa.int32()), lists], names=[*strata, "time_bin", "block", "moments"])

    parts = chunks.apply(placed, run, f"{kinds}, time_bin int, block int, moments array<double>")
    return sum_arrays(parts, [*strata, "time_bin", "block"], "moments") if chunks.many else parts


def bucket_moments(placed: DataFrame, buckets: Buckets, strata: list[str], unit: str, y: str, n_draws: int, seed: int, p: int, block: int) -> DataFrame:
    """Per key, time bin and block of draws: class moments summed over a bucket's entities (``n`` of them)."""
    keys = buckets.keys
    kinds = "".join(f"{c} {placed.schema[c].dataType.simpleString()}, " for c in keys)
    constants = draw_constants(seed, n_draws)

    def run(rows: pa.Table) -> pa.Table:
        sums, n = {}, {}
        for own_rows in strata_of(rows, strata[-1]):
            units, labels, at = _trials_of(own_rows, unit, y)
            bits, train = label_matrix(stratum_name(own_rows, strata), units, labels, seed, constants)
            for t, (own, x) in _patterns_of(own_rows, p).items() if train.any() else ():
                sums[t] = stratum_moments(x, train[:, at[own]], bits[:, at[own]], p) + sums.get(t, 0.0)
                n[t] = n.get(t, 0) + 1
        out = [(t, i, n[t], m) for t in sums for i, m in enumerate(_blocks_of(sums[t], block))]
        columns = list(zip(*out)) or [[]] * 4
        given = [pa.array([rows.column(c)[0].as_py()] * len(out), rows.schema.field(c).type) for c in keys]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        return pa.Table.from_arrays([*given, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, "time_bin", "block", "n", "moments"])

    return placed.groupBy(*buckets.by).applyInArrow(run, f"{kinds}time_bin int, block int, n bigint, moments array<double>")


def fold_draws(train: np.ndarray, p: int) -> np.ndarray:
    """Weights per draw from the moments of a fold's training rows; NaN where unsolvable."""
    w = discriminant(train, p)
    w[train[:, 0] + train[:, 1] < 3.5] = np.nan
    w[~np.isfinite(w).all(axis=1)] = np.nan
    return w


def draw_weights(own: DataFrame, total: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Weights of every leave-one-entity-out fold and draw: the total's moments minus the held-out entity's; NaN where unsolvable."""
    total = total.withColumnRenamed("moments", "_total")
    j = null_safe_join(own, total, [*keys, "time_bin", "block"], "inner").filter("n_entities >= 3")  # two other entities with both classes

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(total: pd.Series, own: pd.Series) -> pd.Series:
        sizes = [len(x) // (2 + 2 * p + p * (p + 1) // 2) for x in own]
        rows = np.vstack([(np.asarray(t) - np.asarray(o)).reshape(n, -1) for t, o, n in zip(total, own, sizes)])
        return pd.Series([part.ravel() for part in np.split(fold_draws(rows, p), np.cumsum(sizes)[:-1])])

    return j.select(*own.drop("moments").columns, solve("_total", "moments").alias("weights"))


def _draw_aucs(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """AUC per draw of rows × draws; NaN where a draw lacks a class or has no weights."""
    n1 = label.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        auc = ((_mid_ranks(scores) * label).sum(axis=0) - n1 * (n1 + 1) / 2) / (n1 * (len(scores) - n1))
    auc[~np.isfinite(scores).all(axis=0)] = np.nan
    return auc


def decode_grid(patterns: DataFrame, keys: list[str], entity: str, unit: str, y: str, n_perm: int, seed: int, p: int, chunk_rows: int = 1000, block: int = 64) -> DataFrame:
    """Mean held-out AUC per key, permutation (0: observed labels) and time bin.

    An entity's trials are read twice, with all its draws at once. Entities are dealt to buckets: the first pass sums a
    bucket's moments, the second subtracts each entity's own from the total again and sums its AUCs, so nothing of
    entities × draws is kept. Balanced training rows are drawn anew in every permutation. Entities of more than
    ``chunk_rows`` trials lie in several chunks: their moments add up, and their scores are ranked across tasks.
    """
    strata = [*keys, entity]
    units = patterns.select(*strata, unit, y).distinct()
    chunks = label_chunks(units, strata, unit, y, n_perm, seed, chunk_rows)
    placed = chunks.place(patterns.select(*strata, unit, y, "time_bin", "pattern"))
    buckets = Buckets(units, keys, entity)
    whole = buckets.place(chunks.whole(placed))
    parts = bucket_moments(whole, buckets, strata, unit, y, n_perm, seed, p, block)
    if chunks.many:
        own = pin(draw_moments(chunks.cut(placed), chunks, keys, entity, unit, y, n_perm, seed, p, block))
        parts = parts.unionByName(own.select(*keys, "time_bin", "block", F.lit(1).cast("bigint").alias("n"), "moments"))
    total = pin(sum_arrays(parts, [*keys, "time_bin", "block"], "moments", n_entities=F.sum("n")))
    kinds = "".join(f"{c} {patterns.schema[c].dataType.simpleString()}, " for c in keys)
    constants = draw_constants(seed, n_perm)

    def score(rows: pa.Table, total: pa.Table) -> pa.Table:
        """Sums and counts of AUCs over a bucket's entities, draw after draw, per time bin."""
        given, sums = {}, {}
        for r in total.select(["time_bin", "block", "n_entities", "moments"]).sort_by([("time_bin", "ascending"), ("block", "ascending")]).to_batches():
            for t, n, m in zip(r.column("time_bin").to_pylist(), r.column("n_entities").to_pylist(), r.column("moments")):
                if n >= 3:  # two other entities with both classes
                    given.setdefault(t, []).append(m.values.to_numpy(zero_copy_only=False))
        given = {t: np.concatenate(m).reshape(n_perm + 1, -1) for t, m in given.items()}
        for own_rows in strata_of(rows, entity):
            units, labels, at = _trials_of(own_rows, unit, y)
            bits, train = label_matrix(stratum_name(own_rows, strata), units, labels, seed, constants)
            for t, (own, x) in _patterns_of(own_rows, p).items() if train.any() else ():
                if t not in given:
                    continue
                label = bits[:, at[own]]
                auc = _draw_aucs(x @ fold_draws(given[t] - stratum_moments(x, train[:, at[own]], label, p), p).T, label.T)
                found = ~np.isnan(auc)
                sums[t] = np.concatenate([np.where(found, auc, 0.0), found]) + sums.get(t, 0.0)
        out = [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))]
        of = rows if rows.num_rows else total
        return pa.Table.from_arrays([*(pa.array([of.column(c)[0].as_py()] * len(sums), of.schema.field(c).type) for c in keys), *out], names=[*keys, "time_bin", "sums"])

    held = whole.groupBy(*buckets.by).cogroup(buckets.replicate(total).groupBy(*buckets.by)).applyInArrow(score, f"{kinds}time_bin int, sums array<double>")
    held = sum_arrays(held, [*keys, "time_bin"], "sums")
    each = F.posexplode(F.arrays_zip(F.slice("sums", 1, n_perm + 1).alias("_sum"), F.slice("sums", n_perm + 2, n_perm + 1).alias("_n"))).alias("perm", "_d")
    folds = held.select(*keys, "time_bin", each).select(*keys, "time_bin", "perm", "_d._sum", F.round("_d._n").cast("bigint").alias("_n"))
    if chunks.many:
        far = _cut_folds(placed, own, total, chunks, keys, entity, unit, y, n_perm, seed, p).where(F.col("auc").isNotNull() & ~F.isnan("auc"))
        folds = folds.unionByName(far.select(*keys, "time_bin", "perm", F.col("auc").alias("_sum"), F.lit(1).cast("bigint").alias("_n")))
    folds = folds.groupBy(*keys, "perm", "time_bin").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("n_folds")).where("n_folds > 0")
    return pin(folds.select(*keys, "perm", "time_bin", (F.col("_sum") / F.col("n_folds")).alias("auc"), "n_folds"))


def _cut_folds(placed: DataFrame, own: DataFrame, total: DataFrame, chunks: Chunks, keys: list[str], entity: str, unit: str, y: str, n_perm: int, seed: int, p: int) -> DataFrame:
    """Held-out AUC per key, entity in several chunks, time bin and draw."""
    strata = [*keys, entity]
    weights = draw_weights(own, total, keys, p).groupBy(*strata, "time_bin").agg(F.array_sort(F.collect_list(F.struct("block", "weights"))).alias("_w"))
    weights = weights.select(*strata, "time_bin", F.flatten("_w.weights").alias("weights"))
    sizes = chunks.sizes.select(*[F.col(c).alias(c) for c in strata], (F.col("_chunks") + 0).alias("_chunks"))  # attributes of its own
    weights = null_safe_join(weights, sizes, strata, "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    weights = null_safe_join(weights, chunks.split, [*strata, "_chunk"])
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in strata)
    constants, group = draw_constants(seed, n_perm), [*strata, "_chunk"]
    names = [*strata, "time_bin", "y", "scores"]

    def score(rows: pa.Table, fold: pa.Table) -> pa.Table:
        """Labels and scores of every draw, a row per trial and time bin."""
        if not rows.num_rows or not fold.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, [*(rows.schema.field(c).type for c in strata), pa.int32(), *[pa.list_(pa.float64())] * 2])})
        units, labels, at = _trials_of(rows, unit, y)
        bits, _ = label_matrix(stratum_name(rows, strata), units, labels, seed, constants, fold.select(SPLIT).to_pylist()[0])
        given = dict(zip(fold.column("time_bin").to_pylist(), fold.column("weights")))
        bins, ys, scores = [], [], []
        for t, (own, x) in _patterns_of(rows, p).items():
            if t not in given:
                continue
            bins += [t] * len(own)
            ys += list(bits[:, at[own]].T.astype(np.float64))
            scores += list(x @ given[t].values.to_numpy(zero_copy_only=False).reshape(-1, p).T)
        lists = [pa.array(v, pa.list_(pa.float64())) for v in (ys, scores)]
        return pa.Table.from_arrays([*(pa.array([rows.column(c)[0].as_py()] * len(bins), rows.schema.field(c).type) for c in strata), pa.array(bins, pa.int32()), *lists], names=names)

    out = pin(chunks.cut(placed).groupBy(*group).cogroup(weights.groupBy(*group)).applyInArrow(score, f"{kinds}, time_bin int, y array<double>, scores array<double>"))
    each = out.select(*strata, "time_bin", F.posexplode(F.arrays_zip("y", "scores")).alias("perm", "_s")).select(*strata, "time_bin", "perm", "_s.y", "_s.scores")
    return auc_from_counts(each.where(~F.isnan("scores")), [*strata, "time_bin", "perm"], "scores", "y")


def _place_ranks(place: np.ndarray, x: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank in that order): average ranks of ``x`` within each place; nulls first, NaN last, equals together."""
    x = np.where(null, 0.0, x)
    order = np.lexsort((x, ~null, place))
    p, v, n = place[order], x[order], null[order]
    other = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    fresh = np.append(True, (p[1:] != p[:-1]) | (n[1:] != n[:-1]) | other)
    start = np.append(True, p[1:] != p[:-1])
    at, edges = np.arange(len(order)), np.append(np.flatnonzero(fresh), len(order))
    first = np.maximum.accumulate(np.where(start, at, 0))
    group = np.cumsum(fresh) - 1
    return order, (edges[group] + edges[group + 1] - 1) / 2 - first + 1


def bucket_aucs(placed: DataFrame, buckets: Buckets, strata: list[str], unit: str, y: str, n_perm: int, seed: int) -> DataFrame:
    """Per key, time bin and channel: sums and counts of the AUCs of a bucket's entities, draw after draw."""
    keys = buckets.keys
    kinds = "".join(f"{c} {placed.schema[c].dataType.simpleString()}, " for c in keys)
    constants, n = draw_constants(seed, n_perm), n_perm + 1

    def run(rows: pa.Table) -> pa.Table:
        sums = {}
        for own in strata_of(rows, strata[-1]):
            lists = own.column("pattern").combine_chunks()
            x = lists.flatten()
            if not len(x):
                continue
            length = lists.value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(own.num_rows), length)
            channel = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            units, u = np.unique(own.column(unit).to_numpy(zero_copy_only=False), return_inverse=True)
            labels, l = np.unique(own.column(y).to_numpy(zero_copy_only=False).astype(np.float64), return_inverse=True)
            pairs, trial = np.unique((u * len(labels) + l)[row], return_inverse=True)
            bits, _ = label_matrix(stratum_name(own, strata), units[pairs // len(labels)].tolist(), labels[pairs % len(labels)], seed, constants)
            at = np.stack([own.column("time_bin").to_numpy()[row], channel], axis=1)
            places, column = np.unique(at, axis=0, return_inverse=True)
            column = column.ravel()
            order, rank = _place_ranks(column, x.to_numpy(zero_copy_only=False).astype(np.float64), x.is_null().to_numpy(zero_copy_only=False))
            ranks, seen = np.zeros((len(pairs), len(places))), np.zeros((len(pairs), len(places)))
            ranks[trial[order], column[order]] = rank
            seen[trial, column] = 1.0
            drawn = bits.astype(np.float64)
            s, o, rows_n = (drawn @ ranks).T, (drawn @ seen).T, seen.sum(axis=0)[:, None]
            z = rows_n - o
            both = (o > 0) & (z > 0)
            auc = np.where(both, (s - o * (o + 1) / 2) / np.where(both, o * z, 1.0), 0.0)
            for k, name in enumerate(map(tuple, places.tolist())):
                sums[name] = np.concatenate([auc[k], both[k]]) + sums.get(name, 0.0)
        out = [pa.array([name[k] for name in sums], pa.int32()) for k in (0, 1)]
        given = (pa.array([rows.column(c)[0].as_py()] * len(sums), rows.schema.field(c).type) for c in keys)
        return pa.Table.from_arrays([*given, *out, pa.array(list(sums.values()), pa.list_(pa.float64()))], names=[*keys, "time_bin", "channel", "sums"])

    parts = placed.groupBy(*buckets.by).applyInArrow(run, f"{kinds}time_bin int, channel int, sums array<double>")
    sums = sum_arrays(parts, [*keys, "time_bin", "channel"], "sums")
    each = F.posexplode(F.arrays_zip(F.slice("sums", 1, n).alias("_sum"), F.slice("sums", n + 1, n).alias("_n"))).alias("perm", "_d")
    return sums.select(*keys, "time_bin", "channel", each).select(*keys, "channel", "time_bin", "perm", "_d._sum", F.round("_d._n").cast("bigint").alias("_n"))


def channel_course(patterns: DataFrame, keys: list[str], entity: str, unit: str, y: str, n_perm: int, seed: int, p: int, chunk_rows: int = 1000) -> DataFrame:
    """AUC of each channel by itself per key, channel, time bin and permutation, averaged over entities with both classes.

    Ranks are those of the observed values within an entity, whatever the labels, so a draw's rank sum is its bit row
    times the ranks: one matrix product per entity for all channels, time bins and draws. Entities are dealt to buckets,
    whose AUCs are summed where they arise; those of more than ``chunk_rows`` trials are ranked and summed across tasks.
    """
    strata = [*keys, entity]
    units = patterns.select(*strata, unit, y).distinct()
    chunks = label_chunks(units, strata, unit, y, n_perm, seed, chunk_rows)
    placed = chunks.place(patterns.select(*strata, unit, y, "time_bin", "pattern"))
    buckets = Buckets(units, keys, entity)
    folds = bucket_aucs(buckets.place(chunks.whole(placed)), buckets, strata, unit, y, n_perm, seed)
    if chunks.many:
        far = _cut_course(chunks.cut(placed).select(*strata, unit, y, "time_bin", "pattern"), chunks, keys, entity, unit, y, n_perm, seed)
        folds = folds.unionByName(far.select(*keys, "channel", "time_bin", "perm", F.col("auc").alias("_sum"), F.lit(1).cast("bigint").alias("_n")))
    folds = folds.groupBy(*keys, "channel", "perm", "time_bin").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")).where("_n > 0")
    # twelve decimals: equal courses stay equal whatever the order of summation
    return pin(folds.select(*keys, "channel", "perm", "time_bin", F.round(F.col("_sum") / F.col("_n"), 12).alias("auc")))


def _cut_course(patterns: DataFrame, chunks: Chunks, keys: list[str], entity: str, unit: str, y: str, n_perm: int, seed: int) -> DataFrame:
    """AUC per key, entity in several chunks, channel, time bin and draw."""
    strata = [*keys, entity]
    each = patterns.select(*strata, unit, y, "time_bin", F.posexplode("pattern").alias("channel", "x"))
    ranked = mid_ranks(each, [*strata, "time_bin", "channel"], "x", "_rank")
    rows = ranked.groupBy(*strata, unit, y).agg(F.array_sort(F.collect_list(F.struct("time_bin", "channel", "_rank"))).alias("_r"))
    kinds = ", ".join(f"{c} {patterns.schema[c].dataType.simpleString()}" for c in strata)
    constants = draw_constants(seed, n_perm)

    def run(group: pa.Table, split: dict | None) -> pa.Table:
        label = group.column(y).to_numpy()
        bits, _ = label_matrix(stratum_name(group, strata), group.column(unit).to_pylist(), label, seed, constants, split)
        cells = group.column("_r").combine_chunks().flatten()
        trial = np.repeat(np.arange(group.num_rows), group.column("_r").combine_chunks().value_lengths().to_numpy())
        at = np.stack([cells.field("time_bin").to_numpy(), cells.field("channel").to_numpy()], axis=1)
        places, column = np.unique(at, axis=0, return_inverse=True)
        ranks, seen = np.zeros((group.num_rows, len(places))), np.zeros((group.num_rows, len(places)))
        ranks[trial, column.ravel()] = cells.field("_rank").to_numpy()
        seen[trial, column.ravel()] = 1.0
        sums = np.hstack([(bits @ ranks).T, (bits @ seen).T, seen.sum(axis=0)[:, None]])  # rank sums, ones, rows
        return pa.Table.from_arrays([*(pa.array([group.column(c)[0].as_py()] * len(places), group.schema.field(c).type) for c in strata), *(pa.array(places[:, k].astype(np.int32)) for k in (0, 1)), list_rows(sums)], names=[*strata, "time_bin", "channel", "sums"])

    parts = chunks.apply(chunks.place(rows), run, f"{kinds}, time_bin int, channel int, sums array<double>")
    sums = sum_arrays(parts, [*strata, "time_bin", "channel"], "sums")
    n = n_perm + 1
    ones, rows_n = F.slice("sums", n + 1, n), F.element_at("sums", -1)
    folds = sums.select(*keys, "time_bin", "channel", F.posexplode(F.arrays_zip(F.slice("sums", 1, n).alias("s"), ones.alias("o"))).alias("perm", "_d"), F.round(rows_n).alias("_n"))
    # counts and rank sums are whole or half numbers: rounding undoes what adding up vectors left
    o, s = F.round("_d.o"), F.round(F.col("_d.s") * 2) / 2
    z = F.col("_n") - o
    return folds.where((o > 0) & (z > 0)).select(*keys, "channel", "time_bin", "perm", ((s - o * (o + 1) / 2) / (o * z)).alias("auc"))


def timecourse(grid: DataFrame, keys: list[str], stat: str = "auc") -> DataFrame:
    """Observed statistic per time with the null mean, its 97.5 % quantile and the exact pointwise p."""
    obs = grid.filter("perm = 0").select(*keys, "time_bin", F.col(stat).alias("observed"))
    null = grid.filter("perm > 0")
    q = exact_quantiles(null, keys + ["time_bin"], stat, {"null_q975": 0.975})
    j = null_safe_join(null, obs, keys + ["time_bin"], "inner")
    g = j.groupBy(*keys, "time_bin").agg(
        F.avg(stat).alias("null_mean"), F.count(stat).alias("n_perm"), F.count_if(F.col(stat) >= F.col("observed") - 1e-12).alias("_b"))
    out = null_safe_join(null_safe_join(obs, g, keys + ["time_bin"]), q, keys + ["time_bin"])
    p = F.when(F.col("observed").isNotNull(), (F.coalesce("_b", F.lit(0)) + 1) / (F.coalesce("n_perm", F.lit(0)) + 1))
    return out.withColumn("p_pointwise", p).drop("_b")


def cluster_test(grid: DataFrame, keys: list[str], alpha: float = 0.05, stat: str = "auc") -> tuple[DataFrame, DataFrame]:
    """Clusters of the observed course with exact p against the largest null cluster, and the threshold table."""
    thr = exact_quantiles(grid.filter("perm > 0"), keys, stat, {"threshold": 1 - alpha})
    g = null_safe_join(grid, thr, keys) if keys else grid.crossJoin(F.broadcast(thr))
    runs = islands(g, keys + ["perm"], "time_bin", stat, F.col("threshold"))
    observed = runs.filter("perm = 0").drop("perm")
    perms = grid.filter("perm > 0").select(*keys, "perm").distinct()
    top = null_safe_join(perms, runs.groupBy(*keys, "perm").agg(F.max("mass").alias("_top")), keys + ["perm"])
    top = top.withColumn("_top", F.coalesce("_top", F.lit(0.0)))
    j = null_safe_join(observed, top.drop("perm"), keys, "inner") if keys else observed.crossJoin(F.broadcast(top.drop("perm")))
    cols = ["cluster_id", "start", "stop", "n_points", "mass"]
    out = j.groupBy(*keys, *cols).agg(((F.count_if(F.col("_top") >= F.col("mass") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("cluster_p"), F.count(F.lit(1)).alias("n_perm"))
    return out.withColumn("significant", F.col("cluster_p") < alpha), thr


def confirmatory_fdr(clusters: DataFrame, confirmatory: Column, n_perm: int | None = None, alpha: float = 0.05, family: tuple[str, ...] = (), keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """BH within each family of confirmatory clusters; stops when no cluster of one could ever pass at rank 1.

    The draw count is the most that a family's rows were computed with, unless given. ``keys`` name a cluster: ids
    restart in every block, so blocks belong to the key.
    """
    d = clusters if "n_perm" in clusters.columns and n_perm is None else clusters.withColumn("n_perm", F.lit(n_perm).cast("bigint"))
    d = pin(d.withColumn("inference", F.when(confirmatory, "confirmatory").otherwise("exploratory")).withColumn("_one", F.lit(1)))
    by = ["_one", *family]
    own = d.filter("inference = 'confirmatory'")
    floor = own.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.max("n_perm").alias("b")).where(1.0 / (F.col("b") + 1) >= alpha / F.col("m")).first()
    if floor is not None:
        raise ValueError(f"p floor 1/{floor.b + 1} is not below alpha/m = {alpha}/{floor.m}; raise the permutation count")
    adj = adjust_p(own.withColumn("_name", F.struct(*keys)), by, "cluster_p", "_name").drop("_name", "p_holm").withColumnRenamed("p_bh", "cluster_p_fdr")
    rest = d.filter("inference <> 'confirmatory'").withColumn("cluster_p_fdr", F.lit(None).cast("double"))
    out = adj.unionByName(rest).drop("_one")
    return out.withColumn("significant_fdr", F.coalesce(F.col("cluster_p_fdr") < alpha, F.lit(False)))


def analysis_blocks(patterns: DataFrame, entity: str, unit: str, min_trials: int = 20, min_entities: int = 3) -> DataFrame:
    """Every trial in its overall, per-session and session-by-group block; small blocks are left out."""
    block = F.explode(F.array(
        F.struct(F.lit("overall").alias("analysis"), F.lit("all").alias("level")),
        F.struct(F.lit("by_session").alias("analysis"), F.concat(F.lit("session_"), F.col("session").cast("string")).alias("level")),
        F.struct(F.lit("by_session_group").alias("analysis"), F.concat(F.lit("session_"), F.col("session").cast("string"), F.lit("_"), F.col("grp")).alias("level"))))
    d = patterns.withColumn("_b", block).select("*", "_b.analysis", "_b.level").drop("_b")
    size = d.groupBy("analysis", "level").agg(F.countDistinct(unit).alias("n_trials"), F.countDistinct(entity).alias("n_entities"))
    return d.join(size.filter((F.col("n_trials") >= min_trials) & (F.col("n_entities") >= min_entities)), ["analysis", "level"])


def generalise(patterns: DataFrame, domain: str, entity: str, unit: str, y: str, seed: int, p: int) -> DataFrame:
    """Train on one domain, test on each other one (pooled test set), per time bin."""
    trials = balanced_rows(patterns.select(domain, entity, unit, y).distinct(), [domain], entity, y, unit, seed)
    train = patterns.join(trials.filter("in_training").select(domain, unit), [domain, unit], "left_semi")
    m = class_moments(train, [domain, "time_bin"], "pattern", y, p).filter("moments[0] + moments[1] >= 4")
    w = m.select(F.col(domain).alias("train_set"), "time_bin", weights_of(F.col("moments"), p).alias("weights")).filter("weights is not null")
    w = small_side(pin(w))  # one row per domain and time bin; written first, so its size is known before it is broadcast
    test = patterns.select(F.col(domain).alias("test_set"), "time_bin", "pattern", y).join(w, "time_bin").filter("train_set <> test_set")
    scored = test.select("train_set", "test_set", "time_bin", y, dot("pattern", "weights").alias("_score"))
    return auc_from_counts(scored, ["train_set", "test_set", "time_bin"], "_score", y)


def temporal_generalisation(patterns: DataFrame, entity: str, unit: str, y: str, seed: int, p: int, stride: int = 2) -> DataFrame:
    """AUC of weights trained at one time and tested at another, averaged over leave-one-out folds."""
    rows = patterns.filter(F.col("time_bin") % stride == 0)
    flags = balanced_rows(rows.select(entity, unit, y).distinct(), [], entity, y, unit, seed).select(unit, "in_training")
    rows = rows.join(flags, unit)
    w = fold_weights(rows, ["time_bin"], entity, "pattern", y, p).withColumnRenamed("time_bin", "train_bin")
    test = rows.select(entity, F.col("time_bin").alias("test_bin"), "pattern", y).join(w, entity)
    scored = test.select("train_bin", "test_bin", entity, y, dot("pattern", "weights").alias("_score"))
    folds = auc_from_counts(scored, ["train_bin", "test_bin", entity], "_score", y).filter("auc is not null")
    return folds.groupBy("train_bin", "test_bin").agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_folds"))


def region_means(matrix: DataFrame, regions: dict[str, Column], value: str = "auc") -> DataFrame:
    """One row: the mean of a train x test matrix over each named region (a condition on its cells); null where no cell lies in it."""
    return matrix.agg(*[F.avg(F.when(where, F.col(value))).alias(name) for name, where in regions.items()])


def entity_folds(df: DataFrame, entity: str, k: int, seed: int) -> DataFrame:
    """Balanced, reproducible fold per entity (sizes differ by at most one)."""
    ids = df.select(entity).distinct().withColumn("_h", hash_order(seed, F.col(entity)))
    return scan_index(ids, [], ["_h", entity], "_r").select(entity, (F.pmod(F.col("_r") - 1, F.lit(k)) + 1).cast("int").alias("fold"))


def assemble_blocks(banked: DataFrame, expected: DataFrame, previous: DataFrame) -> DataFrame:
    """Expected blocks against banked ones: missing, stray, miscounted, other inputs, fewer permutations."""
    e = expected.select("block", F.col("n_trials").alias("e_trials"), F.col("n_entities").alias("e_entities"), F.col("fingerprint").alias("e_fp"))
    old = previous.select("block", F.col("n_perm").alias("old_perm"))
    j = banked.join(e, "block", "full_outer").join(old, "block", "left")
    state = (F.when(F.col("e_trials").isNull(), "stray").when(F.col("n_trials").isNull(), F.when(F.col("old_perm").isNotNull(), "dropped").otherwise("missing"))
             .when(F.col("fingerprint") != F.col("e_fp"), "other inputs")
             .when((F.col("n_trials") != F.col("e_trials")) | (F.col("n_entities") != F.col("e_entities")), "count mismatch")
             .when(F.col("n_perm") < F.col("old_perm"), "fewer permutations").otherwise("ok"))
    return j.select("block", "n_trials", "n_entities", "n_perm", state.alias("state"))
