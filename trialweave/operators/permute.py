"""Label permutations as bit matrices: all draws of a stratum at once, sums per draw by one matrix product.

A stratum's trials are laid out in chunks of at most ``chunk_rows``. Inside a chunk every draw orders the trials by an
integer digest of (seed, draw, trial); the first ``ones`` of that order get label 1, and the first ``kept`` of either
class are the balanced training rows. A stratum in several chunks is split beforehand: how many ones, and how many kept
rows of either class, each chunk holds in each draw is drawn from the multivariate hypergeometric law, so the labels are
a uniform shuffle of the whole stratum and no task holds it. Draw 0 is the observed labelling.

Trials never multiply by draws between tasks; what a task returns is one array over the draws per statistic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.operators.skew import null_safe_join
from trialweave.runtime import pin

#: A prime below 2^31: products of two residues stay inside 63 bits.
PRIME = 2147483647


def _digest(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def draw_constants(seed: int, n_draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and shift of every draw, the observed labelling's (number 0) included."""
    a = [_digest(seed, "a", b) % (PRIME - 1) + 1 for b in range(n_draws + 1)]
    c = [_digest(seed, "c", b) % PRIME for b in range(n_draws + 1)]
    return np.array(a, np.int64), np.array(c, np.int64)


def orders(units: list, seed: int, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """draws × units: the integers that order the units of each draw."""
    t = np.array([_digest(seed, u) % PRIME for u in units], np.int64)
    a, c = (x[:, None] for x in constants)
    u = (t[None, :] * a + c) % PRIME
    return ((u * u) % PRIME * a + u) % PRIME


def order_sql(seed: int, n_draws: int, unit: str = "trial") -> tuple[str, str, str]:
    """The same as SQL: a table of draws (perm, a, c), the expression of t over ``unit`` (stratum and unit, joined by '|'), and the order over t, a, c."""
    num = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    draws = f"SELECT b AS perm, {num(f"'{seed}|a|' || b")} % {PRIME - 1} + 1 AS a, {num(f"'{seed}|c|' || b")} % {PRIME} AS c FROM (SELECT unnest(range(0, {n_draws + 1})) AS b)"
    u = f"((t * a + c) % {PRIME})"
    return draws, f"{num(f"'{seed}|' || CAST({unit} AS VARCHAR)")} % {PRIME}", f"(({u} * {u}) % {PRIME} * a + {u}) % {PRIME}"


def label_matrix(stratum: str, units: list, y: np.ndarray, seed: int, constants: tuple[np.ndarray, np.ndarray], split: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two draws × units matrices: label 1, and in the class-balanced training set. ``split``: a chunk's ones, kept1, kept0 per draw.

    The stratum's name goes into the digests, so strata whose units have the same names are shuffled independently.
    """
    y = np.asarray(y).astype(bool)
    n_draws = len(constants[0])
    by_unit = np.argsort(np.array(units), kind="stable")  # equal digests: the smaller unit first
    place = np.empty((n_draws, len(y)), np.int64)
    ranked = by_unit[np.argsort(orders([f"{stratum}|{units[i]}" for i in by_unit], seed, constants), axis=1, kind="stable")]
    np.put_along_axis(place, ranked, np.broadcast_to(np.arange(len(y)), ranked.shape), axis=1)
    if split is None:
        ones = np.full(n_draws, y.sum())
        kept1 = kept0 = np.minimum(ones, len(y) - ones)
    else:
        ones, kept1, kept0 = (np.asarray(split[k], np.int64) for k in ("ones", "kept1", "kept0"))
    label = place < ones[:, None]
    train = (place < kept1[:, None]) | (~label & (place < (ones + kept0)[:, None]))
    label[0] = y
    for cls, kept in ((True, kept1[0]), (False, kept0[0])):
        own = np.flatnonzero(y == cls)
        train[0, own] = np.argsort(np.argsort(place[0, own])) < kept
    return label, train


def stratum_name(rows: pa.Table, strata: list[str]) -> str:
    return "|".join(str(rows.column(c)[0].as_py()) for c in strata)


def split_draws(sizes: np.ndarray, ones: np.ndarray, seed: int, name: str, n_draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """draws × chunks: the ones, and the kept rows of either class, of a stratum in several chunks."""
    rng = np.random.default_rng(int(hashlib.md5(f"{seed}|split|{name}".encode()).hexdigest(), 16))
    total, kept = int(ones.sum()), int(min(ones.sum(), sizes.sum() - ones.sum()))
    drawn = np.vstack([ones, rng.multivariate_hypergeometric(sizes, total, size=n_draws, method="marginals")])
    kept1 = np.array([rng.multivariate_hypergeometric(d, kept, method="marginals") for d in drawn])
    kept0 = np.array([rng.multivariate_hypergeometric(sizes - d, kept, method="marginals") for d in drawn])
    return drawn, kept1, kept0


class Chunks:
    """Strata of rows laid out in chunks by a hash of the unit, with the split of those in several.

    ``counts`` are aggregates per chunk; ``split(counts, stratum name)`` turns them into named draws × chunks matrices.
    """

    def __init__(self, rows: DataFrame, strata: list[str], unit: str, chunk_rows: int, counts: dict[str, Column], split: Callable[[dict[str, np.ndarray], str], dict[str, np.ndarray]], arrays: list[str]) -> None:
        self.strata, self.unit, self.arrays = strata, unit, arrays
        self.sizes = pin(rows.groupBy(*strata).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks")))
        kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in strata)
        many = self.place(rows).where("_chunks > 1").groupBy(*strata, "_chunk").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in counts.items()])

        held = ["n", *counts]

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("_chunk")
            parts = split({c: group.column(c).to_numpy() for c in held}, stratum_name(group, strata))
            lists = [pa.array(np.ascontiguousarray(parts[a].T).tolist(), pa.list_(pa.int64())) for a in arrays]
            return pa.Table.from_arrays([*(group.column(c) for c in (*strata, "_chunk")), *lists], names=[*strata, "_chunk", *arrays])

        self.split = pin(many.groupBy(*strata).applyInArrow(run, f"{kinds}_chunk int, " + ", ".join(f"{a} array<bigint>" for a in arrays)))
        self.many = not self.split.isEmpty()

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_chunks`` (of the stratum) and ``_chunk`` (of the unit)."""
        joined = null_safe_join(rows, self.sizes, self.strata, "inner")
        return joined.withColumn("_chunk", F.pmod(F.xxhash64(self.unit), F.col("_chunks")).cast("int"))

    def apply(self, placed: DataFrame, fn: Callable[[pa.Table, dict | None], pa.Table], ddl: str) -> DataFrame:
        """Run ``fn(chunk rows, split)`` on every chunk."""
        keys, arrays = [*self.strata, "_chunk"], self.arrays

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return fn(left, right.select(arrays).to_pylist()[0] if right.num_rows else None)

        if not self.many:
            return placed.groupBy(*keys).applyInArrow(lambda t: fn(t, None), ddl)
        return placed.groupBy(*keys).cogroup(self.split.groupBy(*keys)).applyInArrow(run, ddl)


    def whole(self, rows: DataFrame) -> DataFrame:
        """Of placed rows, those of strata in one chunk."""
        return rows.where("_chunks = 1") if self.many else rows

    def cut(self, rows: DataFrame) -> DataFrame:
        """Of placed rows, those of strata in several chunks."""
        return rows.where("_chunks > 1")


#: Units that one task takes at a time: few enough to hold, many enough that a sum over draws per bucket weighs little.
BUCKET_UNITS = (250, 20_000)


class Buckets:
    """Whole strata dealt into buckets inside each key, so that a task returns sums over its strata and not a row of draws for each.

    Strata have at most a chunk of units, so a bucket has a bounded number of rows; a key has a bucket for every so many units.
    """

    def __init__(self, units: DataFrame, keys: list[str], stratum: str) -> None:
        self.keys, self.stratum = keys, stratum
        one = F.lit(0).alias("_all")
        self.by = [*(keys or ["_all"]), "_bucket"]
        counts = units.groupBy(*(keys or [one])).agg(F.count(F.lit(1)).alias("_units"))
        counts = pin(counts)
        total = counts.agg(F.sum("_units")).first()[0] or 0
        tasks = 4 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = min(max(total // tasks, BUCKET_UNITS[0]), BUCKET_UNITS[1])
        self.counts = counts.select(*(keys or ["_all"]), F.ceil(F.col("_units") / size).cast("int").alias("_buckets"))

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``_bucket`` of their stratum."""
        rows = rows if self.keys else rows.withColumn("_all", F.lit(0))
        joined = null_safe_join(rows, self.counts, self.by[:-1], "inner")
        return joined.withColumn("_bucket", F.pmod(F.xxhash64(self.stratum), F.col("_buckets")).cast("int")).drop("_buckets")

    def replicate(self, per_key: DataFrame) -> DataFrame:
        """Rows of a key in each of its buckets."""
        per_key = per_key if self.keys else per_key.withColumn("_all", F.lit(0))
        joined = null_safe_join(per_key, self.counts, self.by[:-1], "inner")
        return joined.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).drop("_buckets")


def strata_of(rows: pa.Table, stratum: str) -> Iterator[pa.Table]:
    """The rows of each stratum of a bucket."""
    code = rows.column(stratum).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ranged = rows.take(pa.array(order)).combine_chunks()
    edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield ranged.slice(a, b - a)


SPLIT = ["ones", "kept1", "kept0"]


def label_chunks(trials: DataFrame, strata: list[str], unit: str, label: str, n_draws: int, seed: int, chunk_rows: int) -> Chunks:
    """Chunks of labelled trials; see ``split_draws``."""
    def split(counts: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
        return dict(zip(SPLIT, split_draws(counts["n"], counts["ones"], seed, name, n_draws)))

    return Chunks(trials, strata, unit, chunk_rows, {"ones": F.sum(F.col(label).cast("bigint"))}, split, SPLIT)


def sum_arrays(df: DataFrame, keys: list[str], value: str, **more: Column) -> DataFrame:
    """Element-wise sum of equally long arrays per key, with map-side combining."""
    g = df.groupBy(*keys).agg(Summarizer.metrics("sum").summary(array_to_vector(value)).alias("_s"), *[c.alias(n) for n, c in more.items()])
    return g.select(*keys, vector_to_array("_s.sum").alias(value), *more)


def list_rows(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as one list per row."""
    m = np.ascontiguousarray(matrix, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)), pa.array(m.ravel()))


def draw_labels(trials: DataFrame, strata: list[str], unit: str, label: str, n_draws: int, seed: int, chunk_rows: int = 1000) -> DataFrame:
    """One row per trial: ``labels``, a text of 0 and 1 over draws 0 (observed) to ``n_draws``."""
    chunks = label_chunks(trials, strata, unit, label, n_draws, seed, chunk_rows)
    kind = trials.schema[unit].dataType.simpleString()
    constants = draw_constants(seed, n_draws)

    def run(rows: pa.Table, split: dict | None) -> pa.Table:
        bits, _ = label_matrix(stratum_name(rows, strata), rows.column(unit).to_pylist(), rows.column(label).to_numpy(), seed, constants, split)
        texts = [(r + 48).tobytes().decode() for r in np.ascontiguousarray(bits.T).astype(np.uint8)]
        return pa.Table.from_arrays([rows.column(unit), pa.array(texts, pa.string())], names=[unit, "labels"])

    return chunks.apply(chunks.place(trials.select(*strata, unit, label)), run, f"{unit} {kind}, labels string")


def draw_sums(rows: DataFrame, strata: list[str], unit: str, label: str, value: str, n_draws: int, seed: int, chunk_rows: int = 1000) -> DataFrame:
    """(perm, stat): per draw the sum of ``value`` over rows with label 1. One row per unit."""
    chunks = label_chunks(rows, strata, unit, label, n_draws, seed, chunk_rows)
    constants = draw_constants(seed, n_draws)

    def run(group: pa.Table, split: dict | None) -> pa.Table:
        bits, _ = label_matrix(stratum_name(group, strata), group.column(unit).to_pylist(), group.column(label).to_numpy(), seed, constants, split)
        return pa.Table.from_arrays([list_rows((bits @ group.column(value).to_numpy())[None, :])], names=["stat"])

    parts = chunks.apply(chunks.place(rows.select(*strata, unit, label, value)), run, "stat array<double>")
    return sum_arrays(parts, [], "stat").select(F.posexplode("stat").alias("perm", "stat"))


def resample_sums(rows: DataFrame, by: list[str], unit: str, value: str, n_boot: int, seed: int, chunk_rows: int = 2000, block: int = 250) -> DataFrame:
    """(by, n, sums): per group the number of units and, for each bootstrap draw, the sum over n units drawn with replacement.

    A group's units are numbered in order; draw b's k-th pick is a digest of (group, k, b) modulo n. Of a group in several
    chunks each draw first deals its n picks to the chunks (multinomial by their sizes), then picks inside each.
    """
    a, c = (x[1:] for x in draw_constants(seed, n_boot))

    def split(counts: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
        n = counts["n"]
        rng = np.random.default_rng(int(hashlib.md5(f"{seed}|deal|{name}".encode()).hexdigest(), 16))
        return {"picks": rng.multinomial(int(n.sum()), n / n.sum(), size=n_boot)}

    chunks = Chunks(rows, by, unit, chunk_rows, {}, split, ["picks"])
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in by)

    def run(group: pa.Table, dealt: dict | None) -> pa.Table:
        group = group.sort_by(unit)
        x = group.column(value).to_numpy()
        name = stratum_name(group, by)
        if dealt is None:
            slots = [f"{name}|{k}" for k in range(1, len(x) + 1)]
            sums = np.concatenate([x[orders(slots, seed, (a[i : i + block], c[i : i + block])) % len(x)].sum(axis=1) for i in range(0, n_boot, block)])
        else:
            rng = np.random.default_rng(int(hashlib.md5(f"{seed}|picks|{name}|{group.column('_chunk')[0]}".encode()).hexdigest(), 16))
            sums = np.array([x[rng.integers(0, len(x), k)].sum() for k in dealt["picks"]])
        return pa.Table.from_arrays([*(group.column(k).slice(0, 1) for k in by), pa.array([len(x)], pa.int64()), list_rows(sums[None, :])], names=[*by, "n", "sums"])

    parts = chunks.apply(chunks.place(rows.select(*by, unit, F.col(value).cast("double").alias(value))), run, f"{kinds}n bigint, sums array<double>")
    return sum_arrays(parts, by, "sums", n=F.sum("n")).select(*by, "n", "sums")
