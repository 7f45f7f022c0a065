"""Exact top-k search: an impact-ordered index, read score at a time.

Vectors become integers, floor(``scale`` · x). Each shard keeps, per component, its rows cut into ``LEVELS`` quantised
impact segments, and for every row the segment it stands in. For a query the segments of all components are read in
descending order of what they can add above their component's least contribution, in waves. After a wave a row's lower
bound is the sum of the least contributions of its segments read so far, its upper bound adds the width of those segments
and, where its segment is unread, the most an unread one of that component can add. The rows that lead are scored
exactly, which gives a proven k-th best score; rows whose upper bound is below it are ruled out. Reading stops only on
that proof, when few rows are left or everything is read; the rows still possible are scored exactly.

Sums are made in doubles while every sum of a shard and block is proven to stay below 2⁵³, where doubles are exact. Beyond
it the candidates come from scaled sums with their rounding bound added, and are scored in whole numbers of any size.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count
as filled with zeros; equal scores go to the smaller id; rows with the query's id are no candidates; with fewer
candidates than k all are returned; empty tables give none. Ranks go by exact scores of any size; a score outside 64 bits
is shown as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import table
from trialweave.llm.vector_shards import search_shards, usable

LEVELS = 32
WAVES = (0.8, 1.0)  # parts of all that segments can add
EXACT = 1 << 53
COMPLEMENT = str.maketrans("0123456789", "9876543210")


def sortable(score: int) -> str:
    """Text that sorts as the whole number does: sign, number of digits, digits (complemented below zero)."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}{digits.translate(COMPLEMENT)}"


def shown(key: Column) -> Column:
    """The number of a sortable text, cut to 64 bits."""
    up = F.substring(key, 1, 1) == "1"
    digits = F.when(up, F.substring(key, 6, 700)).otherwise(F.translate(F.substring(key, 6, 700), "0123456789", "9876543210"))
    size = F.when(F.length(digits) <= 37, digits.try_cast("decimal(38,0)")).otherwise(F.lit(str(2**64)).cast("decimal(38,0)"))
    signed = F.when(up, size).otherwise(-size)
    return F.greatest(F.least(signed, F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)")).cast("bigint")


def whole(x: float, scale: float) -> int:
    """floor(scale · x) as a whole number of any size."""
    y = scale * x
    return int(np.floor(y)) if np.isfinite(y) else int(x) * int(scale)


class ImpactIndex:
    """Segments of one shard: per component, rows of equal value ranges; ``at`` holds each row's segment."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, width = rows.shape
        low, high = rows.min(axis=0), rows.max(axis=0)
        level = np.floor((rows - low) * (LEVELS / (high - low + 1))).astype(np.int64)
        self.at = np.ascontiguousarray(level.T)
        flat = (level + np.arange(width) * LEVELS).ravel()
        self.low, self.high = np.full(width * LEVELS, np.inf), np.full(width * LEVELS, -np.inf)
        np.minimum.at(self.low, flat, rows.ravel())
        np.maximum.at(self.high, flat, rows.ravel())
        self.live = np.isfinite(self.low)
        self.low[~self.live] = self.high[~self.live] = 0.0
        self.weight = np.repeat(np.arange(width), LEVELS)

    def search(self, q: np.ndarray, k: int, banned: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best without ``banned`` ones; a proven superset."""
        n, width = self.rows.shape
        want = min(k, n - len(banned))
        if want <= 0:
            return np.zeros(0, np.int64)
        by = q[self.weight]
        least, most = np.minimum(by * self.low, by * self.high), np.maximum(by * self.low, by * self.high)
        floor = np.where(self.live, least, np.inf).reshape(width, LEVELS).min(axis=1)
        gain = np.where(self.live, most - np.repeat(floor, LEVELS), -np.inf).reshape(width, LEVELS)
        least = least.reshape(width, LEVELS) - floor[:, None]
        order = np.argsort(-gain, axis=None, kind="stable")
        total = np.cumsum(np.maximum(gain.ravel()[order], 0))
        possible, last = np.arange(n), len(order)
        for part in WAVES:
            cut = last if part == 1.0 else int(np.searchsorted(total, part * total[-1], side="right"))
            read = np.zeros(width * LEVELS, bool)
            read[order[:cut]] = True
            read = read.reshape(width, LEVELS)
            left = np.where(read, -np.inf, gain).max(axis=1, keepdims=True)  # the most that an unread segment adds
            bounds = np.empty(gain.shape, complex)  # both bounds in one pass
            bounds.real, bounds.imag = np.where(read, least, 0.0), np.where(read, gain, np.maximum(left, 0.0))
            few = 4 * len(possible) < n  # else all rows are summed, which costs less than to pick them out
            at = self.at[:, possible] if few else self.at
            sums, step = np.zeros(at.shape[1], complex), np.empty(at.shape[1], complex)
            for c in range(width):
                sums += bounds[c].take(at[c], out=step, mode="clip")
            sums = sums if few else sums[possible]
            lower, upper = sums.real, sums.imag
            if len(banned):
                out = np.isin(possible, banned)
                lower, upper = np.where(out, -np.inf, lower), np.where(out, -np.inf, upper)
            lead = possible[np.argpartition(lower, len(lower) - min(len(lower), 4 * want))[-4 * want :]]
            lead = lead[~np.isin(lead, banned)]
            scores = self.rows[lead] @ q - floor.sum()
            if len(scores) >= want:
                possible = possible[upper >= np.partition(scores, len(scores) - want)[len(scores) - want]]
            if cut == last or len(possible) <= max(4 * k, n // 16):
                break
        return possible


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids[rows], -scores))[:k] if scores.dtype != object else sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return ids[rows[best]], scores[best]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: float):
    """(query number, id, score) of each query's k best rows of the shard; scores as sortable texts."""
    with np.errstate(over="ignore"):
        top = [float(np.abs(np.floor(scale * x)).max(initial=0.0)) for x in (vectors, queries)]
    own = np.argsort(ids, kind="stable")
    banned = [own[np.searchsorted(ids[own], q) : np.searchsorted(ids[own], q, "right")] for q in query_ids]
    number, found, scores = [], [], []
    if np.isfinite(top).all() and vectors.shape[1] * max(top[0], 1.0) * max(top[1], 1.0) * 4 < EXACT:
        index = ImpactIndex(np.floor(scale * vectors))
        for i, q in enumerate(np.floor(scale * queries)):
            rows = index.search(q, k, banned[i])
            rows = rows[~np.isin(rows, banned[i])]
            best, score = _best(ids, rows, index.rows[rows] @ q, k)
            number.append(np.full(len(best), i)), found.append(best), scores.append(score)
    else:
        unit = [np.abs(x).max(axis=1, keepdims=True) for x in (vectors, queries)]
        near = [x / np.where(u > 0, u, 1.0) for x, u in zip((vectors, queries), unit)]
        exact = np.array([[whole(x, scale) for x in v] for v in vectors.tolist()], object)
        for i in range(len(queries)):
            q = np.array([whole(x, scale) for x in queries[i].tolist()], object)
            rows = np.setdiff1d(np.arange(len(ids)), banned[i])
            # row · query / (row's unit · query's unit), with an allowance for rounding and for the floors
            a, b = (1 / np.maximum(scale * u, 1e-150) for u in (unit[0][rows, 0], unit[1][i, 0]))
            slack = vectors.shape[1] * (2.0**-40 + 2 * (a + b + a * b))
            rough = near[0][rows] @ near[1][i]
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = unit[0][rows, 0] / unit[0].max()
                low, high = (rough - slack) * scaled, (rough + slack) * scaled
            want = min(k, len(rows))
            if want and np.isfinite(low).all() and np.isfinite(high).all():
                rows = rows[high >= np.partition(low, len(low) - want)[len(low) - want]]
            best, score = _best(ids, rows, np.array([sum(a * b for a, b in zip(exact[r], q)) for r in rows], object), k)
            number.append(np.full(len(best), i)), found.append(best), scores.append(score)
    return np.concatenate(number), np.concatenate(found), [sortable(int(s)) for part in scores for s in part]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product, exact."""
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))

    def run(ids, vectors, query_ids, asked):
        return search(ids, vectors, query_ids, asked, k, scale)

    found = search_shards(pick(rows), pick(queries).where("id IS NOT NULL"), run, k, "string", shard_rows, query_rows)
    return found.withColumn("score", shown(F.col("score")))


@query(
    "op10_impact_search",
    """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op10_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))
