"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched by beams.

Vectors get one more component, √(M² - |x|²) with M the shard's longest, so that the nearest by distance is the largest
by inner product. A shard's graph starts at its medoid and grows by batches: a greedy search from the medoid proposes
a point's neighbours, relaxed pruning keeps a neighbour only while no kept one is ``alpha`` times closer to it than the
point is, and reverse edges are pruned again where a list overflows. A second pass repeats this over the whole graph.
A query's beam searches every shard; what it finds is scored in double precision on the original vectors and merged.

Equal vectors of a shard are one graph node that keeps its k + 1 smallest ids: more of them can never be in a result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; equal scores go
to the smaller id; rows with the query's id are no candidates; shards of at most ``4 · beam`` vectors are scanned whole;
empty tables give none. Recall is approximate; tests measure it against brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import table
from trialweave.llm.vector_shards import search_shards, usable

DEGREE, BEAM, ALPHA = 32, 64, 1.2
WIDE = 4  # nodes expanded per step of a beam


class Graph:
    """Directed graph over the rows of ``x`` (float32, distances are squared Euclidean)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0):
        self.x, self.degree, self.beam = x, degree, beam
        self.norm = (x * x).sum(axis=1)
        self.out = np.full((len(x), degree), -1, np.int32)
        self.entry = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        order = np.random.default_rng(seed).permutation(len(x))
        order = np.concatenate(([self.entry], order[order != self.entry]))
        done = 1
        while done < len(order):
            size = min(len(order) - done, max(8, done // 2), 2048)
            self._insert(order[done : done + size], 1.0)
            done += size
        for i in range(0, len(order), 1024):
            self._insert(order[i : i + 1024], alpha)

    def _far(self, q: np.ndarray, q_norm: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.norm[ids] + q_norm[:, None] - 2 * np.einsum("bd,bcd->bc", q, self.x[ids])

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for many queries in step: (ids, squared distances), nearest first; unused places have id -1."""
        b = len(q)
        q_norm = (q * q).sum(axis=1)
        ids, far = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32)
        ids[:, 0] = self.entry
        far[:, 0] = self._far(q, q_norm, ids[:, :1])[:, 0]
        fresh = np.zeros((b, beam), bool)
        fresh[:, 0] = True
        seen = np.zeros((b, len(self.x)), bool)
        seen[:, self.entry] = True
        live = np.arange(b)
        while len(live):
            rank = np.where(fresh[live], np.arange(beam), beam)
            place = np.sort(np.partition(rank, WIDE, axis=1)[:, :WIDE], axis=1)
            some = place < beam
            place = np.minimum(place, beam - 1)
            row = live[:, None]
            nodes = np.where(some, ids[row, place], -1)
            fresh[np.broadcast_to(row, place.shape)[some], place[some]] = False
            near = np.where(nodes[:, :, None] >= 0, self.out[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            bad = near < 0
            bad[:, 1:] |= near[:, 1:] == near[:, :-1]
            near = np.where(bad, 0, near)
            bad |= seen[row, near]
            seen[np.broadcast_to(row, near.shape)[~bad], near[~bad]] = True
            new = np.where(bad, np.inf, self._far(q[live], q_norm[live], near)).astype(np.float32)
            all_far = np.concatenate([far[live], new], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, best, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(bad, -1, near)], axis=1), best, axis=1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], ~bad], axis=1), best, axis=1) & np.isfinite(far[live])
            live = live[fresh[live].any(axis=1)]
        return ids, far

    def _prune(self, points: np.ndarray, near: np.ndarray, far: np.ndarray, alpha: float) -> np.ndarray:
        """Relaxed pruning of candidate lists (nearest first, -1 unused) to ``degree`` diverse neighbours."""
        alive = (near >= 0) & (near != points[:, None])
        safe = np.maximum(near, 0)
        vec = self.x[safe]
        between = self.norm[safe][:, :, None] + self.norm[safe][:, None, :] - 2 * (vec @ vec.transpose(0, 2, 1))
        kept = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[some, k] = near[rows, pick][some]
            alive &= alpha * alpha * between[rows, pick] > far
            alive[rows, pick] = False
        return kept

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        for i in range(0, len(points), 256):
            part = points[i : i + 256]
            ids, far = self.walk(self.x[part], self.beam)
            old = self.out[part]
            old_far = np.where(old >= 0, self._far(self.x[part], self.norm[part], np.maximum(old, 0)), np.inf)
            self.out[part] = self._prune(part, *self._ranked(part, np.concatenate([ids, old], axis=1), np.concatenate([far, old_far], axis=1)), alpha)
        source, target = np.repeat(points, self.degree), self.out[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        width = 3 * self.degree
        # a hub takes its reverse edges in by turns of ``width``, each turn pruned with what the last one kept
        turns = [(heads[some], first[some] + w, count[some] - w) for w in range(0, int(count.max()) if len(count) else 0, width) for some in [np.flatnonzero(count > w)]]
        for heads, first, count, i in ((h, f, c, i) for h, f, c in turns for i in range(0, len(h), 256)):
            part = heads[i : i + 256]
            at = first[i : i + 256][:, None] + np.arange(width)
            mine = np.where(np.arange(width) < count[i : i + 256][:, None], source[np.minimum(at, len(source) - 1)], -1)
            near = np.concatenate([self.out[part], mine], axis=1)
            far = np.where(near >= 0, self._far(self.x[part], self.norm[part], np.maximum(near, 0)), np.inf)
            near, far = self._ranked(part, near, far)
            fits = (near >= 0).sum(axis=1) <= self.degree
            kept = np.full((len(part), self.degree), -1, np.int32)
            kept[fits] = near[fits][:, : self.degree]
            if (~fits).any():
                kept[~fits] = self._prune(part[~fits], near[~fits], far[~fits], alpha)
            self.out[part] = kept

    @staticmethod
    def _ranked(points: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates once each, without the point itself, nearest first."""
        order = np.argsort(near, axis=1, kind="stable")
        own = np.take_along_axis(near, order, axis=1)
        twice = np.zeros(own.shape, bool)
        twice[:, 1:] = own[:, 1:] == own[:, :-1]
        bad = twice | (own < 0) | (own == points[:, None])
        far = np.where(bad, np.inf, np.take_along_axis(far, order, axis=1)).astype(np.float32)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(np.where(bad, -1, own), order, axis=1), np.take_along_axis(far, order, axis=1)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM):
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    owner = of.ravel()[order]
    first = np.searchsorted(owner, np.arange(len(distinct)))
    place = np.arange(len(order)) - first[owner]
    members = np.full((len(distinct), k + 1), -1, np.int64)
    few = place <= k
    members[owner[few], place[few]] = order[few]
    if len(distinct) <= 4 * beam:
        near = np.broadcast_to(np.arange(len(distinct)), (len(queries), len(distinct)))
    else:
        # rows and queries are scaled to components of at most 1: the order by inner product stays, and float32 holds the squares
        x = distinct / np.abs(distinct).max()
        size = (x * x).sum(axis=1)
        x = np.concatenate([x, np.sqrt(np.maximum(size.max() - size, 0))[:, None]], axis=1).astype(np.float32)
        graph = Graph(x)
        q = np.concatenate([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        near = np.concatenate([graph.walk(q[i : i + 256], beam)[0] for i in range(0, len(q), 256)])
    number, found, scores = [], [], []
    for i, qid in enumerate(query_ids):
        rows = members[near[i][near[i] >= 0]].ravel()
        rows = rows[rows >= 0]
        rows = rows[ids[rows] != qid]
        exact = np.einsum("rd,d->r", vectors[rows], queries[i])
        best = np.lexsort((ids[rows], -exact))[:k]
        number.append(np.full(len(best), i))
        found.append(ids[rows[best]])
        scores.append(exact[best])
    return np.concatenate(number), np.concatenate(found), np.concatenate(scores)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, shard_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest rows of each query by inner product."""
    some = F.exists("vector", lambda x: x != 0)
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & some)

    def run(ids, vectors, query_ids, asked):
        return search(ids, vectors, query_ids, asked, k, max(beam, 2 * k))

    return search_shards(pick(rows), pick(queries).where("id IS NOT NULL"), run, k, "double", shard_rows, query_rows)


@query("op8_graph_search")
def op8_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
