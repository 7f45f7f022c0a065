"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word enters as the sum of two tables: a hashed word embedding and the mean of hashed character 3- and 5-gram
embeddings of ``^word$``. Both directions' input gates depend on the word alone, so a task keeps them in a bounded
table of the words it has met. Every text is cut into overlapping windows of ``WINDOW`` words (step ``STEP``, the last
one flush with the end); all are scored and the document's score is the calibrated maximum.

Training: at most ``sample_rows`` labelled texts per class, in hash order of their ids, are fitted on the driver
(the only thing sampled; documented bound). Labels belong to whole texts, so each round trains on a toxic text's
highest window and on a clean text's highest and one other window. The first embedding column starts as the log odds of
its bucket in the sample. The calibration (two parameters) is fitted on the sample's document maxima, weighted to the
share of toxic labels.

Defined results: null, empty and wordless texts get the share of toxic labels, at most 0.49; words longer than 32
characters count as several words; repeated rows get equal scores; without usable labels every text gets 0.0; rows
with a null label are not learnt from; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import table

WORDS = re.compile(r"\w{1,32}")
WINDOW, STEP = 64, 32
HIDDEN, DIM = 8, 10
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
CACHE_WORDS = 120_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket per word, and the flat n-gram buckets with each word's first index."""
    marked = [f"^{w}$" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(code)) - np.repeat(start, size)
    mixed = (code + np.uint32(1)) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    powers = np.cumprod(np.full(40, 1664525, np.uint32), dtype=np.uint32)
    word = np.add.reduceat(mixed * powers[place], start, dtype=np.uint32) * np.uint32(2246822519) >> np.uint32(32 - 15)
    grams, owner = [], []
    of = np.repeat(np.arange(len(marked)), size)
    for n in (3, 5):
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ mixed[k : len(code) - n + 1 + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
        inside = of[: len(h)] == of[n - 1 :]
        grams.append((h[inside] * np.uint32(2654435761)) >> np.uint32(32 - 15))
        owner.append(of[: len(h)][inside])
    flat, owner = np.concatenate(grams), np.concatenate(owner)
    by_word = np.argsort(owner, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(marked)))))
    return word.astype(np.int64), flat[by_word].astype(np.int64), first.astype(np.int64)


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STEP)
    return np.append(starts, n - WINDOW)


def sum_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sum of their values."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], np.add.reduceat(values[order], first, axis=0)


class Network:
    """Parameters and passes. Gate order: update, reset, candidate; forward then backward direction."""

    def __init__(self, seed: int = 0):
        rng, h = np.random.default_rng(seed), HIDDEN
        norm = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.word, self.char = norm(WORD_ROWS, DIM, s=0.05), norm(CHAR_ROWS, DIM, s=0.05)
        self.p = {"wx": norm(2 * DIM, 6 * h, s=0.3), "bx": np.zeros(6 * h, np.float32), "uf": norm(h, 3 * h, s=0.3), "ub": norm(h, 3 * h, s=0.3), "att": norm(2 * h, s=0.3), "out": norm(2 * h, s=0.3), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.0

    def inputs(self, feats) -> np.ndarray:
        word, grams, first = feats
        total = np.add.reduceat(self.char[grams], first[:-1], axis=0)
        return np.concatenate([self.word[word], total / np.diff(first)[:, None]], axis=1).astype(np.float32)

    def gates(self, feats) -> np.ndarray:
        return self.inputs(feats) @ self.p["wx"] + self.p["bx"]

    @staticmethod
    def _run(g, u, mask, keep=None):
        """One direction over g (time, batch, 3h); returns the states (time, batch, h)."""
        h = HIDDEN
        state = np.zeros((g.shape[1], h), np.float32)
        out = np.empty((g.shape[0], g.shape[1], h), np.float32)
        for t in range(g.shape[0]):
            s = state @ u
            zr = np.tanh((g[t, :, : 2 * h] + s[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            cand = np.tanh(g[t, :, 2 * h :] + zr[:, h:] * s[:, 2 * h :])
            new = cand + zr[:, :h] * (state - cand)
            if mask is not None:
                new *= mask[t]
            if keep is not None:
                keep.append((state, zr, cand, s[:, 2 * h :]))
            state = out[t] = new
        return out

    def logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Window logits; ids (batch, time) point into gates; mask (batch, time) is None when nothing is padded."""
        h, time = HIDDEN, np.ascontiguousarray(ids.T)
        m = None if mask is None else np.ascontiguousarray(mask.T)[:, :, None]
        g = gates[time]
        kf, kb = ([], []) if keep is not None else (None, None)
        fwd = self._run(g[:, :, : 3 * h], self.p["uf"], m, kf)
        bwd = self._run(g[::-1, :, 3 * h :], self.p["ub"], None if m is None else m[::-1], kb)[::-1]
        states = np.concatenate([fwd, bwd], axis=2)
        e = states @ self.p["att"]
        if m is not None:
            e = np.where(m[:, :, 0] > 0, e, np.float32(-30))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "states": states, "a": a, "pooled": pooled, "m": m, "time": time}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, keep: dict, d: np.ndarray, n_gates: int) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the gate table, from d(loss)/d(logit)."""
        h, p, states, a = HIDDEN, self.p, keep["states"], keep["a"]
        grad = {"out": keep["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
        pooled = d[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", pooled, states)
        de = a * (da - (a * da).sum(axis=0))
        grad["att"] = np.einsum("tb,tbh->h", de, states)
        ds = a[:, :, None] * pooled[None] + de[:, :, None] * p["att"]
        dg = np.zeros((*a.shape, 6 * h), np.float32)
        for name, steps, order, at in (("uf", keep["f"], range(a.shape[0]), 0), ("ub", keep["b"], range(a.shape[0] - 1, -1, -1), 1)):
            u, back, total = p[name], np.zeros((a.shape[1], h), np.float32), np.zeros_like(p[name])
            for (state, zr, cand, sc), t in zip(reversed(steps), reversed(order)):
                dn = back + ds[t, :, at * h : (at + 1) * h]
                if keep["m"] is not None:
                    dn = dn * keep["m"][t]
                z, r = zr[:, :h], zr[:, h:]
                dc = dn * (1 - z) * (1 - cand * cand)
                dz = dn * (state - cand) * z * (1 - z)
                dr = dc * sc * r * (1 - r)
                dsum = np.concatenate([dz, dr, dc * r], axis=1)
                total += state.T @ dsum
                back = dn * z + dsum @ u.T
                dg[t, :, at * 3 * h : (at + 1) * 3 * h] = np.concatenate([dz, dr, dc], axis=1)
            grad[name] = total
        rows, sums = sum_by(keep["time"].ravel(), dg.reshape(-1, 6 * h))
        flat = np.zeros((n_gates, 6 * h), np.float32)
        flat[rows] = sums
        return grad, flat


class Scorer:
    """Scores texts with a bounded table of the gates of words met so far."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def _look_up(self, words: list[str]) -> np.ndarray:
        index = self.index
        known = len(index)
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        if len(index) > known:
            new = list(index)[known:] if known else list(index)
            if len(index) > len(self.gates):
                grown = np.zeros((max(2 * len(self.gates), len(index)), self.gates.shape[1]), np.float32)
                grown[:known] = self.gates[:known]
                self.gates = grown
            for i in range(0, len(new), 50_000):
                self.gates[known + i : known + i + len(new[i : i + 50_000])] = self.net.gates(word_features(new[i : i + 50_000]))
        return ids

    def window_logits(self, texts: list[str], block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and the number of windows of each text (0 without words)."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        split = [WORDS.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = self._look_up([w for ws in split for w in ws])
        base = np.concatenate(([0], np.cumsum(sizes)))
        full = [base[i] + windows_of(n) if n else np.zeros(0, np.int64) for i, n in enumerate(sizes)]
        count = np.fromiter(map(len, full), np.int64, len(full))
        starts = np.concatenate(full) if full else np.zeros(0, np.int64)
        long = np.repeat(sizes, count) >= WINDOW
        out = np.zeros(len(starts), np.float32)
        span = np.arange(WINDOW)
        for short in (False, True):
            rows = np.flatnonzero(~long if short else long)
            for i in range(0, len(rows), block):
                at = rows[i : i + block]
                where = starts[at][:, None] + span
                mask = None
                if short:
                    end = np.repeat(base[1:], count)[at][:, None]
                    mask = (where < end).astype(np.float32)
                    where = np.minimum(where, end - 1)
                out[at] = self.net.logits(self.gates, ids[where], mask)
        return out, count

    def scores(self, texts: list[str]) -> np.ndarray:
        z, count = self.window_logits(texts)
        out = np.full(len(texts), min(self.net.prior, 0.49))
        some = np.flatnonzero(count)
        if len(some):
            top = np.maximum.reduceat(z, (np.cumsum(count) - count)[some])
            out[some] = 1 / (1 + np.exp(-np.clip(self.net.scale * top + self.net.shift, -40, 40)))
        return out


def _odds_start(net: Network, feats, docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Put each bucket's log odds into the first embedding column; returns the log odds of every vocabulary word."""
    word, grams, first = feats
    counts = {k: np.zeros((2, n)) for k, n in (("word", WORD_ROWS), ("char", CHAR_ROWS))}
    for ids, y in zip(docs, toxic):
        own = np.unique(ids)
        counts["word"][y, np.unique(word[own])] += 1
        counts["char"][y, np.unique(np.concatenate([grams[first[i] : first[i + 1]] for i in own]))] += 1
    total = np.bincount(toxic, minlength=2)
    odds = {k: np.log((c[1] + 0.5) / (total[1] + 1)) - np.log((c[0] + 0.5) / (total[0] + 1)) for k, c in counts.items()}
    net.word[:, 0], net.char[:, 0] = 0.25 * odds["word"], 0.25 * odds["char"]
    return odds["word"][word] + np.add.reduceat(odds["char"][grams], first[:-1]) / np.diff(first)


def train(texts: list[str], labels: list[int], prior: float, rounds: int = 5, batch: int = 128, seed: int = 0) -> Network:
    """Fit the network on whole-text labels; see the module text."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.prior = prior
    index: dict[str, int] = {}
    docs, toxic = [], []
    for text, y in zip(texts, labels):
        ids = np.array([index.setdefault(w, len(index)) for w in WORDS.findall(text.lower())], np.int64)
        if len(ids):
            docs.append(ids)
            toxic.append(int(y))
    toxic = np.array(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to tell apart: every text gets the label's share
        net.shift, net.scale = float(np.clip(np.log(max(prior, 1e-18)) - np.log(max(1 - prior, 1e-18)), -40, 40)), 0.0
        return net
    feats = word_features(list(index))
    word, grams, first = feats
    odds = _odds_start(net, feats, docs, toxic)
    starts = [windows_of(len(d)) for d in docs]
    ranks = [np.array([odds[d[s : s + WINDOW]].max() for s in st]) for d, st in zip(docs, starts)]
    pieces = [(d[s : s + WINDOW], len(d)) for d, st in zip(docs, starts) for s in st]
    all_ids, all_mask = np.zeros((len(pieces), WINDOW), np.int32), np.zeros((len(pieces), WINDOW), np.float32)
    for row, (own, _) in enumerate(pieces):
        all_ids[row, : len(own)], all_mask[row, : len(own)] = own, 1
    del pieces
    begin = np.concatenate(([0], np.cumsum([len(st) for st in starts])))

    def rank() -> list[np.ndarray]:
        gates = np.concatenate([net.gates((word[i : i + 50_000], grams[first[i] : first[min(i + 50_000, len(word))]], first[i : i + 50_001] - first[i])) for i in range(0, len(word), 50_000)])
        z = np.concatenate([net.logits(gates, all_ids[i : i + 2048], all_mask[i : i + 2048]) for i in range(0, len(all_ids), 2048)])
        return np.split(z, begin[1:-1])

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    square = {"word": np.full(WORD_ROWS, 1e-6, np.float32), "char": np.full(CHAR_ROWS, 1e-6, np.float32)}
    step = 0
    for turn in range(rounds):
        if turn:
            ranks = rank()
        jobs = []
        for i, r in enumerate(ranks):
            top = int(np.argmax(r))
            jobs.append((i, top))
            if not toxic[i] and len(r) > 1:
                jobs.append((i, int(rng.integers(len(r)))))
        jobs = [jobs[k] for k in rng.permutation(len(jobs))]
        for k in range(0, len(jobs), batch):
            part = jobs[k : k + batch]
            rows = [begin[i] + w for i, w in part]
            ids, mask = all_ids[rows].astype(np.int64), all_mask[rows]
            y = toxic[[i for i, _ in part]].astype(np.float32)
            used, inverse = np.unique(ids, return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum(first[used + 1] - first[used])))
            flat = np.concatenate([grams[first[u] : first[u + 1]] for u in used])
            x = net.inputs((word[used], flat, bounds))
            keep: dict = {}
            z = net.logits(x @ net.p["wx"] + net.p["bx"], inverse.reshape(ids.shape), mask, keep)
            d = ((1 / (1 + np.exp(-z)) - y) / len(part)).astype(np.float32)
            grad, dgates = net.gradients(keep, d, len(used))
            grad["wx"], grad["bx"] = x.T @ dgates, dgates.sum(axis=0)
            dx = dgates @ net.p["wx"].T
            step += 1
            for name, g in grad.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            share = np.repeat(dx[:, DIM:] / np.diff(bounds)[:, None], np.diff(bounds), axis=0)
            for name, rows, g in (("word", word[used], dx[:, :DIM]), ("char", flat, share)):
                own, total = sum_by(rows, g)
                square[name][own] += (total * total).mean(axis=1)
                getattr(net, name)[own] -= 0.02 * total / np.sqrt(square[name][own])[:, None]
    top = np.array([z.max() for z in rank()])
    weight = np.where(toxic == 1, prior / max(toxic.mean(), 1e-9), (1 - prior) / max(1 - toxic.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(300):  # two-parameter logistic fit; a ridge keeps it finite on separable data
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -40, 40)))
        e, s = weight * (q - toxic), weight * q * (1 - q) + 1e-6
        h = np.array([[(s * top * top).sum() + 1, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(e * top).sum() + (a - 1), e.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    return net


#: Parts of a long training text.
STRETCHES = 8


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2500, max_chars: int = 12_000, seed: int = 0) -> Network:
    """Train on at most ``sample_rows`` labelled texts per class, outside the held-out fold.

    A text of more than ``max_chars`` characters is learnt from ``STRETCHES`` equally long stretches spread over all of it,
    ``max_chars`` in sum; so the sample that reaches the driver is bounded.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if share is None:
        return train([], [], 0.0)
    order = F.xxhash64(F.lit(seed), "doc_id")
    ids = [known.where(F.col("toxic") == y).groupBy("doc_id", "toxic").agg(F.lit(1)).select("doc_id", "toxic").orderBy(order, "doc_id").limit(2 * sample_rows) for y in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")))  # at most 4 · sample_rows ids
    size, part = F.length(text_col), max_chars // STRETCHES
    spread = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(F.col(text_col), (1 + F.floor(i * (size - part) / (STRETCHES - 1))).cast("int"), F.lit(part)))
    text = F.when(size > max_chars, F.array_join(spread, " ")).otherwise(F.col(text_col))
    found = docs.where(size >= 1).select(F.col(id_col).alias("_id"), text.alias("_text")).join(chosen, "_id")
    rows = None
    for y in (0, 1):
        part = found.where(F.col("_toxic") == y).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_text").limit(sample_rows)
        rows = part if rows is None else rows.unionByName(part)
    sample = rows.toPandas().sort_values(["_toxic", "_id", "_text"])
    return train(sample["_text"].tolist(), sample["_toxic"].tolist(), float(share), seed=seed)


def score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``name``, in [0, 1]."""
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                values = scorer.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
