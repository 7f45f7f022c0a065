"""Substring dedup: fixed-block anchors.

A window is ``window`` consecutive words. Of any window, wherever it starts, at least one block of ``block`` =
(window + 1) // 2 words at a position divisible by ``block`` lies wholly inside. So every document is a reference whose
non-overlapping blocks are indexed, and a target whose every rolling run of ``block`` words is probed: a probe that meets
a block of a document with a smaller id is a hit. Hits are extended to the windows around them, on both sides; a window
counts when its 80-bit key first stands in a document with a smaller id, and overlapping windows join to maximal
repeats, whose words are removed. Windows are judged on the input.

Index and probes travel together, as sorted keys packed per shard (about 6 bytes a word); a shard holds a bounded number
of rows, and only hits come back. A false hit costs a window key, never a word. Of a key that several texts of a task's
batch hold, only the smallest id travels (and the smallest whose block it is); the others are hits by that one, so a
frequent passage brings a row or two per batch to its shard, not one per document. Windows are settled in the same way.
The hits per document are written to the shared folder, and the packed keys go; then texts are dealt once, by document,
and read twice from there.

Defined results: null text has no words; words are maximal runs without ASCII white space, unchanged; null ids are larger
than all others and neither smaller nor larger than each other; ids lie below 2⁶²; repeated ids do not repeat each other
(whether a window of theirs is removed depends on the id and the window alone, so rows of one id share their finds); a
text of which nothing is left is empty; an empty table stays empty; extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import free_name, shuffle_width, table
from trialweave.runtime import pin_and_release

KEY_BITS = 40
FLUSH_WORDS = 1 << 19
FLUSH_DOCS = 8_000
SHARD_ROWS = 2_000_000
MAX_SHARDS = 1 << 23
NULLS = 1 << 62  # ids from here on stand for null ids: equal in order, apart by text
NEVER = (1 << 63) - 1
_RNG = np.random.default_rng(20240911)
FACTORS = _RNG.integers(1, 1 << 63, (3, 64), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """Word → 64-bit hash, emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def rolling(hashes: np.ndarray, size: int, family: int) -> np.ndarray:
    """64-bit key of every run of ``size`` words (none if there are fewer)."""
    n = max(len(hashes) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * FACTORS[family, k]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    total = (total ^ (total >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return total ^ (total >> np.uint64(33))


def anchor_keys(hashes: np.ndarray, block: int, shards: int) -> np.ndarray:
    """Per position: shard and 40 bits of the block that starts there, in one number."""
    h = rolling(hashes, block, 0)
    shard = (h >> np.uint64(KEY_BITS)) % np.uint64(shards)
    return (shard << np.uint64(KEY_BITS)) | (h & np.uint64((1 << KEY_BITS) - 1))


def batch_hashes(texts: Iterator[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the hashes of all words side by side."""
    parts = [(t or b"").split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    return sizes, np.fromiter((known[w] for p in parts for w in p), np.uint64, int(sizes.sum()))


def flushes(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(other columns, words per text, word hashes) of about FLUSH_WORDS words; texts are not held."""
    known, held, sizes, hashes = WordHashes(), [], [], []

    def joined() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        out = pa.Table.from_batches(held), np.concatenate(sizes), np.concatenate(hashes)
        held.clear(), sizes.clear(), hashes.clear()
        return out

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            n, h = batch_hashes((t.as_py() for t in part.column("text")), known)
            held.append(part.select(others)), sizes.append(n), hashes.append(h)
            if sum(map(len, hashes)) >= FLUSH_WORDS or sum(map(len, sizes)) >= FLUSH_DOCS - 1000:
                yield joined()
    if held:
        yield joined()


def _within(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts side by side: (position, text, place in the text) of every run of ``size`` words that lies in one text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(own + size <= np.repeat(sizes, sizes))
    return inside, text[inside], own[inside]


def _group_edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


PACK = "shard int, ids binary, high binary, low binary, refs binary"


def _packed(shard: np.ndarray, high: np.ndarray, low: np.ndarray, text: np.ndarray, flags: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries in order of shard as one row per shard; an id stands once per text. ``refs`` holds text number and three flags."""
    edges = np.append(_group_edges(shard), len(shard)) if len(shard) else []
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        own, ref = np.unique(text[a:b], return_inverse=True)
        out.append((int(shard[a]), ids[own].tobytes(), high[a:b].tobytes(), low[a:b].tobytes(), (ref << 3 | flags[a:b]).astype(np.uint16).tobytes()))
    for start in range(0, len(out), 64):
        columns = list(zip(*out[start : start + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["shard", "ids", "high", "low", "refs"])


def _unpacked(group: pa.Table, high: type, low: type) -> tuple[np.ndarray, ...]:
    """(ids, high, low, flags) of all entries of a shard."""
    parts = []
    for i, h, l, refs in zip(*(group.column(c).to_pylist() for c in ("ids", "high", "low", "refs"))):
        ref = np.frombuffer(refs, np.uint16)
        parts.append((np.frombuffer(i, np.int64)[ref >> 3], np.frombuffer(h, high), np.frombuffer(l, low), ref & 7))
    return tuple(np.concatenate(x) for x in zip(*parts))


FOUND = "dest int, ids binary, keys binary"


def _home(ids: np.ndarray, shards: int) -> np.ndarray:
    """The task that a text's hits go to."""
    return ((ids.view(np.uint64) * FACTORS[2, -1] >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int64)


def _sent_home(ids: np.ndarray, keys: np.ndarray, shards: int) -> pa.Table:
    """A shard's hits as one row per home."""
    home = _home(ids, shards)
    order = np.lexsort((ids, home))
    home, ids, keys = home[order], ids[order], keys[order]
    edges = np.append(_group_edges(home), len(home)) if len(home) else np.zeros(1, np.int64)
    binary = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
    return pa.Table.from_arrays([pa.array(home[edges[:-1]].astype(np.int32)), binary(ids), binary(keys)], names=["dest", "ids", "keys"])


def _per_text(found: DataFrame) -> DataFrame:
    """(id, keys): one row per id with the list of its keys."""

    def merge(group: pa.Table) -> pa.Table:
        ids, keys = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("ids", "keys"))
        order = np.lexsort((keys, ids))
        ids, keys = ids[order], keys[order]
        once = _group_edges(ids, keys) if len(ids) else np.zeros(0, np.int64)
        ids, keys = ids[once], keys[once]
        edges = _group_edges(ids) if len(ids) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(ids)).astype(np.int32)), pa.array(keys))
        return pa.Table.from_arrays([pa.array(ids[edges]), lists], names=["id", "keys"])

    return found.groupBy("dest").applyInArrow(merge, "id bigint, keys array<bigint>")


ALIGNED, CROWDED, SETTLED = 1, 2, 4


def probe_packs(rows: DataFrame, block: int, shards: int) -> DataFrame:
    """Anchors and probes of (id, text) rows. Flags: the text's own block; others of the batch hold the key; a hit already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes, hashes in flushes(batches, ["id"]):
            ids = held.column("id").to_numpy()
            rank = np.minimum(ids, NULLS)
            at, text, place = _within(sizes, block)
            if not len(at):
                continue
            keys = anchor_keys(hashes, block, shards)[at]
            order = np.lexsort((text, rank[text], keys))
            keys, text, aligned = keys[order], text[order], (place % block == 0)[order]
            edges = _group_edges(keys, text)
            aligned = np.maximum.reduceat(aligned, edges)
            keys, text = keys[edges], text[edges]
            edges = _group_edges(keys)
            group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(keys))))
            own = rank[text]
            least = own[edges][group]
            block_least = np.minimum.reduceat(np.where(aligned, own, NEVER), edges)[group]
            settled = own > least
            crowded = np.maximum.reduceat(settled, edges)[group]
            travel = ~settled | (aligned & (own == block_least))
            flags = aligned * ALIGNED + (crowded & ~settled) * CROWDED
            flags[settled & travel] = ALIGNED
            shard = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
            yield from _packed(shard[travel], (keys[travel] >> np.uint64(32)).astype(np.uint32), keys[travel].astype(np.uint32), text[travel], flags[travel], ids)
            if settled.any():
                near = _home(ids, shards)[text[settled]]  # settled hits only pass through: dealt by document
                order = np.argsort(near, kind="stable")
                k, t = keys[settled][order], text[settled][order]
                yield from _packed(near[order], (k >> np.uint64(32)).astype(np.uint32), k.astype(np.uint32), t, np.full(len(k), SETTLED), ids)

    return rows.mapInArrow(run, PACK)


def probe_hits(packs: DataFrame, shards: int) -> DataFrame:
    """(id, keys): per text the keys at which it meets a block of a smaller id, and its own blocks so met."""

    def judge(group: pa.Table) -> pa.Table:
        ids, high, low, flags = _unpacked(group, np.uint32, np.uint32)
        keys = high.astype(np.uint64) << np.uint64(32) | low
        settled = flags == SETTLED
        known = ids[settled], keys[settled]
        ids, keys, flags = (x[~settled] for x in (ids, keys, flags))
        if len(ids):
            order = np.argsort(keys, kind="stable")
            ids, keys, flags = ids[order], keys[order], flags[order]
            edges = _group_edges(keys)
            group_of = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(keys))))
            aligned, rank = (flags & ALIGNED) > 0, np.minimum(ids, NULLS)
            hit = rank > np.minimum.reduceat(np.where(aligned, rank, NEVER), edges)[group_of]
            met = np.maximum.reduceat(hit | ((flags & CROWDED) > 0), edges)[group_of]
            keep = hit | (aligned & met)
            known = tuple(np.concatenate([a, b[keep]]) for a, b in zip(known, (ids, keys)))
        return _sent_home(*known, shards)

    return _per_text(packs.groupBy("shard").applyInArrow(judge, FOUND))


def window_packs(texts: DataFrame, window: int, block: int, shards: int) -> DataFrame:
    """Keys of the windows around the hits of (id, text, keys) rows; of a batch's equal windows the smallest id travels, the others are settled."""
    reach = window - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes, hashes in flushes(batches, ["id", "keys"]):
            ids = held.column("id").to_numpy()
            rank = np.minimum(ids, NULLS)
            at, text, _ = _within(sizes, block)
            lists = held.column("keys").combine_chunks()
            if not len(at):
                continue
            salt = lambda t: t.astype(np.uint64) * FACTORS[0, -1]  # noqa: E731  a key of another text is no hit
            wanted = lists.flatten().to_numpy().view(np.uint64) + salt(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()))
            hits = at[np.isin(anchor_keys(hashes, block, shards)[at] + salt(text), wanted)]
            turns = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(turns, np.maximum(hits - reach, 0), 1)
            np.add.at(turns, hits + 1, -1)
            at, text, _ = _within(sizes, window)
            near = np.cumsum(turns)[at] > 0
            at, text = at[near], text[near]
            w1, w2 = (rolling(hashes, window, f)[at] for f in (1, 2))
            low = w2.astype(np.uint16)
            shard = ((w1 >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((text, rank[text], low, w1, shard))
            shard, w1, low, text = (x[order] for x in (shard, w1, low, text))
            edges = _group_edges(w1, low, text) if len(w1) else np.zeros(0, np.int64)
            shard, w1, low, text = (x[edges] for x in (shard, w1, low, text))
            if not len(w1):
                continue
            edges = _group_edges(w1, low)
            group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(w1))))
            settled = rank[text] > rank[text][edges][group]
            go = ~settled
            yield from _packed(shard[go], w1[go], low[go], text[go], np.zeros(go.sum(), np.int64), ids)
            to = _home(ids, shards)[text[settled]]
            order = np.argsort(to, kind="stable")
            yield from _packed(to[order], w1[settled][order], np.zeros(len(to), np.uint16), text[settled][order], np.full(len(to), SETTLED), ids)

    return texts.mapInArrow(run, PACK)


def settled_windows(packs: DataFrame, shards: int) -> DataFrame:
    """(id, keys): the windows of each text that stand in a smaller id."""

    def judge(group: pa.Table) -> pa.Table:
        ids, w1, low, flags = _unpacked(group, np.uint64, np.uint16)
        settled = flags == SETTLED
        known = ids[settled], w1[settled]
        ids, w1, low = (x[~settled] for x in (ids, w1, low))
        if len(ids):
            rank = np.minimum(ids, NULLS)
            order = np.lexsort((rank, low, w1))
            ids, rank, w1, low = ids[order], rank[order], w1[order], low[order]
            edges = _group_edges(w1, low)
            later = rank > rank[edges][np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(w1))))]
            known = tuple(np.concatenate([a, b[later]]) for a, b in zip(known, (ids, w1)))
        return _sent_home(*known, shards)

    return _per_text(packs.groupBy("shard").applyInArrow(judge, FOUND))


def _spans(starts: np.ndarray, size: int) -> np.ndarray:
    """Positions in any of the runs of ``size`` that begin at ``starts``."""
    return np.unique((starts[:, None] + np.arange(size)).ravel())


def keep_words(words: list[bytes], hashes: np.ndarray, window: int, keys: np.ndarray) -> list[bytes]:
    """The words that no window among ``keys`` covers."""
    starts = np.flatnonzero(np.isin(rolling(hashes, window, 1), keys))
    if not len(starts):
        return words
    kept = np.ones(len(words), bool)
    kept[_spans(starts, window)] = False
    return [words[i] for i in np.flatnonzero(kept)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with two more columns, last, ``_n_words`` and ``_n_removed``. Texts that lose words become the rest, joined by single spaces."""
    block = (window + 1) // 2
    own, total, gone, kid, kept = (free_name(docs, n) for n in ("_own", "_n_words", "_n_removed", "_kid", "_keys"))
    nulls = F.lit(NULLS) + F.pmod(F.xxhash64(text_col), F.lit(NULLS))
    named = docs.withColumn(own, F.coalesce(F.col(id_col).cast("bigint"), nulls, F.lit(NULLS)))  # never null, so both joins see the same rows
    rows = named.select(F.col(own).alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = min(max(shuffle_width(docs), -(-size // (6 * SHARD_ROWS))), MAX_SHARDS)  # words are counted as six bytes
    hits = pin_and_release(probe_hits(probe_packs(rows, block, shards), shards))  # the packed keys leave the disk before the texts are dealt
    at, n_columns = docs.columns.index(text_col), len(docs.columns)

    def with_keys(found: DataFrame, how: str) -> DataFrame:
        """Texts with the keys found in them. Both joins take all columns, so that they read the same shuffled rows."""
        return named.join(found.toDF(kid, kept).hint("merge"), F.col(own) == F.col(kid), how)

    near = with_keys(hits, "inner").select(F.col(own).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(kept).alias("keys"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    found = settled_windows(window_packs(near, window, block, shards), shards)
    schema = docs.select("*", F.lit(0).cast("bigint").alias(total), F.lit(0).cast("bigint").alias(gone)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, sizes, removed = [], [], []
            for text, keys in zip(batch.column(at).to_pylist(), batch.column(n_columns)):
                words = (text or "").encode().split()
                kept = keep_words(words, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, keys.values.to_numpy().view(np.uint64)) if keys.is_valid else words
                texts.append(text if len(kept) == len(words) else b" ".join(kept).decode())
                sizes.append(len(words)), removed.append(len(words) - len(kept))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], total, gone])

    return with_keys(found, "left").select(*docs.columns, kept).mapInArrow(run, schema)


SQL = r"""
WITH words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS MATERIALIZED (
    SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words)),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
    FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS least FROM wins) WHERE least < doc_id),
kept AS (
    SELECT u.doc_id, count(*) AS n, string_agg(u.word, ' ' ORDER BY u.pos) AS text
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words) u
    ANTI JOIN covered c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""


@query("op12_substring_dedup", SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words are joined by one space also where nothing was removed."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(plain, 256).alias("kept_sha256"))
