"""Line dedup: winnowing over line hashes.

A document is its sequence of non-blank lines (trimmed). A line goes when it lies in a run of consecutive lines of
``min_words`` words or more that stood earlier, in a document before (smallest id, text hash) or further up in the same
one. The first occurrence stays. Blank lines go with the line before them.

Windows are the shortest runs of ``min_words`` words, from each line on and up to each line; every longer run is a union
of them. A window's fingerprint is its least line hash (the rightmost of equals), so two texts that share a window share
a fingerprint at the same place of it. Each occurrence of a fingerprint is joined to the first one in the corpus, and the
match is extended both ways, line by line, while both sides agree; a matched stretch counts if it has ``min_words`` words
by itself. A window that no stretch settles, because its fingerprint first stands in another context, is joined to the
first such window by the hash of all its lines. What settles a window stood earlier, so first windows are never settled.

A fingerprint's occurrences are never paired with each other, only with the first, so a line of a million documents
costs a million rows. Line hashes travel, not texts; the documents are read a second time to cut out the runs.

Defined results: null text counts as empty and stays null when nothing is deleted; a document whose every line goes has
an empty text; rows with equal id and text are one document and get the same text; null ids come last in the corpus
order; an empty table stays empty; extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import free_name, table
from trialweave.runtime import pin


def _lines(text: str) -> list[tuple[int, str]]:
    """(line number, trimmed line) of the non-blank lines."""
    return [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip())]


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def windows(words: np.ndarray, min_words: int) -> np.ndarray:
    """(first, last) of the shortest runs of lines with ``min_words`` words: one from each line on, one up to each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    last = np.searchsorted(total, total[:-1] + min_words) - 1
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    ahead, back = last < len(words), first >= 0
    line = np.arange(len(words))
    return np.unique(np.concatenate([np.stack([line[ahead], last[ahead]], axis=1), np.stack([first[back], line[back]], axis=1)]), axis=0)


def fingerprints(hashes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each window the place of its least line hash, the rightmost of equals."""
    return np.array([high - int(np.argmin(hashes[low : high + 1][::-1])) for low, high in spans], np.int32)


def _sequences(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Per document: id, text hash, line hashes, word counts and fingerprint positions."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, th bigint, hashes array<bigint>, words array<int>, picks array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                hashes, words, picks = [], [], []
                for text in part.column(2).to_pylist():
                    lines = _lines(text)
                    hashes.append(np.array([_hash(s) for _, s in lines], np.int64))
                    words.append(np.array([len(s.split()) for _, s in lines], np.int32))
                    picks.append(np.unique(fingerprints(hashes[-1], windows(words[-1], min_words))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(picks, pa.list_(pa.int32()))], names=["id", "th", "hashes", "words", "picks"])

    return rows.mapInArrow(run, schema)


def _extend(own: list[int], at: int, other: list[int], there: int) -> tuple[int, int]:
    """Widest stretch [low, high] of ``own`` around ``at`` that equals ``other`` around ``there``."""
    low, high = at, at
    while low > 0 and there - (at - low) > 0 and own[low - 1] == other[there - (at - low) - 1]:
        low -= 1
    while high + 1 < len(own) and there + (high - at) + 1 < len(other) and own[high + 1] == other[there + (high - at) + 1]:
        high += 1
    return low, high


SPAN = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _first(place: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first): the first (doc, place) of every key that occurs more than once."""
    first = place.groupBy(key).agg(F.min(F.struct("doc", at)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "first")
    return pin(first)  # a plain table: a frequent key's rows can then be split among tasks


def _stretches(seqs: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """(id, th, spans): stretches of ``min_words`` words or more around the hits (doc, pos, first) that agree with the first occurrence."""
    later = hits.where((F.col("first.doc") != F.col("doc")) | (F.col("first.pos") != F.col("pos")))
    pairs = later.groupBy("doc", F.col("first.doc").alias("source")).agg(F.collect_list(F.struct("pos", F.col("first.pos").alias("there"))).alias("at"))
    own = seqs.select(_doc(), F.col("hashes").alias("own"), "words")
    other = seqs.select(_doc().alias("source"), F.col("hashes").alias("other"))
    joined = pairs.join(own, "doc").join(other, "source").select("doc.id", "doc.th", "at", "own", "other", "words")

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, mine, theirs, words in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                spans, done = [], {}
                for hit in sorted(at, key=lambda h: (h["pos"] - h["there"], h["pos"])):
                    shift = hit["pos"] - hit["there"]
                    if done.get(shift, -1) >= hit["pos"]:
                        continue  # inside the stretch just found on this diagonal
                    low, high = _extend(mine, hit["pos"], theirs, hit["there"])
                    done[shift] = high
                    if sum(words[low : high + 1]) >= min_words:
                        spans.append({"low": low, "high": high})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, SPAN)], names=["id", "th", "spans"])

    return joined.mapInArrow(stretch, f"id {seqs.schema['id'].dataType.simpleString()}, th bigint, spans array<struct<low:int,high:int>>")


def _open_windows(seqs: DataFrame, hits: DataFrame, settled: DataFrame, min_words: int) -> DataFrame:
    """(id, th, wh, low, high): windows whose fingerprint occurs elsewhere and that lie in no settled stretch."""
    shared = hits.groupBy("doc").agg(F.collect_list("pos").alias("shared"))
    known = settled.select(_doc(), "spans")
    rows = seqs.select(_doc(), "hashes", "words").join(shared, "doc").join(known, "doc", "left").select("doc.id", "doc.th", "hashes", "words", "shared", "spans")
    kind = seqs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, lows, highs = [], [], [], []
            for i, (hashes, words, shared, spans) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))):
                hashes = np.array(hashes, np.int64)
                each = windows(np.array(words, np.int64), min_words)
                each = each[np.isin(fingerprints(hashes, each), shared)]
                reach = np.full(len(hashes), -1)  # how far a stretch that begins here or before goes
                for s in spans or ():
                    reach[s["low"]] = max(reach[s["low"]], s["high"])
                reach = np.maximum.accumulate(reach) if len(reach) else reach
                for low, high in each[reach[each[:, 0]] < each[:, 1]] if len(each) else ():
                    row.append(i), lows.append(low), highs.append(high)
                    keys.append(xxhash.xxh3_64_intdigest(hashes[low : high + 1].tobytes()) - (1 << 63))
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["id", "th", "wh", "low", "high"])

    return rows.mapInArrow(run, f"id {kind}, th bigint, wh bigint, low int, high int")


def _doc():
    return F.struct(F.col("id").isNull().alias("no"), "id", "th").alias("doc")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(id, th, runs): per document the line ranges {low, high} to delete; documents without any are left out."""
    seqs = pin(_sequences(docs, id_col, text_col, min_words).groupBy("id", "th").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"), F.first("picks").alias("picks")))
    place = seqs.select(_doc(), F.explode("picks").alias("pos"), "hashes").select("doc", "pos", F.get("hashes", "pos").alias("fp"))
    hits = pin(place.join(_first(place, "fp", "pos"), "fp").select("doc", "pos", "first"))
    settled = pin(_stretches(seqs, hits, min_words).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    left = pin(_open_windows(seqs, hits, settled, min_words)).select(_doc(), "wh", "low", "high")
    later = left.join(_first(left, "wh", "low"), "wh").where((F.col("first.doc") != F.col("doc")) | (F.col("first.low") != F.col("low")))
    spans = settled.unionByName(later.select("doc.id", "doc.th", F.array(F.struct("low", "high")).alias("spans")))
    return spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("runs")).where(F.size("runs") > 0)


def cut_runs(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """Text without the runs, and the numbers of its non-blank lines before and deleted."""
    lines = _lines(text or "")
    if not runs:
        return text, len(lines), 0
    gone = {lines[k][0] for r in runs for k in range(r["low"], r["high"] + 1)}
    kept, after = [], False
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            after = i in gone
        if not after:
            kept.append(line)
    return "\n".join(kept), len(lines), len(gone)


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """``docs`` with shortened texts and two more columns, last: ``_n_lines`` and ``_n_deleted`` (non-blank lines)."""
    rid, rth, cuts, total, gone = (free_name(docs, n) for n in ("_rid", "_rth", "_runs", "_n_lines", "_n_deleted"))
    runs = pin(repeated_runs(docs, id_col, text_col, min_words)).toDF(rid, rth, cuts)
    # the runs grow with the corpus: texts are dealt by document at every size
    joined = docs.join(runs.hint("merge"), docs[id_col].eqNullSafe(F.col(rid)) & (F.xxhash64(docs[text_col]) == F.col(rth)), "left").drop(rid, rth)
    schema = docs.select("*", F.lit(0).alias(total), F.lit(0).alias(gone)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut_runs(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([d[0] for d in done], columns[at].type)
            extra = [pa.array([d[k] for d in done], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*batch.schema.names[:-1], total, gone])

    return joined.mapInArrow(run, schema)


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.length(F.coalesce("text", F.lit(""))).alias("kept_chars"), F.md5("text").alias("text_md5"))
