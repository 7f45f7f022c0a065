"""Target-distribution importance resampling over hashed features, with length-bucketed CRC matrices.

A text's features are its runs of one to ``longest`` consecutive words, joined by one space. Words of a batch are laid
side by side with single spaces, so a feature is a slice of one byte array. Distinct features of equal byte length stand
in a two-dimensional uint8 array; the CRC-32 of all its rows advances one column at a time, and the results are scattered
back to the occurrences. A feature's bucket is its CRC modulo ``buckets``.

Bucket counts of the corpus and of the target give a gain per bucket; a document's weight is the sum of the gains of its
features. Weight plus a digest-seeded Gumbel key orders the documents: the highest keys are a draw without replacement
in proportion to the weights. Texts are read twice and never shuffled; what travels is a row of counts per task and
bucket, then a few numbers per document. Ranks come from range partitions and their sizes; nothing is sorted in one task.

Defined results: null text has no features (weight 0, not drawn); null ids hash as '' and come last among ties; repeated
rows are drawn one by one; an empty table gives no row; an empty target gives gains from the corpus alone; other columns
play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from trialweave.llm import query
from trialweave.llm.common import shuffle_width, table
from trialweave.runtime import pin

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
POLYNOMIAL = 0xEDB88320
BATCH_WORDS = 300_000


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


TABLE = _crc_table()


def crc_by_length(data: np.ndarray, start: np.ndarray, length: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """CRC-32 of the slices data[start : start + length], all slices of one length at a time, column by column."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        n = int(length[group[0]])
        rows, wide = max(1, cells // min(n, 4096)), 4096
        for at in range(0, len(group), rows):
            part = group[at : at + rows]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for first in range(0, n, wide):  # a very long feature passes in blocks of columns
                matrix = data[start[part, None] + np.arange(first, min(first + wide, n))]
                for column in matrix.T:
                    crc = TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[part] = crc ^ np.uint32(0xFFFFFFFF)
    return out


class FeatureBuckets:
    """Buckets of the features of a batch of word lists."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets

    def __call__(self, texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, bucket) of every feature."""
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        words = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.concatenate(words)
        data = np.frombuffer(b" ".join(w for t in texts for w in t), np.uint8)
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))[ids]
        begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # words from here to the text's end
        of, found = [], []
        at, key = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for n in range(1, self.longest + 1):
            more = left[at] >= n
            at, key = at[more], key[more]
            # a run is known by the number of the run one word shorter, and its last word
            _, first, key = np.unique(key * len(numbers) + ids[at + n - 1], return_index=True, return_inverse=True)
            start = begin[at[first]]
            last = at[first] + n - 1
            crc = crc_by_length(data, start, begin[last] + lengths[last] - start)
            of.append(text[at])
            found.append((crc % np.uint32(self.buckets)).astype(np.int64)[key])
        return np.concatenate(of), np.concatenate(found)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """(ids, words) of consecutive (id, text) rows, cut at about BATCH_WORDS words."""
    for batch in batches:
        texts, held, start = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            texts.append(WORD.findall(text.as_py().lower()) if text.is_valid else [])  # bytes: A-Z only
            held += len(texts[-1])
            if held >= BATCH_WORDS or i + 1 == batch.num_rows:
                yield batch.column(0).slice(start, len(texts)), texts
                texts, held, start = [], 0, i + 1


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all features of all texts; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = FeatureBuckets(longest, buckets), np.zeros(buckets, np.int64)
        for _, texts in _batches(batches):
            total += np.bincount(features(texts)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    each = docs.select(F.lit(0), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket floor(1000 · ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); the table has ``buckets`` rows."""

    def dense(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.float64)
        for row in counts.collect():  # at most ``buckets`` rows
            out[row.bucket] = row.n
        return out

    s, t = dense(corpus), dense(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = FeatureBuckets(longest, len(gain))
        for ids, texts in _batches(batches):
            of, bucket = features(texts)
            weight = np.zeros(len(ids), np.int64)
            np.add.at(weight, of, gain[bucket])
            columns = [np.array([len(t) for t in texts], np.int64), np.bincount(of, minlength=len(ids)).astype(np.int64), weight]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def global_ranks(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by ``order``: range partitions, their sizes, and the place within each."""
    width = shuffle_width(rows)
    cut = pin(rows.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    starts = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return cut.withColumn("_place", inside).join(starts, "_range").withColumn("rank", (F.col("_place") + F.col("_before")).cast("bigint")).drop("_range", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; ``rank`` of those drawn, null for the others."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    weighed = weigh(docs, gain, id_col, text_col, longest)
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = pin(weighed.withColumn("score", (F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))).cast("bigint")))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.agg(F.floor(F.lit(percent) * F.count(F.lit(1)) / 100).cast("bigint")).first()[0]
    ranked = global_ranks(able, [F.desc("score"), F.asc_nulls_last("doc_id")])
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(few)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE
docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS MATERIALIZED (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT unnest([1, 2, 3]) AS n),
occ AS MATERIALIZED (
    SELECT doc_id, f, count(*) AS times
    FROM (SELECT doc_id, array_to_string(w[p : p + n - 1], ' ') AS f FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes))
    GROUP BY ALL),
wanted AS MATERIALIZED (
    SELECT f, count(*) AS times
    FROM (SELECT array_to_string(w[p : p + n - 1], ' ') AS f FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS p FROM goal, sizes))
    GROUP BY f),
feats AS MATERIALIZED (SELECT f, hex(encode(f)) AS hx, strlen(f) AS size FROM (SELECT f FROM occ UNION SELECT f FROM wanted)),
bits(b, c, i) AS (
    SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
t0 AS MATERIALIZED (SELECT b, c FROM bits WHERE i = 8),
tail(k, b, c) AS (  -- a byte followed by k zero bytes
    SELECT 0, b, c FROM t0
    UNION ALL SELECT k + 1, tail.b, xor(tail.c >> 8, t0.c) FROM tail JOIN t0 ON t0.b = (tail.c & 255) WHERE k + 1 < (SELECT max(size) FROM feats)),
start(size, c) AS (  -- the start value followed by zero bytes
    SELECT 0, 4294967295::BIGINT
    UNION ALL SELECT size + 1, xor(start.c >> 8, t0.c) FROM start JOIN t0 ON t0.b = (start.c & 255) WHERE size < (SELECT max(size) FROM feats)),
bytes AS (
    SELECT f, size, size - 1 - i AS k, (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1 AS b
    FROM (SELECT f, hx, size, unnest(range(size)) AS i FROM feats)),
crc AS MATERIALIZED (
    SELECT f, xor(xor(bit_xor(tail.c), any_value(start.c)), 4294967295::BIGINT) % 10000 AS bucket
    FROM bytes JOIN tail ON tail.k = bytes.k AND tail.b = bytes.b JOIN start ON start.size = bytes.size GROUP BY f),
s AS (SELECT bucket, sum(times)::DOUBLE AS n FROM occ JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(times)::DOUBLE AS n FROM wanted JOIN crc USING (f) GROUP BY bucket),
gain AS (
    SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
    FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(times)::BIGINT AS n_features, sum(times * g)::BIGINT AS weight FROM occ JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
keys AS (SELECT doc_id, len(w) AS n_words, list_reduce([strpos('0123456789abcdef', substr(sha256(concat('42:', doc_id)), i, 1))::BIGINT - 1 FOR i IN range(1, 9)], lambda a, b: a * 16 + b) AS h FROM docs),
scored AS MATERIALIZED (
    SELECT k.doc_id, k.n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM keys k LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""


@query("op13_importance_resampling", SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
