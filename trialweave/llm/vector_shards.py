"""Shards of a vector table, each searched by every query block, and the merge of their short result lists."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialweave.runtime import pin


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(pc.list_value_length(vectors)) if len(vectors) else np.zeros(0, np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def longest(vectors) -> int:
    return int(pc.max(pc.list_value_length(vectors)).as_py() or 0) if len(vectors) else 0


def search_shards(rows: DataFrame, queries: DataFrame, search: Callable, k: int, score: str, shard_rows: int, query_rows: int) -> DataFrame:
    """Every query (id, vector) against every shard of ``rows`` (id, vector); (query_id, rank, vec_id, score).

    ``search(ids, vectors, query ids, query vectors)`` gets one shard of about ``shard_rows`` rows and one block of
    about ``query_rows`` queries as numpy arrays and returns (query number, id, score) arrays with at most ``k`` rows
    per query; ``score`` is the scores' type, double or string (texts that sort as the scores do). Rows are dealt by a hash of the id, so copies of one vector spread evenly. Rows equal in id and vector
    count once; an id with several vectors is a query for each of them. Null ids come last among equal scores.
    """
    rows = pin(rows.select("id", "vector").distinct())
    queries = pin(queries.select("id", "vector").distinct())
    shards, blocks = max(1, ceil(rows.count() / shard_rows)), max(1, ceil(queries.count() / query_rows))
    deal = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    left = rows.withColumn("shard", deal(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", deal(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("q", F.xxhash64("vector"))
    kind = pa.float64() if score == "double" else pa.string()

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        width = max(longest(own["vector"]), longest(asked["vector"]))
        if not own.num_rows or not asked.num_rows:
            number, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        else:
            lost = own["id"].is_null().to_numpy()
            numbers = own["id"].fill_null(0).to_numpy().astype(np.int64)
            numbers = np.where(lost, np.iinfo(np.int64).max, numbers)  # null sorts last
            number, ids, scores = search(numbers, matrix(own["vector"], width), asked["id"].to_numpy().astype(np.int64), matrix(asked["vector"], width))
        found = pa.array(ids, pa.int64(), mask=np.asarray(ids) == np.iinfo(np.int64).max)
        at = pa.array(number, pa.int64())
        return pa.table({"query_id": asked["id"].cast(pa.int64()).take(at), "q": asked["q"].take(at), "vec_id": found, "score": pa.array(scores, kind)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, f"query_id bigint, q bigint, vec_id bigint, score {score}")
    best = W.partitionBy("query_id", "q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
