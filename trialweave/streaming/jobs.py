"""Four batch operators as Structured Streaming jobs; each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trialweave.functions import design as d
from trialweave.operators.joins import as_of_within_boundary
from trialweave.operators.skew import first_per_key
from trialweave.runtime import pin, scratch_dir


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def with_clock(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time with a watermark (a zone-less stamp is read as session time)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole first row of each key by a total order."""
    return first_per_key(rows, keys, order)


def bin_means(stream: DataFrame, keys: list[str], ts: str, width: str, value: str) -> DataFrame:
    """Tumbling-window means; a window's state goes once the watermark has passed its end."""
    return stream.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def durations(stream: DataFrame, keys: list[str], ts: str, width: str) -> DataFrame:
    """First-to-last event time per key and window."""
    us = F.unix_micros(ts)
    return stream.groupBy(F.window(ts, width).alias("w"), *keys).agg((F.max(us) - F.min(us)).alias("span_us"), F.count(F.lit(1)).alias("n"))


def run_to_keyed_table(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drain a stream of updated rows into a table that holds the latest row per key, open windows included.

    Each micro-batch writes the keys it changed under its own number, so a repeated batch replaces itself.
    """
    path = scratch_dir(stream.sparkSession, f"{label}-out")
    _drain(stream, label, lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/_batch={number}"), "update")
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])


def run_first_rows(stream: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """First row per key of a whole stream: the first of each micro-batch, merged by key. No state is held."""
    path = scratch_dir(stream.sparkSession, f"{label}-out")
    _drain(stream, label, lambda rows, number: first_rows(rows, keys, order).write.mode("overwrite").parquet(f"{path}/_batch={number}"), "append")
    return first_rows(stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns), keys, order)


#: What the last-marker job keeps of a recording: its last property marker since the last boundary.
CARRY = "code int, pos bigint, seq bigint"


def run_last_marker(markers: DataFrame, label: str, key: str = "recording", keep: int | None = None) -> DataFrame:
    """Nearest preceding property marker since the last boundary, for a stream of markers in order of position.

    A micro-batch is answered by the batch operator (its ordered scan cuts a hot recording into chunks, so no recording
    is gathered); what reaches over the border of batches is one carried marker per recording, written with the batch.
    A carried marker more than ``keep`` units behind the newest position of the stream expires.
    """
    spark = markers.sparkSession
    path, carried = scratch_dir(spark, f"{label}-out"), scratch_dir(spark, f"{label}-carry")
    kind = markers.schema[key].dataType.simpleString()
    code, at = F.col("code"), F.struct("pos", "seq")
    is_property, is_boundary = code.isin(*d.PROPERTY_CODES), code.isin(*d.BOUNDARY_CODES)
    columns = [key, "seq", "pos", "code"]

    def step(rows: DataFrame, number: int) -> None:
        old = rows.sparkSession.read.schema(f"{key} {kind}, {CARRY}").parquet(f"{carried}/{number - 1}") if number else None
        rows = pin(rows.select(*columns, F.lit(1).alias("_own")))
        every = rows if old is None else rows.unionByName(old.select(*columns, F.lit(0).alias("_own")))
        seen = as_of_within_boundary(every, [key], ["pos", "seq", "_own"], is_boundary, F.col("pos"), prop_marker=F.when(is_property, code))
        hits = seen.where((F.col("_own") == 1) & code.isin(*d.CONDITION_CODES))
        hits = hits.select(key, "seq", "code", "prop_marker", (F.col("pos") - F.col("prop_marker_pos")).alias("lag_us"))
        hits.write.mode("overwrite").parquet(f"{path}/_batch={number}")
        last = every.groupBy(key).agg(F.max(F.when(is_property, F.struct("pos", "seq", "code"))).alias("m"), F.max(F.when(is_boundary, at)).alias("b"), F.max("pos").alias("newest"))
        last = last.where("m IS NOT NULL AND (b IS NULL OR struct(m.pos, m.seq) > b)")
        if keep is not None:
            newest = rows.agg(F.max("pos").alias("_now"))
            last = last.crossJoin(F.broadcast(newest)).where(F.col("_now").isNull() | (F.col("m.pos") >= F.col("_now") - keep))  # one row
        last.select(key, "m.code", "m.pos", "m.seq").write.mode("overwrite").parquet(f"{carried}/{number}")

    _drain(markers, label, step, "append")
    return spark.read.schema(f"{key} {kind}, seq bigint, code int, prop_marker int, lag_us bigint").parquet(path).drop("_batch")


def _drain(stream: DataFrame, label: str, step: Callable[[DataFrame, int], None], mode: str) -> None:
    """Run ``step(rows, batch number)`` over all that is available."""
    checkpoint = scratch_dir(stream.sparkSession, f"{label}-ckpt")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()
