"""Tables in and out: guarded sinks, variants, overlays, manifests, rosters, cell sets, profiles."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.functions import design as d
from trialweave.operators.quality import violations
from trialweave.operators.recode import blank_to_null, require_columns


def guard_output(path: str, input_root: str) -> str:
    """Refuse to write under the input root (local links resolved, other URIs compared as given)."""
    def norm(p: str) -> str:
        bare = re.sub(r"^file:/*", "/", p)
        return os.path.realpath(bare) if bare.startswith("/") else p.rstrip("/")

    out, root = norm(path), norm(input_root)
    if out == root or out.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"refusing to write {path} under the input root")
    return path


def write_csv(df: DataFrame, path: str, input_root: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(guard_output(path, input_root))
    return path


def write_cells(df: DataFrame, path: str, input_root: str, by: list[str]) -> str:
    """One directory per cell; rows of a cell are brought together as far as partition sizes allow, a large cell is split."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(guard_output(path, input_root))
    return path


def write_variant(df: DataFrame, path: str, input_root: str, variant: str) -> str:
    """Replace one variant's partition and leave the others as they are."""
    out = df.withColumn("variant", F.lit(variant)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("variant").parquet(guard_output(path, input_root))
    return path


def read_if(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """A result table only when it can be read and carries the required columns."""
    try:
        df = spark.read.parquet(path)
    except Exception:
        return None
    return df if set(required) <= set(df.columns) else None


def overlay_rows(legacy: DataFrame, overlay: DataFrame, record: list[str]) -> DataFrame:
    """Each record is read wholly from the overlay or wholly from the legacy set, rows tagged by source."""
    keep = legacy.join(overlay.select(*record).distinct(), record, "left_anti")
    return overlay.withColumn("source", F.lit("overlay")).unionByName(keep.withColumn("source", F.lit("legacy")))


def overlay_violations(manifest: DataFrame, disk: DataFrame, legacy: DataFrame, scope: DataFrame) -> DataFrame:
    """Admission rules of an overlay, one row per breach (rule, file); nothing is admitted unless empty.

    manifest: file, record, kind, status, conventions, sha256; disk: file, sha256; legacy: file, record; scope: record.
    """
    m = manifest
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "file")
    twice = m.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hashed = m.join(disk.withColumnRenamed("sha256", "found"), "file").filter("sha256 <> found")
    rp = m.filter("kind = 'reprocessed'")
    want = legacy.join(rp.select("record").distinct(), "record", "left_semi")
    return reduce(DataFrame.unionByName, [
        rule(twice, "listed twice"), rule(m.filter(~((F.col("status") == "pass") & (F.col("conventions") == "as_legacy"))), "not passing"),
        rule(disk.join(m, "file", "left_anti"), "not in the manifest"), rule(m.join(disk, "file", "left_anti"), "not on disk"), rule(hashed, "hash differs"),
        rule(m.filter(~F.col("kind").isin("reprocessed", "markers_rebuilt")), "unknown kind"), rule(rp.join(legacy, "file", "left_anti"), "no legacy counterpart"),
        rule(rp.join(scope, "record", "left_anti"), "out of scope"), rule(want.join(rp, "file", "left_anti"), "record incomplete")])


def disk_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(file, sha256) of every file under ``root``, from its bytes."""
    return read_files(spark, root).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def git_blob_id(content: Column) -> Column:
    """Content id of a byte string: SHA-1 over 'blob <length>', a zero byte and the bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def without_crlf(content: Column) -> Column:
    """The bytes with every CR that precedes an LF removed (byte-wise, via hex pairs)."""
    pairs = F.regexp_replace(F.hex(content), "(..)", "$1 ")
    return F.unhex(F.replace(F.replace(pairs, F.lit("0D 0A "), F.lit("0A ")), F.lit(" "), F.lit("")))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """ok / missing / differs per listed file; a copy that only gained CRs still counts as ok."""
    f = files.select("path", git_blob_id(F.col("content")).alias("_id"), git_blob_id(without_crlf(F.col("content"))).alias("_lf"))
    j = manifest.join(f, "path", "left")
    same = (F.col("_id") == F.col("blob")) | (F.col("_lf") == F.col("blob"))
    state = F.when(F.col("_id").isNull(), "missing").when(same, "ok").otherwise("differs")
    return j.select("path", state.alias("state"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select(F.regexp_replace("path", "^.*?\\Q" + root.rstrip("/") + "/\\E", "").alias("path"), "content")


def roster(raw: DataFrame, id_columns: list[str], entity: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned roster and its constraint violations."""
    require_columns(raw, [*id_columns, entity, group])
    r = blank_to_null(raw).filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in {*id_columns, entity}]))
    number = F.col(entity).try_cast("double")
    bad = F.col(entity).isNotNull() & (number.isNull() | (number != F.floor(number)))
    r = r.withColumns({"_bad": bad, entity: F.when(~bad, number.cast("bigint"))})
    e, g = F.col(entity), F.col(group)
    known = F.coalesce(g.isin(d.GROUP_ODD, d.GROUP_EVEN), F.lit(False))
    out = [violations(r, "id not whole", "error", e, F.col("_bad"), "id is not a whole number"),
           violations(r, "id without group", "error", e, e.isNotNull() & ~known, "id has no known group"),
           violations(r, "group without id", "error", e, e.isNull() & known, "group has no id"),
           violations(r, "parity mismatch", "error", e, e.isNotNull() & known & (d.group_from_parity(e) != g), "group disagrees with the odd/even rule")]
    for c in (entity, *id_columns):
        dup = r.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.min(entity).alias("_e")).filter(F.col(c).isNotNull() & (F.col("_n") > 1))
        out.append(violations(dup, f"duplicate {c}", "error", F.col("_e"), F.lit(True), "id appears more than once"))
    return r.filter(known).drop("_bad"), reduce(DataFrame.unionByName, out)


def cell_set_checks(cells: DataFrame, file: list[str], trial: list[str], expected_files: int) -> DataFrame:
    """Per file: rows, repeated trials and whether its trial counts equal the other files'."""
    t = cells.groupBy(*file, *trial).agg(F.count(F.lit(1)).alias("_n"))
    per = t.groupBy(*file).agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_repeated"), F.sum(F.xxhash64(*trial).cast("decimal(38,0)")).alias("_sig"))
    ref = per.agg(F.min("_sig").alias("_lo"), F.max("_sig").alias("_hi"), F.count(F.lit(1)).alias("_files"))
    return per.crossJoin(F.broadcast(ref)).select(*file, "n_rows", "n_repeated", (F.col("_lo") == F.col("_hi")).alias("files_agree"), (F.col("_files") == expected_files).alias("all_present"))


def profile(tables: dict[str, DataFrame], descriptions: list[tuple[str, str]]) -> DataFrame:
    """Column class, row count and the most specific matching description of each table."""
    def describe(name: str) -> str | None:
        hits = [(len(p), text) for p, text in descriptions if re.fullmatch(p, name)]
        return max(hits)[1] if hits else None

    parts = []
    for name, df in tables.items():
        cols = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("class")) for f in df.schema.fields])
        n = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(n.select(F.lit(name).alias("table_name"), F.explode(cols).alias("c"), "n_rows").select(
            "table_name", "c.column_name", "c.class", "n_rows", F.lit(describe(name)).cast("string").alias("description")))
    return reduce(DataFrame.unionByName, parts)
