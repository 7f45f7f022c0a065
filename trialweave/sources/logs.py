"""Delimited behavioural logs: discovery, per-file delimiter, null tokens, truncation, export priority."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.functions import design as d
from trialweave.operators.recode import blank_to_null
from trialweave.operators.skew import scan_sum
from trialweave.runtime import pin

# The log-file name rule.
LOG_NAME = r"(?i)subject-([0-9]+)(-[A-Za-z]+)?\.csv$"


def list_files(spark: SparkSession, root: str, pattern: str = ".*", glob: str | None = None) -> DataFrame:
    """Files under a root with their size, keyed by path relative to it (content is never read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    f = reader.load(root).select("path", "length")
    rel = F.regexp_replace("path", "^.*?" + _literal(root.rstrip("/")) + "/", "")
    return f.select("path", rel.alias("relative"), "length").filter(F.regexp_extract("relative", r"[^/]+$", 0).rlike(pattern))


def _literal(text: str) -> str:
    return "\\Q" + text.replace("file:", "") + "\\E"


def log_listing(spark: SparkSession, root: str) -> DataFrame:
    """Log files with session, lab id and part; names the rule does not know keep null ids."""
    return log_fields(list_files(spark, root, r"(?i)\.csv$"))


def log_fields(files: DataFrame) -> DataFrame:
    """Session, lab id and part from the relative path."""
    name = F.regexp_extract("relative", r"[^/]+$", 0)
    known = name.rlike("^" + LOG_NAME)
    part = F.lower(F.regexp_replace(F.regexp_extract(name, LOG_NAME, 2), "^-", ""))
    return files.select(
        "*", name.alias("file"), F.nullif(F.regexp_extract("relative", r"Session[ =]([0-9]+)", 1), F.lit("")).try_cast("int").alias("session"),
        F.when(known, F.regexp_extract(name, LOG_NAME, 1)).try_cast("bigint").alias("entity"), F.when(known, part).alias("part"))


def _plain_path(path: Column) -> Column:
    """File path as the readers take it (the metadata column percent-encodes blanks and the like)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def delimiters(spark: SparkSession, paths) -> DataFrame:
    """Delimiter of each file from its header line: ';' wins when it outnumbers ','."""
    t = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        _plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_id"))
    head = t.filter("_start = 0").groupBy("file").agg(F.min_by("value", "_id").alias("header"))
    semi, comma = F.regexp_count("header", F.lit(";")), F.regexp_count("header", F.lit(","))
    return head.select("file", "header", F.when(semi > comma, ";").otherwise(",").alias("delimiter"))


def _scan(spark: SparkSession, files: list[str], sep: str, cols: list[str] | None) -> DataFrame:
    raw = spark.read.option("header", "true").option("sep", sep).option("inferSchema", "false").option("enforceSchema", "false").csv(files)
    use = [c for c in raw.columns if cols is None or c in cols]
    # file, block and position in the block order the rows as they stand in the file
    return raw.select(*use, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def read_logs(spark: SparkSession, paths, cols: list[str] | None = None, delimiter: str | None = None, nulls: tuple[str, ...] = d.NULL_TOKENS) -> DataFrame:
    """All-string log rows; each file is read with its own delimiter and header, absent columns become null."""
    info = delimiters(spark, paths).collect()  # one short row per file: the file list itself
    groups: dict[tuple[str, str], list[str]] = {}
    for r in info:
        sep = delimiter or r["delimiter"]
        groups.setdefault((sep, r["header"]), []).append(r["file"])
    parts = [_scan(spark, files, sep, cols) for (sep, _), files in sorted(groups.items())]
    return blank_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), nulls)


def split_records(lines: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Records of text lines: a line that begins inside an open quotation belongs to the record before it.

    Whether a quotation is open is the parity of the quotation marks so far, a running sum per file that crosses the
    borders of blocks and tasks. Returns keys, ``at`` (order of the record's first line) and the record's text.
    """
    marks = F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))
    d = scan_sum(lines, keys, order, inclusive=False, _marks=marks)
    d = d.withColumn("_new", (F.coalesce("_marks", F.lit(0)) % 2 == 0).cast("bigint"))
    d = scan_sum(d, keys, order, _record=F.col("_new"))
    parts = d.groupBy(*keys, "_record").agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_l"))
    return parts.select(*keys, F.struct(*[F.col("_l")[0][c].alias(c) for c in order]).alias("at"), F.array_join(F.transform("_l", lambda x: x[value]), "\n").alias(value))


def read_truncated(spark: SparkSession, paths, schema: str, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of possibly cut files (a quoted field may hold line breaks) and a note per file.

    A short record inside a file is kept with nulls for what it lacks; a short record at the end of a file was cut by
    the transfer and is dropped. The note has n_records, n_padded and n_cut (0 or 1).
    """
    t = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    t = split_records(pin(t), ["file"], ["_block", "_row"])
    if header is not None:
        t = t.filter(F.col("value") != header)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true", "escape": '"'}
    r = pin(t.select("file", "at", F.from_csv("value", schema + ", _corrupt string", opts).alias("r")).withColumn("_short", F.col("r._corrupt").isNotNull()))
    last = r.groupBy("file").agg(F.max(F.struct("at", "_short")).alias("last"), F.count(F.lit(1)).alias("n_records"), F.count_if("_short").alias("n_short"))
    cut = F.col("last._short").cast("bigint")
    note = last.select("file", "n_records", (F.col("n_short") - cut).alias("n_padded"), cut.alias("n_cut"))
    ends = last.filter("last._short").select("file", F.col("last.at").alias("at"))
    kept = r.join(ends, ["file", "at"], "left_anti")
    return kept.select("file", "r.*").drop("_corrupt"), note


def batch_first(batch: DataFrame, named: DataFrame, entity: str) -> DataFrame:
    """Batch exports win; named exports count only for ids the batch lacks; rows distinct."""
    rest = named.join(batch.select(entity).distinct(), entity, "left_anti")
    return batch.unionByName(rest, allowMissingColumns=True).distinct()


def check_layout(raw: DataFrame, row: str, cells: dict[tuple[int, str], str]) -> DataFrame:
    """``raw`` when its header cells still match: {(row number, column): pattern}; line breaks count as blanks. Else stops, naming the first that does not.

    Positional reads go by column number, so they would silently take the wrong columns of a changed file.
    """
    heads = raw.where(F.col(row).isin(sorted({n for n, _ in cells})))
    text = lambda n, c: F.max(F.when(F.col(row) == n, F.trim(F.regexp_replace(F.col(c).cast("string"), "[\r\n]+", " "))))
    found = heads.agg(*[F.coalesce(text(n, c).rlike(p), F.lit(False)).alias(f"c{i}") for i, ((n, c), p) in enumerate(cells.items())]).first()
    for ok, ((n, c), p) in zip(found, cells.items()):
        if not ok:
            raise ValueError(f"row {n}, column {c} does not match {p!r}: the layout has changed")
    return raw


def locate_columns(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Columns found by header pattern; stops unless each pattern names exactly one."""


    out = []
    for name, pattern in patterns.items():
        hits = [c for c in df.columns if re.search(pattern, c, re.I)]
        if len(hits) != 1:
            raise ValueError(f"header pattern {pattern!r} names {len(hits)} columns")
        out.append(F.col(f"`{hits[0]}`").alias(name))
    return df.select(*out)


