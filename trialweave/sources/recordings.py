"""Recording files: marker text, header text, vectorised-ASCII samples, multiplexed float32, export inventory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.functions import design as d
from trialweave.operators.skew import groups_fit, scan_sum

# The marker-line and code formats.
MARKER_LINE = r"^Mk(\d+)=([^,]*),([^,]*),(-?\d+),(-?\d+),(-?\d+)(?:,(\d*))?"
CODE = r"^S\s*(\d+)$"
STAMP = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{6})$"


def marker_fields(text: DataFrame, line: str = "value") -> DataFrame:
    """Markers of text lines: number, type, description, code, 0-based position, length, date; other lines vanish."""
    v = F.trim(F.col(line))
    g = lambda i: F.regexp_extract(v, MARKER_LINE, i)
    comma = lambda c: F.replace(c, F.lit("\\1"), F.lit(","))
    desc = comma(g(3))
    return text.filter(v.rlike(MARKER_LINE)).withColumns({
        "seq": g(1).cast("bigint"), "type": comma(g(2)), "description": desc, "code": F.nullif(F.regexp_extract(F.trim(desc), CODE, 1), F.lit("")).cast("int"),
        "position": g(4).cast("bigint") - 1, "length": g(5).cast("bigint"), "date": F.nullif(g(7), F.lit(""))}).drop(line)


def stamp_micros(col: str):
    """Compact clock YYYYMMDDhhmmssuuuuuu to microseconds (no zone)."""
    g = lambda i: F.regexp_extract(col, STAMP, i)
    day = F.datediff(F.make_date(g(1).cast("int"), g(2).cast("int"), g(3).cast("int")), F.lit("1970-01-01")).cast("bigint")
    us = day * 86_400_000_000 + g(4).cast("bigint") * 3_600_000_000 + g(5).cast("bigint") * 60_000_000 + g(6).cast("bigint") * 1_000_000 + g(7).cast("bigint")
    return F.when(F.col(col).rlike(STAMP), us)


def read_markers(spark: SparkSession, path: str, **options) -> DataFrame:
    text = spark.read.options(**options).text(path).withColumn("file", F.col("_metadata.file_path"))
    return marker_fields(text)


def read_headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per header file: channel count, interval, points, channel names and resolutions."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return header_fields(t.withColumn("file", F.col("_metadata.file_path")))


def header_fields(text: DataFrame, body: str = "value") -> DataFrame:
    v = F.split_part(F.col(body), F.lit("[Comment]"), F.lit(1))
    one = lambda k: F.nullif(F.regexp_extract(v, rf"(?m)^{k}=(.*?)\s*$", 1), F.lit(""))
    line = r"(?m)^Ch\d+=(.*?)\s*$"
    chans = F.transform(F.regexp_extract_all(v, F.lit(line), F.lit(1)), lambda c: F.split(c, ","))
    return text.withColumns({
        "n_channels": one("NumberOfChannels").try_cast("int"), "interval_us": one("SamplingInterval").try_cast("double"), "data_points": one("DataPoints").try_cast("bigint"),
        "segment_points": one("SegmentDataPoints").try_cast("bigint"), "orientation": one("DataOrientation"), "data_file": one("DataFile"),
        "channels": F.transform(chans, lambda p: F.replace(p[0], F.lit("\\1"), F.lit(","))),
        "resolutions": F.transform(chans, lambda p: F.coalesce(F.nullif(F.get(p, F.lit(2)), F.lit("")).try_cast("double"), F.lit(1.0)))}).drop(body)


def ascii_samples(text: DataFrame, samples_per_trial: int, first_ms: int, step_ms: int, line: str = "value") -> DataFrame:
    """One row per sensor, trial and sample of 'name v v v ...' lines with a decimal comma.

    Slicing by trial before the explode keeps each row small; a filter on ``time_ms`` prunes inside it.
    """
    parts = F.split(F.trim(F.col(line)), r"\s+")
    n = samples_per_trial
    t = text.withColumns({"sensor": parts[0], "_v": F.slice(parts, F.lit(2), F.size(parts) - 1)})
    t = t.filter("size(_v) > 0").withColumn("_ok", F.assert_true(F.size("_v") % n == 0, F.lit("columns do not align with trials and time points")))
    trials = F.transform(F.sequence(F.lit(0), (F.size("_v") / n).cast("int") - 1), lambda i: F.slice(F.col("_v"), i * n + 1, F.lit(n)))
    t = t.filter(F.col("_ok").isNull()).select(*[c for c in text.columns if c != line], "sensor", F.posexplode(trials).alias("trial_no", "_s"))
    t = t.select("*", F.posexplode("_s").alias("sample_no", "_x")).drop("_s")
    return t.withColumns({"time_ms": F.lit(first_ms) + F.col("sample_no") * step_ms, "amplitude": F.regexp_replace("_x", ",", ".").try_cast("double")}).drop("_x")


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return ascii_samples(text, d.SAMPLES_PER_TRIAL, d.EPOCH_MS[0], d.SAMPLE_STEP_MS)


def decode_multiplexed(df: DataFrame, key: str, content: str, resolutions: list[float]) -> DataFrame:
    """Channels x samples of little-endian float32 multiplexed bytes, scaled per channel."""
    n = len(resolutions)
    scale = np.array(resolutions, dtype=np.float32)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, raw in zip(pdf[key], pdf[content]):
                x = np.frombuffer(raw, dtype="<f4")
                if x.size % n:
                    raise ValueError(f"{k}: size is not a multiple of the channel count")
                data = (x.reshape(-1, n).T * scale[:, None]).astype(float)
                out += [(k, c, data[c].tolist()) for c in range(n)]
            yield pd.DataFrame(out, columns=[key, "channel", "samples"])

    return df.select(key, content).mapInPandas(run, f"{key} {key_type}, channel int, samples array<double>")


def export_inventory(values: DataFrame, headers: DataFrame, markers: DataFrame, wanted: DataFrame, segment: int) -> DataFrame:
    """One row per stem: which files it has, its number of segments from three sources, and what its segments hold.

    ``values`` (stem, value: 'name v v ...'), ``headers`` (stem, value: a whole header), ``markers`` (stem, line, value),
    ``wanted`` (stem, cond_code). Segments come from the header's points, from the marker lines and from the values of a
    line; a marker belongs to the last "New Segment" before it. ``wanted`` has one row per stem.
    """
    h = header_fields(headers).groupBy("stem").agg(F.max(F.col("data_points") / F.col("segment_points")).alias("n_seg_vhdr"), F.lit(1).alias("has_vhdr"))
    t = values.groupBy("stem").agg((F.max(F.size(F.split(F.trim("value"), r"\s+")) - 1) / segment).alias("n_seg_txt"), F.lit(1).alias("has_txt"))
    code, stimulus = F.col("code"), F.col("type") == "Stimulus"
    sentence = stimulus & code.between(*d.SENTENCE_CODES)
    condition = F.when(stimulus & code.isin(*d.CONDITION_CODES), code)
    kinds = {"_new": F.col("type") == "New Segment", "_zero": F.col("type") == "Time 0", "_sentence": F.when(sentence, code - d.SENTENCE_CODES[0]), "_cond": condition}
    m = marker_fields(markers).select("stem", "line", *[c.alias(n) for n, c in kinds.items()])
    chunked = not groups_fit(markers.select("stem"), ["stem"])  # no fewer lines than markers, and nothing to parse
    m = scan_sum(m, ["stem"], ["line"], chunked=chunked, _seg=F.col("_new").cast("bigint"))
    # markers stay in one pass: counts per condition code, of which each stem takes its own, and the sentence codes seen as bits
    span = d.SENTENCE_CODES[1] - d.SENTENCE_CODES[0] + 1
    bits = {f"_bits{w}": F.when(F.floor(F.col("_sentence") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_sentence") % 64)) for w in range(-(-span // 64))}
    of = {c: f"_c{c}" for c in d.CONDITION_CODES}
    each = m.groupBy("stem", "_seg").agg(
        F.count_if("_new").alias("new"), F.count("_sentence").alias("sentences"), F.count_if("_zero").alias("zeros"),
        *[F.count_if(F.col("_cond") == c).alias(n) for c, n in of.items()], *[F.bit_or(c).alias(n) for n, c in bits.items()])
    one = lambda c: F.count_if(F.col(c) == 1)
    per = each.groupBy("stem").agg(
        F.sum("new").alias("n_newseg"), F.sum("sentences").alias("sentence_lines"), one("sentences").alias("segs_one_sentence"), one("zeros").alias("segs_one_time0"),
        *[one(n).alias(f"_one{n}") for n in of.values()], *[F.sum(n).alias(f"_all{n}") for n in of.values()], *[F.bit_or(n).alias(n) for n in bits])
    own = lambda kind: sum((F.when(F.col("cond_code") == c, F.col(f"_{kind}{n}")).otherwise(0) for c, n in of.items()), F.lit(0).cast("bigint"))
    others = sum((F.when(F.col("cond_code") != c, F.col(f"_all{n}")).otherwise(0) for c, n in of.items()), F.lit(0).cast("bigint"))
    codes = sum((F.coalesce(F.bit_count(n), F.lit(0)).cast("bigint") for n in bits), F.lit(0).cast("bigint"))
    segs = per.join(wanted, "stem").select("stem", "n_newseg", "sentence_lines", "segs_one_sentence", own("one").alias("segs_one_cond"), "segs_one_time0",
                                           others.alias("wrong_cond"), F.nullif(codes, F.lit(0)).alias("distinct_codes"), F.lit(1).alias("has_vmrk"))
    g = t.join(h, "stem", "full").join(segs, "stem", "full")
    has = [f"has_{e}" for e in ("txt", "vhdr", "vmrk")]
    g = g.na.fill(0, has).withColumn("complete", sum((F.col(c) for c in has), F.lit(0)) == len(has))
    agree = F.coalesce((F.col("n_seg_vhdr") == F.col("n_newseg")) & (F.col("n_newseg") == F.col("n_seg_txt")), F.lit(False))
    counts = ["sentence_lines", "distinct_codes", "segs_one_sentence", "segs_one_cond", "segs_one_time0", "wrong_cond"]
    return g.select("stem", *has, "complete", "n_seg_vhdr", "n_newseg", "n_seg_txt", agree.alias("counts_agree"), *counts)


def deletions(name: Column, edits: int) -> Column:
    """Every text that ``name`` leaves when up to ``edits`` characters go."""
    def less(x: Column) -> Column:
        """Each text with one character less, from the place of the last cut on: no set of places is cut twice."""
        s, at = x["text"], x["at"]
        places = F.when(at <= F.length(s), F.sequence(at, F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))).alias("text"), i.alias("at")))

    out = level = F.array(F.struct(name.alias("text"), F.lit(1).alias("at")))
    for _ in range(edits):
        level = F.flatten(F.transform(level, less))
        out = F.concat(out, level)
    return F.array_distinct(F.transform(out, lambda x: x["text"]))


def near_names(names: DataFrame, known: DataFrame, edits: int = 2) -> DataFrame:
    """(name, near, edits): unknown names within ``edits`` edits of a known one.

    Names that near leave a common text when each loses up to ``edits`` characters, so they meet in an equi-join on the
    hash of what is left; no name is held against every other. Either side has hundreds of keys a name, which size
    estimates do not see, so the join is a sorted one and never sends a side through the driver.
    """
    keys = lambda c: F.explode(F.array_distinct(F.transform(deletions(F.col(c), edits), lambda x: F.xxhash64(x)))).alias("_key")
    strange = names.select("name").distinct().join(known, "name", "left_anti")
    left = strange.select("name", keys("name"))
    right = known.select(F.col("name").alias("near")).distinct()
    right = right.select("near", keys("near"))
    pairs = left.join(right.hint("merge"), "_key").where(F.levenshtein("name", "near", edits) >= 0)
    return pairs.select("name", "near").distinct().withColumn("edits", F.levenshtein("name", "near"))
