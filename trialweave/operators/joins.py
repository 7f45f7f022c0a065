"""Joins: checked look-ups, pairing, reconciliation, clock/occurrence matching, as-of, interval tests."""

from __future__ import annotations

from collections import deque
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.operators.skew import (
    first_per_key, null_safe_join, scan_index, scan_last, scan_max, scan_shift, scan_sum, small_side, with_group_stats,
)
from trialweave.runtime import pin


def assert_unique(df: DataFrame, keys: list[str], what: str = "lookup") -> DataFrame:
    """Raise when a key repeats (one scalar reaches the driver)."""
    extra = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum((F.col("n") > 1).cast("int"))).first()[0]
    if extra:
        raise ValueError(f"{what}: {extra} repeated keys in {keys}")
    return df


def checked_left_join(df: DataFrame, dim: DataFrame, keys: list[str], what: str = "lookup") -> DataFrame:
    """Left join that cannot multiply rows: the key of the right side is verified first."""
    return df.join(small_side(assert_unique(dim, keys, what)), keys, "left")


def pair_with_report(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner pairs, and the unpaired keys of both sides with the missing side."""
    pairs = left.join(right, key)
    report = (
        left.join(right, key, "left_anti").select(key, F.lit("right").alias("missing"))
        .unionByName(right.join(left, key, "left_anti").select(key, F.lit("left").alias("missing")))
    )
    return pairs, report


def paired_difference(df: DataFrame, unit: list[str], condition: str, value: str, control: str, violation: str) -> DataFrame:
    """violation - control per unit holding both; one shuffle instead of a self-join."""
    g = df.groupBy(*unit).agg(
        F.max(F.when(F.col(condition) == control, F.col(value))).alias("control"),
        F.max(F.when(F.col(condition) == violation, F.col(value))).alias("violation"),
    )
    return g.filter("control is not null and violation is not null").withColumn(
        "difference", F.col("violation") - F.col("control")
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer match with the origin of each key."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    origin = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("origin", origin).drop("_l", "_r")


def clock_match(events: DataFrame, segments: DataFrame, keys: list[str], clock: str, event_id: str, segment_id: str,
                tolerance: int) -> DataFrame:
    """Pairs of the same key with |clock difference| <= tolerance, each side used once and as many pairs as possible.

    Both sides are read in clock order and each row takes the earliest row of the other side that is still free and
    near enough. Rows further apart than the tolerance cannot affect each other, so every stretch between such gaps
    is matched on its own, streamed from a sorted partition: only the free rows within one tolerance are held.
    Rows without a clock match nothing.
    """
    types = {c: t for df in (events, segments) for c, t in df.dtypes}
    side = lambda df, name, other, n: df.where(F.col(clock).isNotNull()).select(
        *keys, F.col(clock).alias("_t"), F.lit(n).alias("_side"), F.col(name).alias("_own"),
        *[(F.col(name) if c == name else F.lit(None).cast(types[c])).alias(f"_{c}") for c in (event_id, segment_id)])
    rows = side(events, event_id, segment_id, 0).unionByName(side(segments, segment_id, event_id, 1))
    order = ["_t", "_side", "_own"]
    rows = scan_shift(rows, keys, order, _before=F.col("_t"))
    rows = scan_sum(rows, keys, order, _stretch=(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > tolerance)).cast("int"))
    dealt = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", *order)
    dealt = dealt.select(*keys, "_stretch", "_t", "_side", f"_{event_id}", f"_{segment_id}")
    n = len(keys)
    schema = ", ".join([f"{event_id} {types[event_id]}", f"{segment_id} {types[segment_id]}", *[f"{k} {types[k]}" for k in keys], "clock_difference bigint"])

    def run(batches):
        free, group = deque(), None  # free rows are all of one side
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: n + 1] != group:
                    free.clear()
                    group = row[: n + 1]
                t, kind = row[n + 1], row[n + 2]
                while free and free[0][0] < t - tolerance:
                    free.popleft()
                if free and free[0][1] != kind:
                    other = free.popleft()
                    pair = (row, other[2]) if kind == 0 else (other[2], row)
                    out.append((pair[0][n + 3], pair[1][n + 4], *row[:n], t - other[0]))
                else:
                    free.append((t, kind, row))
            cols = list(zip(*out)) or [()] * (n + 3)
            kinds = [batch.schema.field(n + 3).type, batch.schema.field(n + 4).type, *[batch.schema.field(i).type for i in range(n)], pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[event_id, segment_id, *keys, "clock_difference"])

    return dealt.mapInArrow(run, schema)


def unique_fallback(events: DataFrame, segments: DataFrame, matched: DataFrame, keys: list[str], event_id: str,
                    segment_id: str, open_key: str | None = None) -> DataFrame:
    """Match leftovers by identity only where exactly one candidate is left on each side.

    An event whose ``open_key`` (one of ``keys``) is null is a candidate for any value of it. Counts per key decide
    uniqueness, so no candidate pairs are built.
    """
    def alone(df, by, name):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias(name))

    e = events.join(matched, event_id, "left_anti")
    s = alone(segments.join(matched, segment_id, "left_anti"), keys, segment_id).filter("_n = 1").drop("_n")
    if open_key is None:
        return alone(e, keys, event_id).filter("_n = 1").drop("_n").join(s, keys)
    rest = [k for k in keys if k != open_key]
    exact = alone(e.filter(F.col(open_key).isNotNull()), keys, event_id)
    any_ = alone(e.filter(F.col(open_key).isNull()), rest, event_id).withColumnsRenamed({"_n": "_m", event_id: "_any"})
    found = s.join(exact, keys, "left").join(any_, rest, "left").filter("coalesce(_n, 0) + coalesce(_m, 0) = 1")
    found = found.select(*keys, F.coalesce(event_id, "_any").alias(event_id), segment_id)
    once = found.groupBy(event_id).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return found.join(once, event_id)


def occurrence_join(left: DataFrame, right: DataFrame, key: list[str], short_key: list[str], order_l: list[str],
                    order_r: list[str], left_id: str, right_id: str) -> DataFrame:
    """k-th occurrence on the full key, then k-th occurrence of the leftovers on the shorter key."""
    def numbered(df, k, order):
        return scan_index(df, k, order, "occurrence")

    a = numbered(left, key, order_l).select(*key, "occurrence", left_id)
    b = numbered(right, key, order_r).select(*key, "occurrence", right_id)
    first = a.join(b, key + ["occurrence"]).select(left_id, right_id, F.lit("full key").alias("match_type"))
    rest_l = left.join(first, left_id, "left_anti")
    rest_r = right.join(first, right_id, "left_anti")
    a2 = numbered(rest_l, short_key, order_l).select(*short_key, "occurrence", left_id)
    b2 = numbered(rest_r, short_key, order_r).select(*short_key, "occurrence", right_id)
    second = a2.join(b2, short_key + ["occurrence"]).select(left_id, right_id, F.lit("short key").alias("match_type"))
    return first.unionByName(second)


def as_of_within_boundary(df, keys, order, boundary: Column, position: Column, **seen: Column) -> DataFrame:
    """Nearest preceding value of each expression since the last boundary row.

    A look-back is valid when its row lies after the last boundary, so one scan carries both.
    """
    rank = F.struct(*[F.col(c) for c in order])
    marks = {f"_m_{n}": F.when(c.isNotNull(), F.struct(rank.alias("at"), c.alias("v"), position.alias("pos")))
             for n, c in seen.items()}
    out = scan_last(df, keys, order, _bound=F.when(boundary, F.struct(rank.alias("at"))), **marks)
    for n in seen:
        m = F.col(f"_m_{n}")
        fresh = F.col("_bound").isNull() | (m["at"] > F.col("_bound.at"))
        out = out.withColumns({n: F.when(fresh, m["v"]), f"{n}_pos": F.when(fresh, m["pos"])})
    return out.drop("_bound", *marks)


def overlap_flag(epochs: DataFrame, bad: DataFrame, keys: list[str], epoch_id: str, name: str = "overlaps") -> DataFrame:
    """Whether a bad interval [start, stop) meets the epoch [start, stop).

    Among bad intervals that start before the epoch stops, the largest stop decides, so one
    ordered running maximum answers every epoch without building pairs.
    """
    a = epochs.select(*keys, F.col("stop").alias("_at"), F.lit(0).alias("_kind"), F.col(epoch_id).alias("_id"),
                      F.lit(None).cast("bigint").alias("_bad"), F.col("start").alias("_start"))
    b = bad.select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_id"),
                   F.col("stop").alias("_bad"), F.lit(None).cast("bigint").alias("_start"))
    both = scan_max(a.unionByName(b), keys, ["_at", "_kind", "_id", "_bad"], inclusive=False, _reach=F.col("_bad"))
    flags = both.filter("_kind = 0").select(*keys, F.col("_id").alias(epoch_id),
                                            F.coalesce(F.col("_reach") > F.col("_start"), F.lit(False)).alias(name))
    return epochs.join(flags, keys + [epoch_id], "left")


def points_in_segments(points: DataFrame, segments: DataFrame, keys: list[str], position: str, length: int) -> DataFrame:
    """Points inside fixed-length segments [start, start+length), with relative position (bucketed range join)."""
    p = points.withColumn("_b", F.floor(F.col(position) / length))
    s = segments.withColumn("_b", F.explode(F.array(F.floor(F.col("start") / length), F.floor(F.col("start") / length) + 1)))
    inside = (F.col(position) >= F.col("start")) & (F.col(position) < F.col("start") + length)
    return p.join(s, keys + ["_b"]).filter(inside).withColumn("relative", F.col(position) - F.col("start")).drop("_b")


def rotated_pairs(df: DataFrame, keys: list[str], order: list[str], value: str, other: str) -> DataFrame:
    """Control pairing: each row's ``other`` comes from the next row, the last row taking the first."""
    ranked = with_group_stats(scan_index(df, keys, order, "_i"), keys, _n=F.count(F.lit(1)))
    right = ranked.select(*keys, F.col("_i").alias("_j"), F.col(other).alias("rotated"))
    left = ranked.withColumn("_j", F.col("_i") % F.col("_n") + 1)
    return null_safe_join(left, right, keys + ["_j"], "inner").drop("_i", "_j", "_n")


def edge_distance(points: DataFrame, edges: DataFrame, keys: list[str], position: str, point_id: str) -> DataFrame:
    """Distance to the nearest edge on either side."""
    a = points.select(*keys, F.col(position).alias("_at"), F.col(point_id).alias("_id"), F.lit(None).cast("bigint").alias("_edge"))
    b = edges.select(*keys, F.col("edge").alias("_at"), F.lit(None).cast("bigint").alias("_id"), F.col("edge").alias("_edge"))
    u = a.unionByName(b)
    u = scan_last(u, keys, ["_at", "_id", "_edge"], _before=F.col("_edge"))
    u = scan_last(u, keys, ["_at", "_id", "_edge"], reverse=True, _after=F.col("_edge"))
    d = F.least(F.col("_at") - F.col("_before"), F.col("_after") - F.col("_at"))
    return u.filter("_id is not null").select(*keys, F.col("_id").alias(point_id), d.alias("edge_distance"))


class _Grams:
    """Numbers of the runs of 2^level codes that start at each position of two sequences, by doubling, per segment.

    A run of any length L between 2^level and 2^(level + 1) is known by two overlapping runs of 2^level, so whether two
    segments share a run of L is one equi-join with a row per position, and no pair of positions is built.
    """

    def __init__(self, a: DataFrame, b: DataFrame, keys: list[str]) -> None:
        self.keys = keys
        self.levels: list[tuple[DataFrame, DataFrame]] = [(a, b)]

    def double(self) -> None:
        step = 1 << (len(self.levels) - 1)

        def wider(df: DataFrame) -> DataFrame:
            after = df.select(*self.keys, (F.col("pos") - step).alias("pos"), F.col("gram").alias("_next"))
            return pin(null_safe_join(df, after, [*self.keys, "pos"], "inner").select(*self.keys, "pos", F.xxhash64("gram", "_next").alias("gram")))

        self.levels.append(tuple(wider(df) for df in self.levels[-1]))

    def shared(self, left: DataFrame, right: DataFrame, grams: list[str]) -> DataFrame:
        """Segments that have a run in common."""
        return null_safe_join(left.select(*self.keys, *grams).distinct(), right.select(*self.keys, *grams).distinct(), [*self.keys, *grams], "inner").select(*self.keys).distinct()

    def top(self) -> DataFrame:
        """(segment, level): the highest level at which the two sides still share a run."""
        found = pin(self.shared(*self.levels[0], ["gram"]).withColumn("level", F.lit(0)))
        while True:
            last = found.where(F.col("level") == len(self.levels) - 1)
            if last.isEmpty():
                return found
            self.levels[-1] = tuple(pin(null_safe_join(df, last.select(*self.keys), self.keys, "inner")) for df in self.levels[-1])
            self.double()
            more = self.shared(*self.levels[-1], ["gram"]).select(*self.keys, F.lit(len(self.levels) - 1).alias("_more"))
            found = pin(null_safe_join(found, more, self.keys).select(*self.keys, F.coalesce("_more", "level").alias("level")))

    def at(self, level: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Positions and runs of each segment at its own level."""
        parts = [[null_safe_join(side, level.where(F.col("level") == n), self.keys, "inner") for side in pair] for n, pair in enumerate(self.levels)]
        return tuple(pin(reduce(DataFrame.unionByName, [pair[k] for pair in parts])) for k in (0, 1))


def _longest_blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, size): per segment the longest common run, the earliest in a, then in b. Rows: keys, pos, gram."""
    grams = _Grams(a, b, keys)
    level = grams.top()
    a, b = grams.at(level)
    step = F.pow(F.lit(2), F.col("level")).cast("bigint")
    state = pin(level.select(*keys, step.alias("step"), step.alias("lo"), (2 * step).alias("hi")))

    def runs(side: DataFrame, length: DataFrame) -> DataFrame:
        own = null_safe_join(side, length, keys, "inner")
        after = own.select(*keys, (F.col("pos") - F.col("size") + F.col("step")).alias("pos"), F.col("gram").alias("last"))
        return null_safe_join(own, after, [*keys, "pos"], "inner").select(*keys, "pos", "size", "gram", "last")

    while not (open_ := state.where("hi - lo > 1")).isEmpty():  # all segments halve their range at once
        middle = open_.select(*keys, "step", F.floor((F.col("lo") + F.col("hi")) / 2).alias("size"))
        has = grams.shared(runs(a, middle), runs(b, middle), ["gram", "last"]).withColumn("_has", F.lit(True))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        wide = F.col("hi") - F.col("lo") > 1
        state = pin(null_safe_join(state, has, keys).select(*keys, "step", F.when(wide & F.col("_has"), mid).otherwise(F.col("lo")).alias("lo"), F.when(wide & F.col("_has").isNull(), mid).otherwise(F.col("hi")).alias("hi")))
    size = state.select(*keys, "step", F.col("lo").alias("size"))
    first = [runs(side, size).groupBy(*keys, "size", "gram", "last").agg(F.min("pos").alias(n)) for side, n in ((a, "i"), (b, "j"))]
    both = null_safe_join(*first, [*keys, "size", "gram", "last"], "inner")
    return both.groupBy(*keys).agg(F.min(F.struct("i", "j", "size")).alias("_m")).select(*keys, "_m.i", "_m.j", "_m.size")


def align_sequences(left: DataFrame, right: DataFrame, unit: list[str], order: str, code: str, left_id: str, right_id: str, task_rows: int = 20_000) -> DataFrame:
    """Order-preserving pairs of equal codes by longest matching blocks, per recording unit.

    The longest common run splits both sequences, and what lies before and after it is aligned in the same way. Segments
    of more than ``task_rows`` rows are split across tasks, all at once per round, by doubling run numbers; what is left
    is aligned segment by segment. Blocks that touch on both sides are one.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = scan_index(df.select(*unit, F.col(order).alias("_o"), F.col(code).alias("_code"), F.col(name).alias("_id")), unit, ["_o", "_id"], "pos")
        return pin(rows.select(*unit, F.lit(0).cast("bigint").alias("_seg"), (F.col("pos") - 1).alias("pos"), "_code", "_id"))

    a, b = side(left, left_id), side(right, right_id)
    keys, pairs = [*unit, "_seg"], None

    while True:
        sizes = a.unionByName(b).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        large = pin(sizes.where(F.col("_n") > task_rows).select(*keys))
        if large.isEmpty():
            break
        gram = lambda df: null_safe_join(df, large, keys, "inner").select(*keys, "pos", F.xxhash64("_code").alias("gram"))
        blocks = pin(_longest_blocks(pin(gram(a)), pin(gram(b)), keys))
        inside = lambda df, at: null_safe_join(df, blocks, keys, "inner").where(F.col("pos").between(F.col(at), F.col(at) + F.col("size") - 1))
        hit_a = inside(a, "i").select(*keys, (F.col("pos") - F.col("i")).alias("_k"), F.col("pos").alias("_i"), F.col("_id").alias(left_id))
        hit_b = inside(b, "j").select(*keys, (F.col("pos") - F.col("j")).alias("_k"), F.col("pos").alias("_j"), F.col("_id").alias(right_id))
        hits = pin(null_safe_join(hit_a, hit_b, [*keys, "_k"], "inner").drop("_seg", "_k"))
        pairs = hits if pairs is None else pairs.unionByName(hits)

        def rest(df: DataFrame, at: str) -> DataFrame:
            """Rows before and after the block, in a segment named by where it begins on the left; large ones without a block are done."""
            j = null_safe_join(null_safe_join(df, large.withColumn("_large", F.lit(True)), keys), blocks, keys)
            j = j.where("_large IS NULL OR i IS NOT NULL").where(F.col("i").isNull() | (F.col("pos") < F.col(at)) | (F.col("pos") >= F.col(at) + F.col("size")))
            after = F.col("i").isNotNull() & (F.col("pos") > F.col(at))
            return pin(j.select(*unit, F.when(after, F.col("i") + F.col("size")).otherwise(F.col("_seg")).alias("_seg"), "pos", "_code", "_id"))

        a, b = rest(a, "i"), rest(b, "j")

    types = {f.name: f.dataType.simpleString() for f in (*a.schema.fields, *left.schema.fields, *right.schema.fields)}
    schema = ", ".join(f"{u} {types[u]}" for u in unit) + f", _i bigint, _j bigint, {left_id} {types[left_id]}, {right_id} {types[right_id]}"

    def align(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.sort_by("pos"), y.sort_by("pos")
        match = SequenceMatcher(None, x.column("_code").to_pylist(), y.column("_code").to_pylist(), autojunk=False) if x.num_rows and y.num_rows else None
        blocks = match.get_matching_blocks() if match else []
        at = [pa.array([block[k] + n for block in blocks for n in range(block.size)], pa.int64()) for k in (0, 1)]
        named = [(x, left_id, at[0]), (y, right_id, at[1])]
        units = [x.column(u).take(at[0]) for u in unit]
        return pa.Table.from_arrays([*units, *(t.column("pos").take(i) for t, _, i in named), *(t.column("_id").take(i) for t, _, i in named)], names=[*unit, "_i", "_j", left_id, right_id])

    small = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(align, schema)
    found = pin(small if pairs is None else small.unionByName(pairs.select(small.columns)))
    found = scan_shift(found, unit, ["_i"], _pi=F.col("_i"), _pj=F.col("_j"))
    new = F.col("_pi").isNull() | (F.col("_i") != F.col("_pi") + 1) | (F.col("_j") != F.col("_pj") + 1)
    found = scan_sum(found.withColumn("_new", new.cast("bigint")), unit, ["_i"], _block=F.col("_new"))
    return found.select(*unit, left_id, right_id, (F.col("_block") - 1).cast("int").alias("block_no"))
