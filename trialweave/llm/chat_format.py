"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal conversations are: at most one system turn first, then user and assistant in turn, ending with the assistant.
Each given turn can keep its role, be merged into the turn before it (same role), or take another role; empty turns can
be inserted before it or at the end. The cheapest legal sequence is found by dynamic programming over the automaton's
states. Every turn is a small matrix of state-to-state costs and such matrices can be multiplied (minimum, plus), so a
conversation may lie in several partitions: rows are range-partitioned by conversation and turn, each partition folds
its stretch of a conversation into one matrix, the few matrices of a conversation are chained, and each partition then
repairs its stretch between the two states it was given. No conversation, however long, is gathered in one task.

The output has one row per given turn, in order, with the inserted empty turns it needs before it: rendered parts
concatenated by (conversation, position) give the formatted conversation, whose last part closes it.

Defined results: rows are ordered by turn, then role, then a hash of the text, nulls first; repeated rows are turns of their own;
unknown or null roles must be relabelled (at ``RELABEL`` cost); null texts render as empty; a conversation of system
turns alone gets the missing turns; null conversation ids form one conversation; an empty table stays empty; extra
columns are left out. Ties are broken by state order and by keep, merge, relabel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import shuffle_width, table
from trialweave.runtime import pin

ROLES = ("system", "user", "assistant")
START, N_STATES = 0, 4  # states: nothing yet, then the role of the last turn
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # legal next states
FINAL = 3
MERGE, RELABEL, INSERT = 2, 3, 4
BIG = 1 << 40


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns (as states) between two states, the target excluded, for every pair that can follow."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for start in range(N_STATES):
        paths = [((), start)]
        while paths:
            longer = []
            for path, at in paths:
                for to in NEXT[at]:
                    if (start, to) not in out:
                        out[start, to] = path
                        longer.append(((*path, to), to))
            paths = longer
    return out


BETWEEN = _insertions()


def turn_options(role: str | None) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, action) of one given turn."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for before in range(N_STATES):
        for after in range(1, N_STATES):
            change = 0 if after == own else RELABEL
            if (before, after) in BETWEEN:
                out.append((before, after, change + INSERT * len(BETWEEN[before, after]), "keep" if after == own else "relabel"))
            if before == after:
                out.append((before, after, change + MERGE, "merge"))
    return out


def _best(options) -> dict[tuple[int, int], tuple[int, str]]:
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before, after, cost, action in sorted(options, key=lambda o: (o[2], rank[o[3]])):
        best.setdefault((before, after), (cost, action))
    return best


STEPS = {role: _best(turn_options(role)) for role in (*ROLES, None)}
COSTS = {role: np.array([[steps.get((i, j), (BIG, ""))[0] for j in range(N_STATES)] for i in range(N_STATES)]) for role, steps in STEPS.items()}
#: Cost of ending in each state: the empty turns up to and including the assistant's.
CLOSE = np.array([0 if s == FINAL else INSERT * (len(BETWEEN[s, FINAL]) + 1) for s in range(N_STATES)])


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def fold(roles: list[str | None]) -> np.ndarray:
    """Cost matrix of a stretch of turns: least cost from each state to each state."""
    total = np.where(np.eye(N_STATES, dtype=bool), 0, BIG)
    for role in roles:
        total = (total[:, :, None] + COSTS[known(role)][None]).min(axis=1)
    return np.minimum(total, BIG)


def repair(roles: list[str | None], first: int, last: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """Cheapest way from state ``first`` to ``last``: per turn its state, action and the states inserted before it."""
    costs, came = np.full(N_STATES, BIG), []
    costs[first] = 0
    for role in roles:
        options = costs[:, None] + COSTS[known(role)]
        came.append(options.argmin(axis=0))
        costs = options.min(axis=0)
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        before = int(came[i][state])
        action = STEPS[known(roles[i])][before, state][1]
        out.append((state, action, () if action == "merge" else BETWEEN[before, state]))
        state = before
    return out[::-1]


def tag(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


def render(state: int, action: str, inserted: tuple[int, ...], text: str | None, opens: bool) -> str:
    """A turn's part of the conversation; ``opens`` marks the first part, every other closes the message before it."""
    if action == "merge":
        return f"\n{text or ''}"
    parts = [tag(s) for s in inserted] + [tag(state)]
    return ("" if opens else "<|end|>\n") + "<|end|>\n".join(parts) + (text or "")


def closing(state: int) -> str:
    more = () if state == FINAL else (*BETWEEN[state, FINAL], FINAL)
    return "".join(f"<|end|>\n{tag(s)}" for s in more) + "<|end|>\n"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """conv, turn, position (from 0), role (repaired), action, inserted (empty turns before it), cost (of the whole conversation), rendered."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conv_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    # the row number breaks ties, so that many equal rows still spread over partitions
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "tie", "row"]
    width = parts or shuffle_width(turns)
    ranged = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order)
    ranged = pin(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    def stretches(frame: pa.Table, by: str) -> Iterator[tuple[int, int]]:
        """Bounds of equal neighbours."""
        values = frame[by].to_pylist()
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                yield start, i
                start = i

    def folded(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("place")
        roles, own = frame["role"].to_pylist(), list(stretches(frame, "conv"))
        costs = [fold(roles[i:j]).ravel().tolist() for i, j in own]
        firsts = pa.array([i for i, _ in own], pa.int64())
        return pa.table({"conv": frame["conv"].take(firsts), "part": frame["part"].take(firsts), "n": pa.array([j - i for i, j in own], pa.int64()), "cost": pa.array(costs, pa.list_(pa.int64()))})

    # a group is one range partition; a conversation has one row in each partition that it reaches
    matrices = pin(ranged.select("conv", "part", "place", "role").groupBy("part").applyInArrow(folded, f"conv {conv_type}, part int, n bigint, cost array<bigint>"))

    def chained(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([("conv", "ascending"), ("part", "ascending")])
        every, n, out = frame["cost"].to_pylist(), frame["n"].to_pylist(), {k: [] for k in ("first", "last", "begin", "ends", "total")}
        for i, j in stretches(frame, "conv"):
            costs = [np.array(c).reshape(N_STATES, N_STATES) for c in every[i:j]]
            ahead = [CLOSE]  # least cost from each state after a stretch to the end
            for c in reversed(costs):
                ahead.append((c + ahead[-1]).min(axis=1))
            ahead.reverse()
            state, done = START, 0
            for k, c in enumerate(costs):
                last = int((c[state] + ahead[k + 1]).argmin())
                for name, value in (("first", state), ("last", last), ("begin", done), ("ends", k == len(costs) - 1), ("total", int(ahead[0][START]))):
                    out[name].append(value)
                state, done = last, done + n[i + k]
        kinds = {"first": pa.int32(), "last": pa.int32(), "begin": pa.int64(), "ends": pa.bool_(), "total": pa.int64()}
        return pa.table({"_c": frame["conv"], "_p": frame["part"], **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    bucket = F.pmod(F.xxhash64("conv"), F.lit(64 * width))
    plan = pin(matrices.groupBy(bucket.alias("_bucket")).applyInArrow(chained, f"_c {conv_type}, _p int, first int, last int, begin bigint, ends boolean, total bigint"))
    joined = ranged.join(plan, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")

    def repaired(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("place")
        roles, texts = frame["role"].to_pylist(), frame["text"].to_pylist()
        plans = {n: frame[n].to_pylist() for n in ("first", "last", "begin", "ends")}
        steps, shown, position = [], [], []
        for i, j in stretches(frame, "conv"):
            own = repair(roles[i:j], plans["first"][i], plans["last"][i])
            begin = plans["begin"][i]
            shown += [render(s, a, ins, text, begin + k == 0) for k, ((s, a, ins), text) in enumerate(zip(own, texts[i:j]))]
            if plans["ends"][i]:
                shown[-1] += closing(own[-1][0])
            steps += own
            position += range(begin, begin + j - i)
        return pa.table({
            "conv": frame["conv"], "turn": frame["turn"], "position": pa.array(position, pa.int64()), "role": pa.array([ROLES[s - 1] for s, _, _ in steps], pa.string()),
            "action": pa.array([a for _, a, _ in steps], pa.string()), "inserted": pa.array([len(i) for _, _, i in steps], pa.int32()), "cost": frame["total"], "rendered": pa.array(shown, pa.string()),
        })

    schema = f"conv {conv_type}, turn {turn_type}, position bigint, role string, action string, inserted int, cost bigint, rendered string"
    return joined.groupBy("part").applyInArrow(repaired, schema)


@query("op1_chat_format")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = format_chats(table(spark, sf_dir, "conversations"))
    return shown.select(F.col("conv").alias("conv_id"), "turn", "position", "role", "action", "inserted", "cost", F.length("rendered").alias("n_chars"), F.md5("rendered").alias("rendered_md5"))
