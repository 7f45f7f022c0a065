"""Role repair against exhaustive search, and the same results for any partitioning."""

from itertools import product

import pytest
from hypothesis import given, settings, strategies as st

from trialweave.llm import chat_format as C

ROLE = st.sampled_from([*C.ROLES, "tool", None])


def cost_by_search(roles):
    """Least cost over every choice of states, merges and empty turns (at most two before each turn)."""
    best = None
    for states in product(range(1, C.N_STATES), repeat=len(roles)):
        for merges in product((False, True), repeat=len(roles)):
            total, at = 0, C.START
            for role, s, merge in zip(roles, states, merges):
                own = C.ROLES.index(role) + 1 if role in C.ROLES else 0
                total += 0 if s == own else C.RELABEL
                if merge:
                    if at != s:
                        total = None
                        break
                    total += C.MERGE
                else:
                    ways = [k for k in range(4) for path in product(range(1, C.N_STATES), repeat=k) if all(b in C.NEXT[a] for a, b in zip((at, *path), (*path, s)))]
                    if not ways:
                        total = None
                        break
                    total += C.INSERT * min(ways)
                at = s
            if total is None:
                continue
            total += int(C.CLOSE[at])
            best = total if best is None else min(best, total)
    return best


@given(st.lists(ROLE, min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_least_cost(roles):
    total = C.fold(roles)
    assert int((total[C.START] + C.CLOSE).min()) == cost_by_search(roles)


@given(st.lists(ROLE, min_size=2, max_size=12), st.integers(1, 11))
@settings(max_examples=40, deadline=None)
def test_repair_is_legal_and_folds_combine(roles, cut):
    cut = min(cut, len(roles) - 1)
    whole, left, right = C.fold(roles), C.fold(roles[:cut]), C.fold(roles[cut:])
    assert (whole == (left[:, :, None] + right[None]).min(axis=1).clip(max=C.BIG)).all()
    last = int((whole[C.START] + C.CLOSE).argmin())
    at = C.START
    for state, action, inserted in C.repair(roles, C.START, last):
        if action == "merge":
            assert state == at
        else:
            for s in (*inserted, state):
                assert s in C.NEXT[at]
                at = s
    assert at == last


def _rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, position string")


DATA = [(1, 0, "user", "a", "x"), (1, 1, "user", "b", "x"), (1, 2, "assistant", "c", None), (2, 0, "assistant", "d", None), (2, 0, "assistant", "d", None), (None, 0, None, None, None), (3, None, "tool", "", "")]
DATA += [(4, i, ("user", "assistant", "user")[i % 3], f"t{i}", None) for i in range(200)]


@pytest.mark.parametrize("parts", [1, 7])
def test_any_partitioning(spark, parts):
    out = C.format_chats(_rows(spark, DATA), parts=parts).toPandas().sort_values(["conv", "position"])
    assert len(out) == len(DATA)
    for conv, own in out.groupby("conv", dropna=False):
        assert own["position"].tolist() == list(range(len(own)))
        shown = "".join(own["rendered"])
        roles = [p.split("|>")[0] for p in shown.split("<|") if p and not p.startswith("end")]
        assert roles[-1] == "assistant" and shown.endswith("<|end|>\n")
        at = C.START
        for r in roles:
            assert C.ROLES.index(r) + 1 in C.NEXT[at]
            at = C.ROLES.index(r) + 1
        if conv == 1:
            assert shown == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"
            assert set(own["cost"]) == {C.MERGE}
        if conv == 4:
            assert set(own["cost"]) == {cost_of_long()}


def cost_of_long():
    total = C.fold([r for _, _, r, _, _ in DATA[-200:]])
    return int((total[C.START] + C.CLOSE).min())


def test_empty_table(spark):
    assert C.format_chats(_rows(spark, [])).count() == 0
