"""Constraint queries: one DataFrame of violations per rule, joined by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trialweave.functions import design as d


def violations(df: DataFrame, check: str, severity: str, entity: Column, condition: Column, detail: str) -> DataFrame:
    return df.filter(F.coalesce(condition, F.lit(False))).select(
        F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), entity.cast("bigint").alias("entity"), F.lit(detail).alias("detail"))


#: stage flag → sessions of which at least one must have been attended
STAGE_SESSIONS = {"usable_accuracy": d.SESSIONS, "usable_signal": d.SESSIONS[1:]}


def presence_rules(stages: dict[str, tuple[int, ...]] = STAGE_SESSIONS) -> list[tuple[str, str, Column]]:
    """(rule, severity, condition on a row of the presence matrix)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    at = lambda s: flag(f"attended_{s}")
    some = lambda cs: reduce(lambda a, b: a | b, cs)
    rules = [(f"{stage}:no_session", "error", flag(stage) & ~some([at(s) for s in sessions])) for stage, sessions in stages.items()]
    rules += [(f"{one}:without:{other}", "warning", flag(one) & ~flag(other)) for one in stages for other in stages if one != other]
    came = [at(s) for s in d.SESSIONS]
    hole = [came[i] & ~came[k] & some(came[k + 1 :]) for i in range(len(came)) for k in range(i + 1, len(came) - 1)]
    return rules + [
        ("id:missing", "error", F.col("entity").isNull()),
        ("secondary_id:missing", "info", F.col("secondary_id").isNull()),
        ("group:parity", "error", F.col("recorded_group") != d.group_from_parity(F.col("entity"))),
        ("attendance:hole", "info", some(hole)),
        ("attendance:none", "info", ~some(came)),
        ("predictor:missing", "info", some([flag(s) for s in stages]) & F.col("predictor").isNull()),
    ]


def presence_checks(m: DataFrame) -> DataFrame:
    """(rule, severity, entity) of every row that breaks a rule, and of every id that stands on several rows."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in presence_rules()])
    each = m.select(F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("b"), "entity").select("b.rule", "b.severity", F.col("entity").cast("bigint").alias("entity"))
    twice = [m.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity")).filter("n > 1")
             .select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.col("entity").cast("bigint").alias("entity"))
             for c, rule in (("entity", "id:repeated"), ("secondary_id", "secondary_id:repeated"))]
    return reduce(DataFrame.unionByName, [each, *twice])


def flow_checks(matrix: DataFrame, flow: DataFrame, stages: list[str]) -> DataFrame:
    """Stages whose total in a stored flow table (stage, n_total) is not the matrix's, or cannot be held against it.

    A stage whose flag is null on every row was not built here: its stored total is unverifiable, not wrong.
    """
    aggs = [F.struct(F.lit(s).alias("stage"), F.count_if(F.col(s)).alias("matrix_total"), F.count(F.col(s)).alias("known")) for s in stages]
    totals = matrix.agg(F.array(*aggs).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    j = totals.join(flow, "stage")
    unknown, ship = F.col("known") == 0, F.col("n_total")
    rule = F.when(unknown & ship.isNotNull(), "flow:unverifiable").when(~unknown & ~ship.eqNullSafe(F.col("matrix_total")), "flow:mismatch")
    out = j.select(rule.alias("rule"), F.when(unknown, "warning").otherwise("error").alias("severity"), "stage", F.when(~unknown, F.col("matrix_total")).alias("matrix_total"), F.col("n_total").alias("flow_total"))
    return out.where("rule IS NOT NULL")


def raise_if_any(df: DataFrame, what: str, limit: int = 10) -> DataFrame:
    """Stop with a bounded listing when a violation exists."""
    head = df.limit(limit).collect()
    if head:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in head))
    return df
