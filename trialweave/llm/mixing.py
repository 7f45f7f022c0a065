"""Mixing sources to target weights: hierarchical budgets over a tree (domain, language, source) and seeded epochs.

Weights go down the tree level by level. A node that cannot use its share (its documents times ``max_epochs``) is
filled and its shortage goes to its siblings by weight; only what a whole subtree cannot use returns to the level
above, because a subtree's capacity is the sum of its leaves' capacities. Each leaf then takes whole epochs of its
documents and, from the next epoch's seeded order, the longest prefix that fits the rest of its quota. Documents that
share an order key (repeated ids) are taken or left together.

No leaf is ever sorted: token sums per hash cell find the cell in which the quota ends, a second pass splits that
cell, and only the keys of the last cell are summed in order. All arithmetic is in integers.

Defined results: null level values are nodes of their own; null texts have no tokens and go with their key's order;
nodes without a listed weight have ``default_weight``; weight 0 takes nothing; a budget above the whole capacity takes
every document ``max_epochs`` times; an empty table stays empty; documents without tokens are kept while their key
lies in the prefix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from trialweave.llm import query
from trialweave.llm.common import free_name, table
from trialweave.runtime import pin

CELL_BITS = 12
KEY_BITS = 60
WORD = r"[^ \t\n\x0B\f\r]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _name(level: Column) -> Column:
    """A level value as a node name in which null is a name of its own."""
    return F.coalesce(F.concat(F.lit("="), level.cast("string")), F.lit("~"))


def _order_key(seed: int, epoch: Column, doc: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("~")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def share_out(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Split ``budget`` (per parent) among children (``name``, ``weight``, ``cap``) and add ``quota``.

    Children are filled in order of cap per weight while their proportional share of what is left covers their cap;
    the others share the rest by weight.
    """
    every = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    live = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    df = children.withColumn("_ratio", F.expr("CASE WHEN weight > 0 THEN cast(cap AS DECIMAL(20,0)) * 1000000 div weight END"))
    order = every.orderBy(F.col("_ratio").asc_nulls_last(), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = (
        df.withColumn("_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).over(before), F.lit(0)))
        .withColumn("_w", F.sum(live).over(every) - F.coalesce(F.sum(live).over(before), F.lit(0)))
        .withColumn("_full", F.expr("weight > 0 AND cast(cap AS DECIMAL(20,0)) * _w <= cast(_left AS DECIMAL(20,0)) * weight"))
        .withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("_taken", F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(every), F.lit(0)))
        .withColumn("_w_all", F.sum(live).over(every))
    )
    rest = F.expr("cast(greatest(budget - _spent, 0) AS DECIMAL(20,0)) * weight div nullif(_w_all - _taken, 0)")
    quota = F.when(F.col("weight") <= 0, 0).when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", F.coalesce(rest, F.lit(0))))
    return df.withColumn("quota", quota.cast("bigint")).drop("_ratio", "_left", "_w", "_full", "_spent", "_taken", "_w_all", "budget")


def leaf_quotas(leaves: DataFrame, weights: Sequence[Mapping[str, int]], budget: Column, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """(n1, …, nk, tokens) leaf sums → the same with ``quota``. ``weights[i]`` maps a level-i value to its weight."""
    names = [c for c in leaves.columns if c != "tokens"]
    quotas = None
    for i, level in enumerate(names):
        path = names[: i + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"))
        weight = F.lit(default_weight)
        for value, w in weights[i].items():
            weight = F.when(F.col(level) == f"={value}", F.lit(w)).otherwise(weight)
        nodes = nodes.withColumn("weight", weight.cast("bigint"))
        if quotas is None:
            nodes = nodes.crossJoin(F.broadcast(leaves.agg(budget.cast("bigint").alias("budget"))))  # one row
        else:
            nodes = nodes.join(quotas.withColumnRenamed("quota", "budget"), path[:-1])
        quotas = share_out(nodes, path[:-1], level).select(*path, "quota")
    return leaves.join(quotas, names)


def _prefix_end(sums: DataFrame, leaf: list[str], by: str) -> DataFrame:
    """Per leaf the first cell (or key) at which the running token sum passes ``rest``, with the sum before it."""
    run = W.partitionBy(*leaf).orderBy(by)
    cum = sums.withColumn("_cum", F.sum("tokens").over(run)).where("_cum > rest")
    first = cum.groupBy(*leaf).agg(F.min(F.struct(by, (F.col("_cum") - F.col("tokens")).alias("before"))).alias("_f"))
    return first.select(*leaf, F.col(f"_f.{by}").alias(by), F.col("_f.before").alias("before"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], budget: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_epochs: int = 4, seed: int = 0, default_weight: int = 1) -> DataFrame:
    """The selected documents with all their columns plus ``_epoch`` (from 0) and ``_tokens``, one row per time taken.

    ``levels``: name → expression, outermost first. ``budget``: an aggregate over ``tokens``, by default their sum.
    The weights are a short, fixed table; sources without a weight of their own have ``default_weight``.
    """
    names = [free_name(docs, f"_n{i}") for i in range(len(levels))]
    t_tokens, t_epoch, t_full, t_end, t_times = (free_name(docs, n) for n in ("_tokens", "_epoch", "_full", "_end", "_times"))
    counted = count_words(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")
    placed = docs.select("*", *[_name(c).alias(n) for n, c in zip(names, levels.values())], counted.alias(t_tokens))
    narrow = pin(placed.select(*names, F.col(id_col).alias("_id"), F.col(t_tokens).alias("tokens")))
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    quotas = leaf_quotas(leaves, weights, F.sum("tokens") if budget is None else budget, max_epochs, default_weight)
    full = F.expr("coalesce(quota div nullif(tokens, 0), 0)")
    quotas = pin(quotas.select(*names, full.alias("full"), F.expr("coalesce(quota % nullif(tokens, 0), 0)").alias("rest")))

    keyed = narrow.join(quotas.where("rest > 0"), names).withColumn("key", _order_key(seed, F.col("full"), F.col("_id")))
    keyed = pin(keyed.select(*names, "rest", "key", "tokens"))
    shift1, shift2 = KEY_BITS - CELL_BITS, KEY_BITS - 2 * CELL_BITS
    sums = keyed.groupBy(*names, "rest", F.shiftright("key", shift1).alias("cell")).agg(F.sum("tokens").alias("tokens"))
    first = pin(_prefix_end(sums, names, "cell"))
    inside = keyed.join(first, names).where(F.shiftright("key", shift1) == F.col("cell")).withColumn("rest", F.col("rest") - F.col("before")).select(*names, "rest", "key", "tokens")
    sums = inside.groupBy(*names, "rest", F.shiftright("key", shift2).alias("cell")).agg(F.sum("tokens").alias("tokens"))
    second = pin(_prefix_end(sums, names, "cell"))
    inside = inside.join(second, names).where(F.shiftright("key", shift2) == F.col("cell")).withColumn("rest", F.col("rest") - F.col("before"))
    ends = _prefix_end(inside.groupBy(*names, "rest", "key").agg(F.sum("tokens").alias("tokens")), names, "key").select(*names, F.col("key").alias("_end"))

    cuts = pin(quotas.join(ends, names, "left").select(*names, F.col("full").alias(t_full), F.coalesce("_end", F.lit(0).cast("bigint")).alias(t_end)))
    taken = placed.join(cuts, names).withColumn(t_times, F.col(t_full) + (_order_key(seed, F.col(t_full), F.col(id_col)) < F.col(t_end)).cast("int"))
    taken = taken.where(F.col(t_times) > 0).withColumn(t_epoch, F.explode(F.sequence(F.lit(0), (F.col(t_times) - 1).cast("int"))))
    return taken.select(*[taken[c] for c in docs.columns], t_epoch, t_tokens)


#: Target weights of the query and of the pipeline. Sources share equally.
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "forums": 2, "news": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
DOMAINS = ("web", "books", "forums", "news")
MAX_EPOCHS, SEED = 4, 17


def source_domain(source: Column) -> Column:
    """``documents`` has no domain column: the last digits of a source name, modulo four, stand for one."""
    number = F.try_to_number(F.right(F.concat(F.lit("0000"), F.regexp_extract(source, r"(\d+)$", 1)), F.lit(4)), F.lit("0000"))
    return F.when(source.isNotNull(), F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 4).cast("int") + 1))


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, {"domain": source_domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}, (DOMAIN_WEIGHTS, LANG_WEIGHTS, {}), max_epochs=MAX_EPOCHS, seed=SEED)


def _oracle() -> str:
    def case(col: str, weights: Mapping[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {col} = '={v}' THEN {w}" for v, w in weights.items()) + " ELSE 1 END"

    parts, names, above = [], ["n0", "n1", "n2"], None
    for i, weight in enumerate((case("n0", DOMAIN_WEIGHTS), case("n1", LANG_WEIGHTS), "1")):
        path, up = names[: i + 1], names[:i]
        by = f"PARTITION BY {', '.join(up)}" if up else ""
        budget = "(SELECT sum(tokens) FROM leaves)" if not up else "q.quota"
        join = f"JOIN q{i - 1} q USING ({', '.join(up)})" if up else ""
        parts.append(f"""
    c{i} AS (SELECT {', '.join(path)}, cap::HUGEINT AS cap, ({weight})::HUGEINT AS weight, ({budget})::HUGEINT AS budget
             FROM (SELECT {', '.join(path)}, sum(tokens) * {MAX_EPOCHS} AS cap FROM leaves GROUP BY ALL) {join}),
    d{i} AS (SELECT *, sum(weight) OVER ({by}) AS w_all, budget - coalesce(sum(cap) OVER o, 0) AS lft, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER o, 0) AS w
             FROM c{i} WINDOW o AS ({by} ORDER BY cap * 1000000 // weight, {names[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e{i} AS (SELECT *, sum(CASE WHEN cap * w <= lft * weight THEN cap ELSE 0 END) OVER ({by}) AS spent, sum(CASE WHEN cap * w <= lft * weight THEN weight ELSE 0 END) OVER ({by}) AS gone FROM d{i}),
    q{i} AS (SELECT {', '.join(path)}, CASE WHEN cap * w <= lft * weight THEN cap ELSE least(cap, coalesce(greatest(budget - spent, 0) * weight // nullif(w_all - gone, 0), 0)) END AS quota FROM e{i})""")
    return rf"""
    WITH t AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS tokens,
                      CASE WHEN source IS NOT NULL THEN ['{"', '".join(DOMAINS)}'][coalesce(right('0000' || regexp_extract(source, '(\d+)$', 1), 4)::INT, 0) % 4 + 1] END AS domain FROM documents),
    n AS (SELECT *, coalesce('=' || domain, '~') AS n0, coalesce('=' || lang, '~') AS n1, coalesce('=' || source, '~') AS n2 FROM t),
    leaves AS (SELECT n0, n1, n2, sum(tokens) AS tokens FROM n GROUP BY ALL), {','.join(parts)},
    f AS (SELECT n0, n1, n2, coalesce(quota // nullif(tokens, 0), 0)::BIGINT AS whole, coalesce(quota % nullif(tokens, 0), 0)::BIGINT AS rest FROM leaves JOIN q2 USING (n0, n1, n2)),
    k AS (SELECT n.*, whole, rest, ('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '~')), 1, {KEY_BITS // 4}))::BIGINT AS key FROM n JOIN f USING (n0, n1, n2)),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY n0, n1, n2 ORDER BY key) AS cum FROM k),
    e AS (SELECT n0, n1, n2, min(key) FILTER (WHERE cum > rest AND rest > 0) AS fin FROM s GROUP BY ALL),
    x AS (SELECT s.*, whole + CASE WHEN key < coalesce(fin, 0) THEN 1 ELSE 0 END AS times FROM s JOIN e USING (n0, n1, n2))
    SELECT doc_id, domain, lang, source, tokens, unnest(range(times))::INT AS epoch FROM x WHERE times > 0
    """


@query("op3_mixing", _oracle())
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_documents(docs).select("doc_id", source_domain(F.col("source")).alias("domain"), "lang", "source", F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))
