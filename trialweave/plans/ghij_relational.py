"""Sections G (sorts), H (sets), I (scalars) and J (reshape)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from trialweave.functions import design as d
from trialweave.functions.dist import chi2_tail1_sql, norm_cdf_sql, norm_quantile_sql
from trialweave.operators import filters as fl
from trialweave.operators.skew import scan_index
from trialweave.plans.e1_aggregations import CELLS_SQL, _WIDE_SQL, cells, wide_cells
from trialweave.plans.standins import SAMPLES_SQL, TRIALS_SQL, WINDOWS_SQL, r6, samples, trials, windows
from trialweave.registry import query, table


@query("g01_byte_order", "SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name ORDER BY p_name")
def g01(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy("p_name")


@query("g02_multi_key_sort", f"WITH {CELLS_SQL} SELECT property, grp, session, condition, CAST(sum(n_trials) AS BIGINT) AS n FROM cells GROUP BY ALL ORDER BY property, grp, session, condition")
def g02(spark, sf):
    return cells(spark, sf).groupBy("property", "grp", "session", "condition").agg(F.sum("n_trials").alias("n")).orderBy("property", "grp", "session", "condition")


@query("g03_design_order", f"""WITH {TRIALS_SQL} SELECT property, list_position(['gender', 'agreement', 'marking'], property) AS ord, CAST(count(*) AS BIGINT) AS n FROM trials WHERE property IS NOT NULL GROUP BY ALL ORDER BY ord""")
def g03(spark, sf):
    levels = spark.createDataFrame([("gender", 1), ("agreement", 2), ("marking", 3)], "property string, ord int")
    n = trials(spark, sf).groupBy("property").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(levels), "property").orderBy("ord")


@query("g04_top_k", """
WITH r AS (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, c_custkey, c_acctbal FROM r WHERE r <= 3""")
def g04(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    c = table(spark, sf, "customer").join(n, "c_nationkey").select("n_name", "c_custkey", "c_acctbal")
    # the planner pushes a per-task group limit below the shuffle for rank <= k
    w = W.partitionBy("n_name").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("g05_arg_extremes", """
SELECT l_suppkey, arg_max(l_orderkey, l_extendedprice) AS dearest_order, round(max(l_extendedprice), 2) AS dearest, round(min(l_extendedprice), 2) AS cheapest FROM lineitem GROUP BY l_suppkey""")
def g05(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.max_by("l_orderkey", "l_extendedprice").alias("dearest_order"), F.round(F.max("l_extendedprice"), 2).alias("dearest"), F.round(F.min("l_extendedprice"), 2).alias("cheapest"))


@query("g06_bounded_listing", """
WITH x AS (SELECT DISTINCT p_brand, p_type FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS r FROM x)
SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_type) FILTER (r <= 10) AS first_ten, CAST(count(*) AS BIGINT) AS n_all FROM r GROUP BY p_brand""")
def g06(spark, sf):
    x = scan_index(table(spark, sf, "part").select("p_brand", "p_type").distinct(), ["p_brand"], ["p_type"], "r")
    few = F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.col("p_type"))))  # at most ten values per key
    return x.groupBy("p_brand").agg(F.array_join(few, ", ").alias("first_ten"), F.count(F.lit(1)).alias("n_all"))


@query("g07_absolute_shift", """
WITH f AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) - avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS s FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(s, 8) AS shift FROM f ORDER BY abs(s) DESC""")
def g07(spark, sf):
    x, flag = F.col("l_discount"), F.col("l_returnflag")
    f = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg(F.when(flag == "R", x)) - F.avg(F.when(flag == "A", x))).alias("s"))
    return f.orderBy(F.abs("s").desc()).select("l_suppkey", r6("s", "shift", 8))


@query("h01_union_by_name", """
SELECT c_nationkey AS nationkey, 'customer' AS kind, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY ALL
UNION ALL SELECT s_nationkey, 'supplier', NULL, round(sum(s_acctbal), 2) FROM supplier GROUP BY ALL""")
def h01(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal"), 2).alias("bal")).withColumn("kind", F.lit("customer"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.round(F.sum("s_acctbal"), 2).alias("bal")).withColumn("kind", F.lit("supplier"))
    return c.unionByName(s, allowMissingColumns=True)


@query("h02_set_difference", "SELECT l_orderkey AS orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def h02(spark, sf):
    li = table(spark, sf, "lineitem")
    k = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("orderkey")).distinct()
    return k("A").exceptAll(k("R"))


@query("h03_intersection", "SELECT l_orderkey AS orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def h03(spark, sf):
    li = table(spark, sf, "lineitem")
    k = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("orderkey"))
    return k("A").intersect(k("R"))


@query("h04_set_equality", """
WITH a AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click')
SELECT CAST((SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS BIGINT) AS only_first, CAST((SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS BIGINT) AS only_second,
 NOT EXISTS (SELECT id FROM a EXCEPT SELECT id FROM b) AND NOT EXISTS (SELECT id FROM b EXCEPT SELECT id FROM a) AS equal_sets""")
def h04(spark, sf):
    e = table(spark, sf, "events")
    t = F.col("event_type")
    per = e.groupBy("user_id").agg(F.bool_or(t == "purchase").alias("a"), F.bool_or(t == "click").alias("b"))
    only = lambda x, y: F.count_if(F.col(x) & ~F.col(y))
    return per.agg(only("a", "b").alias("only_first"), only("b", "a").alias("only_second"), ((only("a", "b") == 0) & (only("b", "a") == 0)).alias("equal_sets"))


@query("h05_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def h05(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("h06_upsert", """
WITH fresh AS (SELECT o_orderkey, o_totalprice * 2 AS v FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, round(v, 2) AS v, TRUE AS replaced FROM fresh UNION ALL SELECT o_orderkey, round(o_totalprice, 2), FALSE FROM orders ANTI JOIN fresh USING (o_orderkey)""")
def h06(spark, sf):
    o = table(spark, sf, "orders")
    old = o.select("o_orderkey", F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("v"))
    keep = old.join(new, "o_orderkey", "left_anti").withColumn("replaced", F.lit(False))
    return new.withColumn("replaced", F.lit(True)).unionByName(keep).withColumn("v", F.round("v", 2))


@query("h07_coverage", """
WITH e AS (SELECT c_custkey AS id FROM customer), f AS (SELECT DISTINCT o_custkey + 3 AS id FROM orders)
SELECT id, 'missing' AS state FROM e ANTI JOIN f USING (id) UNION ALL SELECT id, 'extra' FROM f ANTI JOIN e USING (id)""")
def h07(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    f = table(spark, sf, "orders").select((F.col("o_custkey") + 3).alias("id")).distinct()
    return e.join(f, "id", "left_anti").withColumn("state", F.lit("missing")).unionByName(f.join(e, "id", "left_anti").withColumn("state", F.lit("extra")))


@query("i01_string_functions", """
SELECT p_partkey, lower(p_name) AS low, contains(p_name, 'ring') AS has_ring, starts_with(p_brand, 'Brand#1') AS pre, ends_with(p_type, 'D') AS suf,
 p_brand || '-' || p_type AS joined, split_part(p_name, ' ', 1) AS first_word, rpad(p_brand, 10, '.') AS padded, trim(p_name) AS trimmed FROM part""")
def i01(spark, sf):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey", F.lower(n).alias("low"), n.contains("ring").alias("has_ring"), b.startswith("Brand#1").alias("pre"), t.endswith("D").alias("suf"),
        F.concat_ws("-", b, t).alias("joined"), F.split_part(n, F.lit(" "), F.lit(1)).alias("first_word"), F.rpad(b, 10, ".").alias("padded"), F.trim(n).alias("trimmed"))


@query("i02_regex_functions", """
SELECT doc_id, len(regexp_extract_all(text, '[a-z]+@[a-z.]+')) AS n_addresses, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, regexp_matches(text, '[Ll]icense') AS has_license FROM documents""")
def i02(spark, sf):
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).alias
    return table(spark, sf, "documents").select("doc_id", n("[a-z]+@[a-z.]+")("n_addresses"), n("[0-9]+")("n_numbers"),
                                                F.length(F.regexp_replace(t, "[^A-Za-z]", "")).cast("bigint").alias("n_letters"), t.rlike("[Ll]icense").alias("has_license"))


@query("i03_date_functions", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp, epoch_us(o_orderdate) AS us, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,
 strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') = o_orderdate AS round_trip FROM orders""")
def i03(spark, sf):
    o = F.col("o_orderdate")
    back = F.coalesce(F.try_to_timestamp(F.date_format(o, "dd/MM/yyyy"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.date_format(o, "dd/MM/yyyy"), F.lit("dd/MM/yyyy")))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(o, "yyyy-MM-dd HH:mm").alias("stamp"), d.micros(o).alias("us"),
        F.datediff(o, F.lit("1995-01-01")).cast("bigint").alias("days"), (back == o.cast("timestamp")).alias("round_trip"))


@query("i04_math_functions", """
SELECT event_id, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log1, round(exp(-value / 100), 9) AS decay, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS logistic,
 CAST(floor(value) AS BIGINT) AS lo, CAST(ceil(value) AS BIGINT) AS hi, round_even(value, 1) AS half_even, least(value, 10) AS capped, round(sin(value), 6) AS s FROM events""")
def i04(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(F.sqrt(v), "root"), r6(F.log(v + 1), "log1"), r6(F.exp(-v / 100), "decay", 9), r6(1 / (1 + F.exp(-(v - 50) / 10)), "logistic", 9),
        F.floor(v).alias("lo"), F.ceil(v).alias("hi"), F.bround(v, 1).alias("half_even"), F.least(v, F.lit(10.0)).alias("capped"), r6(F.sin(v), "s"))


@query("i05_distribution_functions", f"""
WITH x AS (SELECT event_id, (value + 0.5) / 600 AS p, (value - 50) / 20 AS z FROM events)
SELECT event_id, round({norm_quantile_sql('p')}, 8) AS quantile, round({norm_cdf_sql('z')}, 8) AS cdf, round({chi2_tail1_sql('abs(z)')}, 8) AS chi2_tail FROM x""")
def i05(spark, sf):
    x = table(spark, sf, "events").select("event_id", ((F.col("value") + 0.5) / 600).alias("p"), ((F.col("value") - 50) / 20).alias("z"))
    return x.select("event_id", r6(F.expr(norm_quantile_sql("p")), "quantile", 8), r6(F.expr(norm_cdf_sql("z")), "cdf", 8), r6(F.expr(chi2_tail1_sql("abs(z)")), "chi2_tail", 8))


@query("i06_array_functions", """
SELECT vec_id, round(embedding[3]::DOUBLE, 6) AS third, len(list_filter(embedding, lambda x: x > 0)) AS n_positive, round(list_max(embedding)::DOUBLE, 6) AS largest,
 list_position(embedding, list_max(embedding)) AS arg_max, round(list_sort(embedding)[1]::DOUBLE, 6) AS smallest, len(embedding[9:16]) AS n_slice FROM embeddings""")
def i06(spark, sf):
    e = F.col("embedding")
    dbl = lambda c, n: F.round(c.cast("double"), 6).alias(n)
    return table(spark, sf, "embeddings").select(
        "vec_id", dbl(F.element_at(e, 3), "third"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("n_positive"), dbl(F.array_max(e), "largest"),
        F.array_position(e, F.array_max(e)).cast("int").alias("arg_max"), dbl(F.element_at(F.array_sort(e), 1), "smallest"), F.size(F.slice(e, 9, 8)).cast("bigint").alias("n_slice"))


@query("i07_hash_functions", "SELECT doc_id, sha256(text) AS h256, sha1(text) AS h1, md5(text) AS h5 FROM documents")
def i07(spark, sf):
    t = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("h256"), F.sha1(t).alias("h1"), F.md5(t).alias("h5"))


@query("i08_null_handling", f"""WITH {TRIALS_SQL} SELECT event_id, coalesce(correct, -1) AS filled, nullif(event_type, 'signup') AS blanked, coalesce(condition IN ('Grammatical'), FALSE) AS is_control FROM trials""")
def i08(spark, sf):
    return trials(spark, sf).select("event_id", F.coalesce("correct", F.lit(-1)).alias("filled"), F.nullif("event_type", F.lit("signup")).alias("blanked"),
                                    F.coalesce(F.col("condition").isin(d.CONTROL), F.lit(False)).alias("is_control"))


@query("j01_wide_to_long", """
SELECT s_suppkey, property, value FROM (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier) UNPIVOT (value FOR property IN (s_name, s_nationkey, s_acctbal))""")
def j01(spark, sf):
    s = table(spark, sf, "supplier")
    cols = [c for c in s.columns if c != "s_suppkey"]
    return s.select("s_suppkey", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["s_suppkey"], cols, "property", "value")


@query("j02_two_measures_long", """
WITH g AS (SELECT l_suppkey, round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax FROM lineitem GROUP BY 1)
SELECT l_suppkey, 'discount' AS measure, discount AS value FROM g UNION ALL SELECT l_suppkey, 'tax', tax FROM g""")
def j02(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.avg("l_discount"), "discount", 8), r6(F.avg("l_tax"), "tax", 8))
    return g.unpivot(["l_suppkey"], ["discount", "tax"], "measure", "value")


@query("j03_long_to_wide", f"WITH {_WIDE_SQL} SELECT entity, session, property, CAST(n1 AS BIGINT) AS control, CAST(n2 AS BIGINT) AS violation FROM wide")
def j03(spark, sf):
    return wide_cells(spark, sf).select("entity", "session", "property", F.col("n1").alias("control"), F.col("n2").alias("violation"))


@query("j04_slot_block", """
WITH s AS (SELECT c_custkey, i, CASE (c_custkey + i) % 5 WHEN 0 THEN 'english' WHEN 1 THEN 'norwegian' WHEN 2 THEN 'german' ELSE 'other' END AS lang,
   c_nationkey * i % 7 AS a, c_nationkey % (i + 1) AS b FROM customer, (SELECT unnest(range(1, 5)) AS i))
SELECT c_custkey, CAST(count(*) FILTER (a + b > 0) AS INT) AS n_answered, CAST(min(a) FILTER (lang = 'english') AS INT) AS english_a, CAST(sum(a + b) AS BIGINT) AS total FROM s GROUP BY c_custkey""")
def j04(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    slot = lambda i: F.struct(
        F.when((k + i) % 5 == 0, "english").when((k + i) % 5 == 1, "norwegian").when((k + i) % 5 == 2, "german").otherwise("other").alias("lang"),
        (n * i % 7).alias("a"), (n % (i + 1)).alias("b"))
    c = table(spark, sf, "customer").select("c_custkey", F.array(*[slot(i) for i in range(1, 5)]).alias("slots"))
    return c.select("c_custkey", F.size(F.filter("slots", lambda s: s["a"] + s["b"] > 0)).alias("n_answered"),
                    F.array_min(F.transform(F.filter("slots", lambda s: s["lang"] == "english"), lambda s: s["a"])).alias("english_a"),
                    F.aggregate("slots", F.lit(0).cast("bigint"), lambda acc, s: acc + s["a"] + s["b"]).alias("total"))


@query("j05_pattern_arrays", f"""WITH {SAMPLES_SQL},
c AS (SELECT entity, session, condition, (time_ms + 100) // 200 AS bin, sensor, avg(amplitude) AS v FROM samples GROUP BY ALL)
SELECT entity, session, condition, bin, string_agg(sensor, ',' ORDER BY sensor) AS channels, round(list_sum(list(v)), 5) AS total FROM c GROUP BY ALL""")
def j05(spark, sf):
    unit = ["entity", "session", "condition", "bin"]
    c = samples(spark, sf).withColumn("bin", F.floor((F.col("time_ms") + 100) / 200)).groupBy(*unit, "sensor").agg(F.avg("amplitude").alias("v"))
    # one value per sensor after the mean, so a pattern never exceeds the sensor count
    p = c.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("sensor", "v"))).alias("p"))
    return p.select(*unit, F.array_join(F.transform("p", lambda x: x["sensor"]), ",").alias("channels"),
                    F.round(F.aggregate(F.transform("p", lambda x: x["v"]), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("j06_named_list_row", f"""WITH {TRIALS_SQL}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (session = 2) AS BIGINT) AS n_session_2, CAST(count(*) FILTER (session = 3) AS BIGINT) AS n_session_3,
 CAST(count(*) FILTER (session = 4) AS BIGINT) AS n_session_4, CAST(count(*) FILTER (session = 6) AS BIGINT) AS n_session_6 FROM trials""")
def j06(spark, sf):
    w = trials(spark, sf).groupBy().pivot("session", list(d.SESSIONS)).agg(F.count(F.lit(1)))
    cols = [F.col(str(s)).alias(f"n_session_{s}") for s in d.SESSIONS]
    return w.select(sum((F.col(str(s)) for s in d.SESSIONS), F.lit(0)).cast("bigint").alias("n"), *cols)


@query("j07_overlapping_windows", f"""WITH {SAMPLES_SQL}, {WINDOWS_SQL}
SELECT time_ms, string_agg(DISTINCT window_name, '|' ORDER BY window_name) AS members, CAST(count(*) AS BIGINT) AS n_rows FROM samples JOIN windows ON time_ms BETWEEN min_ms AND max_ms GROUP BY time_ms""")
def j07(spark, sf):
    s = fl.in_windows(samples(spark, sf).select("time_ms"), windows(spark))
    return s.groupBy("time_ms").agg(F.array_join(F.array_sort(F.collect_set("window_name")), "|").alias("members"), F.count(F.lit(1)).alias("n_rows"))
