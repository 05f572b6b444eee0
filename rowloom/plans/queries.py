"""Queries over the standard tables, one for each operator, with SQL that says the same."""
from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import apportion, compute, dates, expr, rng, shapes, text
from ..functions.compute import Node
from ..operators import checks, prefix, relate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- sources -------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey + 1 AS n_count, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'true' ELSE 'false' END AS is_first, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'true' ELSE 'false' END AS is_last, (SELECT count(*) FROM orders) AS total FROM orders")
def builtins(spark, d):
    o = t(spark, d, "orders")
    edges = o.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count("*").alias("total"))
    word = lambda c: F.when(c, "true").otherwise("false")
    return o.crossJoin(F.broadcast(edges)).select("o_orderkey", (F.col("o_orderkey") + 1).alias("n_count"), word(F.col("o_orderkey") == F.col("a")).alias("is_first"), word(F.col("o_orderkey") == F.col("b")).alias("is_last"), "total")


@query("SELECT i AS id, 100 + 5 * i AS up, 7.5 - 0.25 * i AS down FROM range(0, 1000) r(i)")
def counter_step(spark, d):
    return spark.range(1000).select("id", (F.lit(100) + 5 * F.col("id")).alias("up"), (F.lit(7.5) - 0.25 * F.col("id")).alias("down"))


@query("SELECT c_custkey, list_extract(['red', 'green', 'blue'], CAST(c_custkey % 3 + 1 AS INT)) AS colour FROM customer")
def sequential_cycle(spark, d):
    values = F.array(*[F.lit(x) for x in ("red", "green", "blue")])
    return t(spark, d, "customer").select("c_custkey", F.element_at(values, (F.pmod(F.col("c_custkey"), F.lit(3)) + 1).cast("int")).alias("colour"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT c_custkey, n_nationkey, n_name, n_regionkey FROM customer JOIN n ON n.i = c_custkey % 25""")
def row_link(spark, d):
    return relate.row_link(t(spark, d, "customer").select("c_custkey"), t(spark, d, "nation"), "n_nationkey", F.pmod(F.col("c_custkey"), F.lit(25)))


@query("""WITH v AS (SELECT list(s_acctbal ORDER BY s_acctbal) AS a FROM supplier), u AS (SELECT p_partkey, ((p_partkey % 997) + 0.5) / 997 AS u FROM part),
p AS (SELECT p_partkey, greatest(least(u * len(a) - 0.5, len(a) - 1), 0) AS p, a FROM u, v)
SELECT p_partkey, round(a[CAST(floor(p) AS INT) + 1] + (p - floor(p)) * (a[least(CAST(floor(p) AS INT) + 2, len(a))] - a[CAST(floor(p) AS INT) + 1]), 4) AS q FROM p""")
def quantile_read(spark, d):
    values = [r[0] for r in t(spark, d, "supplier").select("s_acctbal").where("s_acctbal is not null").limit(100_001).toLocalIterator()]
    if len(values) > 100_000:
        raise ValueError("a quantile source has at most 100,000 values")
    u = (F.pmod(F.col("p_partkey"), F.lit(997)) + 0.5) / 997
    return t(spark, d, "part").select("p_partkey", F.round(shapes.quantile(u, values), 4).alias("q"))


# --- shares and draws ----------------------------------------------------------


@query("SELECT * FROM (VALUES (0, 141), (1, 40), (2, 20)) v(part, n)")
def hamilton_counts(spark, d):
    return spark.createDataFrame(list(enumerate(apportion.counts(201, [70, 20, 10]))), "part int, n int")


@query("SELECT status, n FROM (VALUES ('active', 7000), ('closed', 1000), ('trial', 2000)) v(status, n)")
def percent_exact(spark, d):
    n, values = 10_000, ["active", "trial", "closed"]
    place = rng.slot("bench", "Status", n, F.col("id"))
    return spark.range(n).select(apportion.pick(place, apportion.counts(n, apportion.shares("70,20,10", 3)), values).alias("status")).groupBy("status").agg(F.count("*").cast("int").alias("n"))


@query("SELECT v AS code, n FROM (VALUES ('A', 2500), ('B1', 3500), ('B2', 3500), ('C', 500)) x(v, n)")
def mix_nested_share(spark, d):
    """A case's own split is exact within the case."""
    n = 10_000
    parts = apportion.counts(n, apportion.shares("25,70", 3))
    place = rng.slot("s", "Code", n, F.col("id"))
    case = apportion.which(place, parts)
    inner = rng.slot("s", "Code#1", parts[1], place - parts[0])
    nested = apportion.pick(inner, apportion.counts(parts[1], apportion.shares(None, 2)), ["B1", "B2"])
    value = F.when(case == 0, "A").when(case == 1, nested).otherwise("C")
    return spark.range(n).select(value.alias("code")).groupBy("code").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 50000 AS n, 50000 AS distinct_n, 0 AS low, 49999 AS high")
def keyed_permutation(spark, d):
    n = 50_000
    return spark.range(n).select(rng.slot("s", "p", n, F.col("id")).alias("x")).agg(F.count("*").alias("n"), F.countDistinct("x").alias("distinct_n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("SELECT 20000 AS n, true AS inside, true AS even")
def keyed_uniform(spark, d):
    u = rng.uniform("s", "u", F.col("id"))
    return spark.range(20_000).select(u.alias("u")).agg(F.count("*").alias("n"), F.every((F.col("u") > 0) & (F.col("u") < 1)).alias("inside"), (F.abs(F.avg("u") - 0.5) < 0.02).alias("even"))


@query("""SELECT l_returnflag, kind, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN row_number() OVER (ORDER BY l_orderkey, l_linenumber) <= round(c * 0.6) THEN 'x' ELSE 'y' END AS kind
FROM (SELECT *, count(*) OVER () AS c FROM lineitem WHERE l_returnflag = 'R')) GROUP BY 1, 2""")
def parent_quota(spark, d):
    """An exact 60:40 split of a sub-population only."""
    li = t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = relate.quota(li, "k", F.col("l_returnflag") == "R", ["x", "y"], "60,40", "kind", "s", "kind")
    return out.where("kind is not null").groupBy("l_returnflag", "kind").agg(F.count("*").alias("n"))


# --- conditions and relations ----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS returned FROM lineitem")
def parent_filter(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", relate.parent(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("returned"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' WHEN o_orderstatus = 'F' THEN 'done' END AS size FROM orders")
def conditional_first_match(spark, d):
    o = t(spark, d, "orders")
    is_ = lambda e: expr.truth(expr.of_frame(o, e))
    return o.select("o_orderkey", relate.first_match([(is_("o_totalprice > 300000"), F.lit("large")), (is_("o_totalprice > 100000"), F.lit("middle")), (is_("o_orderstatus == 'F'"), F.lit("done"))]).alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'now' WHEN o_orderpriority = '3-MEDIUM' THEN 'soon' ELSE 'later' END AS due FROM orders")
def switch_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", relate.switch(F.col("o_orderpriority"), {"1-URGENT|2-HIGH": "now", "3-MEDIUM": "soon"}, F.lit("later")).alias("due"))


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def switch_by_table(spark, d):
    return relate.switch_table(t(spark, d, "customer"), "c_nationkey", t(spark, d, "nation"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


_PICK = "floor((c_custkey % 101 + 0.5) / 101 * {n})"


@query(f"""WITH s AS (SELECT s_suppkey, s_name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT c_custkey, c_nationkey, s_suppkey AS my_s_suppkey, s_name AS my_s_name FROM customer JOIN s ON s_nationkey = c_nationkey AND i = {_PICK.format(n="n")}""")
def pool_equi_pick(spark, d):
    s = t(spark, d, "supplier")
    c = t(spark, d, "customer").join(F.broadcast(s.select(F.col("s_nationkey").alias("c_nationkey")).distinct()), "c_nationkey", "left_semi")
    u = (F.pmod(F.col("c_custkey"), F.lit(101)) + 0.5) / 101
    return relate.pool_pick_equal(c, s.select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", "c_nationkey", "s_nationkey", u, "my_").select("c_custkey", "c_nationkey", "my_s_suppkey", "my_s_name")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT c_custkey, n_nationkey AS p_n_nationkey, n_name AS p_n_name, n_regionkey AS p_n_regionkey FROM customer JOIN s ON i = {_PICK.format(n=25)}""")
def pool_pick(spark, d):
    u = (F.pmod(F.col("c_custkey"), F.lit(101)) + 0.5) / 101
    return relate.pool_pick(t(spark, d, "customer"), t(spark, d, "nation"), "n_nationkey", u, "p_").select("c_custkey", "p_n_nationkey", "p_n_name", "p_n_regionkey")


@query("""WITH m AS (SELECT c_custkey, n_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN nation ON n_nationkey < c_nationkey)
SELECT c.c_custkey, m.n_nationkey AS p_n_nationkey FROM customer c JOIN m ON m.c_custkey = c.c_custkey AND i = floor((c.c_custkey % 101 + 0.5) / 101 * n)""")
def pool_theta_pick(spark, d):
    u = (F.pmod(F.col("c_custkey"), F.lit(101)) + 0.5) / 101
    n = t(spark, d, "nation").select("n_nationkey")
    c = t(spark, d, "customer").where("c_nationkey > 0")
    return relate.pool_pick_where(c, n, "n_nationkey", lambda m: m["p_n_nationkey"] < F.col("c_nationkey"), u, "p_").select("c_custkey", "p_n_nationkey")


# --- statistics and running values -----------------------------------------------


@query("SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS sum, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS count FROM orders")
def stat_exact(spark, d):
    return checks.stats(t(spark, d, "orders"), "o_totalprice", ["sum", "min", "max", "count"], scale=2).select(*[F.col(c).cast("double").alias(c) for c in ("sum", "min", "max")], "count")


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_pop(o_totalprice), 4) AS stddev FROM orders")
def stat_sum_mean_median_stddev(spark, d):
    return checks.stats(t(spark, d, "orders"), "o_totalprice", ["mean", "median", "stddev"]).select(*[F.round(c, 4).alias(c) for c in ("mean", "median", "stddev")])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 'above' ELSE 'below' END AS verdict FROM orders")
def stat_on_every_row(spark, d):
    return checks.with_stat(t(spark, d, "orders"), "o_totalprice", "mean", "average").select("o_orderkey", F.when(F.col("o_totalprice") > F.col("average"), "above").otherwise("below").alias("verdict"))


@query("SELECT o_orderkey, (1000 + sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey))::DOUBLE AS balance FROM orders")
def running_total(spark, d):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    return prefix.running(t(spark, d, "orders"), "o_orderkey", v, "balance", base=F.lit(1000).cast("decimal(18,2)")).select("o_orderkey", F.col("balance").cast("double").alias("balance"))


@query("SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderkey) AS low, max(o_totalprice) OVER (ORDER BY o_orderkey) AS high FROM orders")
def running_min_max(spark, d):
    o = t(spark, d, "orders")
    out = prefix.running(o, "o_orderkey", F.col("o_totalprice"), "low", "min")
    return prefix.running(out, "o_orderkey", F.col("o_totalprice"), "high", "max").select("o_orderkey", "low", "high")


@query("""WITH e AS (SELECT event_id, event_type, CAST(value AS DECIMAL(18, 4)) AS v, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND event_id > (SELECT min(event_id) FROM events) THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS seg FROM e)
SELECT event_id, event_type, sum(v) OVER (PARTITION BY seg ORDER BY event_id)::DOUBLE AS total FROM s""")
def running_reset_segments(spark, d):
    out = prefix.running_reset(t(spark, d, "events"), "event_id", F.col("value").cast("decimal(18,4)"), "event_type", "total")
    return out.select("event_id", "event_type", F.col("total").cast("double").alias("total"))


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(range(1, len(q) + 1), lambda i: CAST(CAST(list_sum(q[1:i]) AS BIGINT) AS VARCHAR)), ',') AS totals FROM l""")
def list_running(spark, d):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    out = t(spark, d, "lineitem").groupBy("l_orderkey").agg(q.alias("q"))
    return out.select("l_orderkey", F.array_join(F.transform(relate.list_running(F.col("q")), lambda x: x.cast("long").cast("string")), ",").alias("totals"))


# --- lists and child rows ----------------------------------------------------------


@query("""SELECT p_partkey, w AS word, (p_partkey - 1) * 10 + 1 + (i - 1) AS _item_id FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)""")
def each_explode_item_id(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("words"))
    return relate.each(p, "words", F.col("p_partkey"), 10, item="word").select("p_partkey", "word", "_item_id")


@query("SELECT p_partkey, len(string_split(p_type, ' '))::BIGINT AS n, string_split(p_type, ' ')[1] AS first, coalesce(string_split(p_type, ' ')[9], '') AS past FROM part")
def list_split_at_count(spark, d):
    p = t(spark, d, "part")
    v = lambda e: expr.of_frame(p, e)
    return p.select("p_partkey", v("count(split(p_type, ' '))").int.alias("n"), v("at(split(p_type, ' '), 0)").text.alias("first"), v("at(split(p_type, ' '), 8)").text.alias("past"))


@query("SELECT id, n, ok FROM (SELECT i AS id, 1 + i % 3 AS n, true AS ok FROM range(0, 600) r(i))")
def list_distinct(spark, d):
    n = (1 + F.pmod(F.col("id"), F.lit(3))).alias("n")
    got = checks.sample_list(["a", "b", "c", "d"], [4, 3, 2, 1], n, F.col("id"), "s", "tags")
    return spark.range(600).select("id", n, got.alias("g")).select("id", "n", ((F.size("g") == F.col("n")) & (F.size(F.array_distinct("g")) == F.col("n"))).alias("ok"))


# --- expressions -------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def formula(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(expr.of_frame(li, "l_extendedprice * (1 - l_discount) * (1 + l_tax)").num, 6).alias("charge"))


@query("SELECT i AS id, ((i - 50) % 7 + 7) % 7 AS m, floor((i - 50) / 7.0)::BIGINT AS q, CASE WHEN i < 50 THEN -floor((50 - i) / 4.0 + 0.5) ELSE floor((i - 50) / 4.0 + 0.5) END AS r, trunc((i - 50) / 4.0) AS t, ceil((i - 50) / 4.0) AS c, floor((i - 50) / 4.0) AS f FROM range(0, 100) r(i)")
def whole_number_arithmetic(spark, d):
    df = spark.range(100).withColumn("x", F.col("id") - 50)
    v = lambda e: expr.of_frame(df, e)
    return df.select("id", v("x % 7").int.alias("m"), compute.divide(F.col("x"), F.lit(7).cast("long")).alias("q"), v("round(x / 4)").num.alias("r"), v("trunc(x / 4)").num.alias("t"), v("ceil(x / 4)").num.alias("c"), v("floor(x / 4)").num.alias("f"))


_SHAPES = ["1", "01", "1.0", "+1", "1 ", "one", "", "0", "false", "true"]


@query("""SELECT s, s IN ('1', '01', '1.0', '+1', '1 ') AS loose, s = '1' AS strict, s NOT IN ('', 'false') AS truth, s IN ('1', '01', '1.0', '+1', '1 ') AS more
FROM (VALUES ('1'), ('01'), ('1.0'), ('+1'), ('1 '), ('one'), (''), ('0'), ('false'), ('true')) v(s)""")
def loose_strict_truth(spark, d):
    df = spark.createDataFrame([(x,) for x in _SHAPES], "s string")
    is_ = lambda e: expr.truth(expr.of_frame(df, e))
    return df.select("s", is_("s == 1").alias("loose"), is_("s === '1'").alias("strict"), is_("s").alias("truth"), is_("s > 0.5").alias("more"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AS chosen, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS state FROM customer")
def membership_and_ternary(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", expr.truth(expr.of_frame(c, "c_mktsegment in ['BUILDING', 'MACHINERY'] && c_acctbal >= 0")).alias("chosen"), expr.of_frame(c, "c_acctbal < 0 ? 'owes' : 'has'").text.alias("state"))


@query("SELECT n_nationkey, length(n_name)::BIGINT AS n, upper(n_name) AS u, lower(n_name) AS l, starts_with(n_name, 'A') AS a, ends_with(n_name, 'A') AS z, contains(n_name, 'AN') AS m, n_name = '' AS e FROM nation")
def text_functions(spark, d):
    n = t(spark, d, "nation")
    v = lambda e: expr.of_frame(n, e)
    return n.select("n_nationkey", v("len(n_name)").int.alias("n"), v("upper(n_name)").text.alias("u"), v("lower(n_name)").text.alias("l"), *[expr.truth(v(e)).alias(a) for a, e in (("a", "starts_with(n_name, 'A')"), ("z", "ends_with(n_name, 'A')"), ("m", "contains(n_name, 'AN')"), ("e", "is_empty(n_name)"))])


_FUNCTIONS = {"sqrt": "sqrt(x)", "power": "pow(x, 1.5)", "ex": "exp(0 - x)", "lg": "log(x)", "lg10": "log10(x)", "lg2": "log2(x)", "cube": "cbrt(x)", "si": "sin(x)", "co": "cos(x)", "ta": "tan(x)", "at": "atan(x)", "at2": "atan2(x, 2)", "sh": "sinh(x)", "ch": "cosh(x)", "th": "tanh(x)", "de": "degrees(x)", "ra": "radians(x)", "si2": "sign(x)", "hy": "hypot(x, 2)", "asi": "asin(x / 100)", "aco": "acos(x / 100)", "ash": "asinh(x)", "ach": "acosh(x)", "ath": "atanh(x / 100)"}
_DUCK = {"power": "pow(x, 1.5)", "ex": "exp(-x)", "lg": "ln(x)", "hy": "sqrt(x * x + 4)"}


@query("SELECT id, " + ", ".join(f"round({_DUCK.get(k, e)}, 6)::DOUBLE AS {k}" for k, e in _FUNCTIONS.items()) + " FROM (SELECT i AS id, (i + 1)::DOUBLE / 10 + 1 AS x FROM range(0, 90) r(i))")
def math_functions(spark, d):
    df = spark.range(90).withColumn("x", (F.col("id") + 1) / 10 + 1)
    return df.select("id", *[F.round(expr.of_frame(df, e).num, 6).alias(k) for k, e in _FUNCTIONS.items()])


@query("SELECT i AS id, round(gamma(i / 4.0 + 0.5), 6) AS g, round(lgamma(i / 4.0 + 0.5), 6) AS lg FROM range(0, 20) r(i)")
def special_functions(spark, d):
    df = spark.range(20).withColumn("x", F.col("id") / 4 + 0.5)
    return df.select("id", F.round(expr.of_frame(df, "gamma(x)").num, 6).alias("g"), F.round(expr.of_frame(df, "lgamma(x)").num, 6).alias("lg"))


# --- computing language --------------------------------------------------------------


def n_(tag: str, *children: Node, **attrs: str) -> Node:
    return Node(tag, {k.rstrip("_"): v for k, v in attrs.items()}, list(children))


def _luhn() -> Node:
    digit = n_("to_number", n_("current"))
    twice = n_("multiply", digit, n_("int", v="2"))
    even = n_("equals", n_("mod", n_("current_index"), n_("int", v="2")), n_("int", v="0"))
    doubled = n_("choose", n_("when", n_("test", n_("greater_than", twice, n_("int", v="9"))), n_("then", n_("subtract", twice, n_("int", v="9")))), n_("otherwise", twice))
    one = n_("choose", n_("when", n_("test", even), n_("then", doubled)), n_("otherwise", digit))
    return n_("reduce", n_("over", n_("field", name="s")), n_("init", n_("int", v="0")), n_("do", n_("add", n_("acc"), one)))


@query("""WITH s AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS s FROM orders)
SELECT o_orderkey, list_sum(list_transform(range(0, 8), lambda i: CASE WHEN i % 2 = 1 THEN s[i + 1]::BIGINT WHEN s[i + 1]::BIGINT * 2 > 9 THEN s[i + 1]::BIGINT * 2 - 9 ELSE s[i + 1]::BIGINT * 2 END))::BIGINT AS luhn, (o_orderkey % 97)::BIGINT AS m97 FROM s""")
def compute_check_digits(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", text.pad_left(F.col("o_orderkey").cast("string"), 8, "0").alias("s"))
    low = compute.Lowering(lambda name: F.col(name))
    m97 = n_("reduce", n_("over", n_("field", name="s")), n_("init", n_("int", v="0")), n_("do", n_("mod", n_("add", n_("multiply", n_("acc"), n_("int", v="10")), n_("to_number", n_("current"))), n_("int", v="97"))))
    return o.select("o_orderkey", low(_luhn()).col.alias("luhn"), low(m97).col.alias("m97"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g'), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(upper(c)) - 55)::VARCHAR END), '') AS code FROM nation")
def compute_encode_base36(spark, d):
    node = n_("join", n_("each", n_("over", n_("field", name="n_name")), n_("do", n_("encode", n_("current"), as_="base36"))))
    return t(spark, d, "nation").select("n_nationkey", compute.Lowering(lambda name: F.regexp_replace(F.col(name), "[^A-Za-z0-9]", ""))(node).col.alias("code"))


# --- formatting and imperfections ------------------------------------------------------


@query("""SELECT o_orderkey, regexp_replace(o_orderkey::VARCHAR, '(\\d)(?=(\\d{3})+$)', '\\1 ', 'g') AS g, o_orderkey::VARCHAR AS raw, '"' || replace(o_orderpriority, '"', '""') || '"' AS csv, replace(o_orderpriority, '-', ': ') AS rep, substr(o_orderpriority, 3, 4) AS cut, right(o_orderpriority, 3) AS tail FROM orders""".replace("regexp_replace(o_orderkey::VARCHAR, '(\\d)(?=(\\d{3})+$)', '\\1 ', 'g')", "trim(replace(format('{:,}', o_orderkey), ',', ' '))"))
def filters(spark, d):
    o = t(spark, d, "orders")
    p, k = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", text.filtered(k, "group", "3").alias("g"), k.alias("raw"), text.filtered(p, "csv").alias("csv"), text.filtered(p, "replace", "-,: ").alias("rep"), text.filtered(p, "slice", "2,6").alias("cut"), text.filtered(p, "slice", "-3").alias("tail"))


@query("SELECT i AS id, lower(to_base(i * 7919, 36)) AS c36, lower(to_base(i * 7919, 16)) AS c16 FROM range(0, 1000) r(i)")
def filter_compact(spark, d):
    n = (F.col("id") * 7919).cast("string")
    return spark.range(1000).select("id", text.compact(n).alias("c36"), text.compact(n, 16).alias("c16"))


@query("SELECT c_custkey, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS cap, '****' || right(c_name, 4) AS masked, left(c_name, 3) || '-' || substr(c_name, 4, 3) AS cut FROM customer")
def case_and_mask(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", text.upper_first(F.lower("c_mktsegment")).alias("cap"), F.concat(F.lit("****"), text.mask(F.col("c_name"), "x[-4..-1]")).alias("masked"), text.mask(F.col("c_name"), "xxx-xxx").alias("cut"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN (c_custkey * 10)::VARCHAR ELSE c_custkey::VARCHAR END AS spiked, c_custkey % 7 = 0 AND c_custkey % 10 <> 0 AS flag FROM customer")
def missing_and_anomaly(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    u, v = F.pmod(k, F.lit(10)) / 10, F.pmod(k, F.lit(7)) / 7
    return c.select("c_custkey", checks.missing(F.col("c_name"), u, 0.05, "n/a").alias("name"), checks.anomaly(k.cast("string"), v, 0.05).alias("spiked"), checks.anomaly_flag(k.cast("string"), v, 0.05, u, 0.05).alias("flag"))


# --- dates -----------------------------------------------------------------------------


@query("SELECT i AS id, strftime(TIMESTAMP '2024-01-31' + to_months(i::INT), '%Y-%m-%d') AS day FROM range(0, 60) r(i)")
def date_walk_month_clamp(spark, d):
    return spark.range(60).select("id", dates.formatted(dates.walked(datetime(2024, 1, 31), "1mo", F.col("id")), "YYYY-MM-DD").alias("day"))


@query("SELECT row_number() OVER (ORDER BY day) - 1 AS id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT TIMESTAMP '2024-03-06' + to_days(i::INT) AS day FROM range(0, 140) r(i)) WHERE isodow(day) <= 5")
def date_walk_weekdays(spark, d):
    return spark.range(100).select("id", dates.formatted(dates.walked(datetime(2024, 3, 6), "1d", F.col("id"), "mon..fri"), "YYYY-MM-DD").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate + to_days(10), '%Y-%m-%d') AS due, strftime(o_orderdate + to_days(3 + CAST(floor((o_orderkey % 13 + 0.5) / 13 * 8) AS INT)), '%Y-%m-%d') AS shipped FROM orders")
def date_offset(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    u = (F.pmod(F.col("o_orderkey"), F.lit(13)) + 0.5) / 13
    return t(spark, d, "orders").select("o_orderkey", dates.formatted(dates.offset(ts, "10d"), "YYYY-MM-DD").alias("due"), dates.formatted(dates.offset(ts, "3..10d", u), "YYYY-MM-DD").alias("shipped"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS a, strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS b, strftime(o_orderdate, '%a') AS c, day(o_orderdate) || ' ' || ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][month(o_orderdate)] AS f FROM orders")
def date_format_tokens(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return t(spark, d, "orders").select("o_orderkey", dates.formatted(ts, "DD.MM.YYYY HH:mm").alias("a"), dates.formatted(ts, "MMMM D, YYYY").alias("b"), dates.formatted(ts, "ddd").alias("c"), dates.formatted(ts, "D MMMM", "fr").alias("f"))


@query("SELECT i AS id, strftime(TIMESTAMP '2015-01-01' + to_days(least(floor((i + 0.5) / 1000 * 4018), 4017)::INT), '%Y-%m-%d') AS day FROM range(0, 1000) r(i)")
def date_uniform(spark, d):
    u = (F.col("id") + 0.5) / 1000
    return spark.range(1000).select("id", dates.formatted(dates.uniform_between(u, datetime(2015, 1, 1), datetime(2025, 12, 31)), "YYYY-MM-DD").alias("day"))


# --- statistical shapes ------------------------------------------------------------------


@query("SELECT i AS id, round(10 + 0.5 * i + 3 * cos(2 * pi() * (i - 6) / 24), 6) AS v FROM range(0, 500) r(i)")
def timeseries_no_noise(spark, d):
    return spark.range(500).select("id", F.round(shapes.timeseries(F.col("id"), base=10, trend=0.5, period=24, amplitude=3), 6).alias("v"))


@query("""SELECT id, round(5 + 2 * sqrt(-2 * ln(u)) * cos(2 * pi() * w), 6) AS n, round(-ln(1 - u) / 0.5, 6) AS e, round(2 / pow(1 - u, 1 / 3.0), 6) AS p, round(4 * pow(-ln(1 - u), 1 / 1.5), 6) AS w, round(exp(0.5 * sqrt(-2 * ln(u)) * cos(2 * pi() * w)), 6) AS l
FROM (SELECT i AS id, (i + 0.5) / 1000 AS u, (i * 7 % 1000 + 0.5) / 1000 AS w FROM range(0, 1000) r(i))""")
def distributions(spark, d):
    u, w = (F.col("id") + 0.5) / 1000, (F.pmod(F.col("id") * 7, F.lit(1000)) + 0.5) / 1000
    six = lambda c, n: F.round(c, 6).alias(n)
    return spark.range(1000).select("id", six(shapes.normal(u, w, 5, 2), "n"), six(shapes.exponential(u, 0.5), "e"), six(shapes.pareto(u, 3, 2), "p"), six(shapes.weibull(u, 1.5, 4), "w"), six(shapes.lognormal(u, w, 0, 0.5), "l"))


@query("""WITH RECURSIVE p AS (SELECT 0 AS k, exp(-3.0) AS q, exp(-3.0) AS c UNION ALL SELECT k + 1, q * 3.0 / (k + 1), c + q * 3.0 / (k + 1) FROM p WHERE k < 60),
z AS (SELECT k, sum(1.0 / k) OVER (ORDER BY k) / (SELECT sum(1.0 / j) FROM range(1, 11) s(j)) AS c FROM range(1, 11) r(k))
SELECT i AS id, (SELECT count(*) FROM p WHERE c < (i + 0.5) / 500)::BIGINT AS po, (SELECT count(*) FROM z WHERE c < (i + 0.5) / 500)::BIGINT + 1 AS zi FROM range(0, 500) r(i)""")
def discrete_distributions(spark, d):
    u = (F.col("id") + 0.5) / 500
    return spark.range(500).select("id", shapes.poisson(u, 3.0).alias("po"), shapes.zipf(u, 10, 1.0).alias("zi"))


@query("SELECT i AS id, round(-2 * ln(1 - (i + 0.5) / 200), 5) AS g, round((i + 0.5) / 200, 6) AS b, round(1 - sqrt(1 - (i + 0.5) / 200), 6) AS b12 FROM range(0, 200) r(i)")
def gamma_and_beta(spark, d):
    """Gamma of shape 1 and beta of (1, 1) and (1, 2) have closed forms."""
    u = (F.col("id") + 0.5) / 200
    return spark.range(200).select("id", F.round(shapes.gamma(u, 1.0, 2.0), 5).alias("g"), F.round(shapes.beta(u, 1.0, 1.0), 6).alias("b"), F.round(shapes.beta(u, 1.0, 2.0), 6).alias("b12"))


@query("SELECT i AS id, round(CASE WHEN t <= 0.5 THEN 20 * t ELSE 10 - 12 * (t - 0.5) END, 6) AS lin, CASE WHEN t >= 1 THEN 4.0 WHEN t >= 0.5 THEN 10.0 ELSE 0.0 END::DOUBLE AS st FROM (SELECT i, i / 99.0 AS t FROM range(0, 100) r(i))")
def drawn_curve(spark, d):
    tt = F.col("id") / 99
    pts = [(0, 0), (0.5, 10), (1, 4)]
    return spark.range(100).select("id", F.round(shapes.curve(pts, tt), 6).alias("lin"), shapes.curve(pts, tt, "step").alias("st"))


@query("SELECT i AS id, round(sqrt((i + 0.5) / 100), 2) AS x FROM range(0, 100) r(i)")
def drawn_density(spark, d):
    return spark.range(100).select("id", F.round(shapes.density((F.col("id") + 0.5) / 100, [(0, 0), (1, 1)], 0, 1), 2).alias("x"))


# --- constraints ----------------------------------------------------------------------------


@query("SELECT 3000 AS n, 3000 AS distinct_n, 15 AS a, 20 AS b, 10 AS c")
def uniq_mixed_radix(spark, d):
    a, b, c = checks.combinations(F.col("id"), [15, 20, 10], 3000, "s", "pair")
    return spark.range(3000).select(a.alias("a"), b.alias("b"), c.alias("c")).agg(F.count("*").alias("n"), F.countDistinct("a", "b", "c").alias("distinct_n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"), F.countDistinct("c").alias("c"))


@query("SELECT i AS id, true AS ok FROM range(0, 500) r(i)")
def distinct_within_row(spark, d):
    draw = lambda f: [rng.between("s", f"{f}#d{k}", F.col("id"), 1, 4) for k in range(checks.APART)]
    more = [checks.later(lambda k, f=f: rng.between("s", f"{f}#d", F.col("id") * checks.ATTEMPTS + k, 1, 4)) for f in "xyz"]
    x, y, z = (F.get("v", k) for k in range(3))
    return spark.range(500).withColumn("v", checks.differing([draw("x"), draw("y"), draw("z")], more)).select("id", ((x != y) & (y != z) & (x != z)).alias("ok"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS count FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def uniq_duplicates(spark, d):
    return checks.duplicates(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT 'ok' AS result")
def assert_share(spark, d):
    df = checks.with_stat(percent_rows(spark), "paid", "mean", "share")
    checks.check(df.select("share"), "share > 0.69 && share < 0.71", "the paid share should be 70 %")
    return spark.range(1).select(F.lit("ok").alias("result"))


def percent_rows(spark: SparkSession) -> DataFrame:
    place = rng.slot("s", "paid", 1000, F.col("id"))
    return spark.range(1000).select(apportion.pick(place, [700, 300], [1, 0]).alias("paid"))
