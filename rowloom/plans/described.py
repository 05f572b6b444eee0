"""Queries that run a whole description, with SQL that says what its rows must be.

Where values are drawn, the query returns what must hold of all draws: counts of exact
shares, bounds, numbers of different values.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from ..functions import compute, expr
from .build import Run
from .queries import n_, query, t

SHARED = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """A new place in the folder that all machines share; only in local mode, where none is set, one of our own."""
    shared = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SHARED} is unset")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/described-{uuid.uuid4().hex}"


def run(spark: SparkSession, body: str, count: int, block: str = "", **how) -> Run:
    return Run(spark, f'<tdc><env count="{count}" seed="s">{body}</env>{block}</tdc>', **how)


def s(name: str, gen: str, attrs: str = "") -> str:
    return f'<sequence name="{name}"{attrs}>{gen}</sequence>'


def g(kind: str, **attrs) -> str:
    return "<gen type=\"" + kind + "\" " + " ".join(f'{k.rstrip("_")}="{v}"' for k, v in attrs.items()) + "/>"


def block(*lines: str) -> str:
    return "<block>" + "".join(x if x.startswith("<line") else f"<line><data>{x}</data></line>" for x in lines) + "</block>"


ID = s("Id", g("increment", value="1"))


def described(name: str, sql: str, body: str, count: int, lay: str = "", then=None) -> None:
    """Registers the query `name`: the table of a description, or what `then` makes of the run."""

    def f(spark, d):
        made = run(spark, body, count, lay)
        return then(made) if then else made.table()

    f.__name__ = name
    query(sql)(f)


def told_apart(df: DataFrame) -> DataFrame:
    """df. Where two of its names differ in case only (N, n), its session tells names apart by case from here on: else Spark neither writes the table nor reads it back."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    return df


def shares(*columns: str):
    return lambda r: told_apart(r.table().groupBy(*columns).agg(F.count("*").alias("n")))


def every(**checks: str):
    """One row: whether each condition holds of all rows."""
    return lambda r: r.table().agg(*[F.bool_and(F.expr(e)).alias(k) for k, e in checks.items()])


# --- counters, values, built-ins ---

described("run_counters", "SELECT (1000 + 5 * i)::VARCHAR AS \"Id\", printf('%.2f', 7.5 - 0.25 * i) AS \"Down\", (9 - 2 * i)::VARCHAR AS \"Less\" FROM range(0, 500) r(i)",
          s("Id", g("increment", value="1000", step="5")) + s("Down", g("decrement", value="7.50", step="0.25")) + s("Less", g("decrement", value="9", step="2")), 500)
described("run_sequential", "SELECT (i + 1)::VARCHAR AS \"Id\", list_extract(['red', 'green', 'blue'], (i % 3 + 1)::INT) AS \"C\" FROM range(0, 100) r(i)", ID + s("C", g("text", value="red,green,blue", order="sequential")), 100)
described("run_builtins", "SELECT i AS _id, concat(i + 1, ' of 40 ', CASE WHEN i = 0 THEN 'true' ELSE 'false' END, ' ', CASE WHEN i = 39 THEN 'true' ELSE 'false' END, chr(10)) AS text FROM range(0, 40) r(i)",
          ID, 40, block("${{_count}} of ${{_total}} ${{_first}} ${{_last}}"), lambda r: r.rendered())
described("run_percent", "SELECT * FROM (VALUES ('active', 7000), ('trial', 2000), ('closed', 1000)) v(\"S\", n)", s("S", g("text", value="active,trial,closed", percent="70,20,10")), 10_000, then=shares("S"))
described("run_composed", "SELECT concat('A-', i + 1, '/', 2 * i, '.') AS \"C\" FROM range(0, 50) r(i)",
          s("C", '<data>A-</data>' + g("increment", value="1") + '<data>/</data>' + g("increment", value="0", step="2") + '<data>.</data>'), 50)
described("run_compound", "SELECT (i + 1)::VARCHAR AS \"P.A\", (10 * i)::VARCHAR AS \"P.B\", 'EUR' AS \"P.C\" FROM range(0, 50) r(i)",
          s("P", g("increment", name="A", value="1") + g("increment", name="B", value="0", step="10") + '<data name="C" value="EUR"/>'), 50)

# --- numbers and texts that are drawn ---

described("run_number_ranges", "SELECT '1' AS low, '6' AS high, 6 AS distinct_n, '0,1,2,4,7,8,9,20,21' AS left_over, '0,1' AS bits, true AS padded, true AS two_places",
          s("N", g("number", value="1..6")) + s("X", g("number", value="0..9", include="20..21", exclude="3,5..6")) + s("B", g("number", value="bit")) + s("P", g("number", value="0000..9999")) + s("D", g("number", value="0..9", decimals="2")), 5000,
          then=lambda r: r.table().agg(F.min("N").alias("low"), F.max("N").alias("high"), F.countDistinct("N").cast("int").alias("distinct_n"), F.array_join(F.transform(F.array_sort(F.collect_set(F.col("X").cast("int"))), lambda x: x.cast("string")), ",").alias("left_over"),
                                       F.array_join(F.array_sort(F.collect_set("B")), ",").alias("bits"), F.bool_and(F.length("P") == 4).alias("padded"), F.bool_and(F.expr("D rlike '^[0-9][.][0-9]{2}$'")).alias("two_places")))
described("run_number_length", "SELECT * FROM (VALUES (2, 600, true), (3, 300, true), (4, 100, true)) v(size, n, leads)", s("N", g("number", length="2..4", percent="60,30,10")), 1000,
          then=lambda r: r.table().groupBy(F.length("N").alias("size")).agg(F.count("*").alias("n"), F.bool_and(~F.col("N").startswith("0")).alias("leads")))
described("run_symbol_regex", "SELECT true AS sym, 27 AS syms, true AS code, true AS either, true AS back",
          s("S", g("symbol", value="[a-c]", length="3")) + s("R", g("regex", value="[A-Z]{2}[0-9]{4}")) + s("E", g("regex", value="(ab|cd)x{1,3}")) + s("B", g("regex", value="([0-9])-\\1")), 5000,
          then=lambda r: r.table().agg(F.bool_and(F.expr("S rlike '^[abc]{3}$'")).alias("sym"), F.countDistinct("S").cast("int").alias("syms"), F.bool_and(F.expr("R rlike '^[A-Z]{2}[0-9]{4}$'")).alias("code"), F.bool_and(F.expr("E rlike '^(ab|cd)x{1,3}$'")).alias("either"), F.bool_and(F.expr("left(B, 1) = right(B, 1)")).alias("back")))
described("run_uuid", "SELECT 3000 AS n, true AS shaped", s("U", g("template", value="common.id.uuid")), 3000,
          then=lambda r: r.table().agg(F.countDistinct("U").cast("int").alias("n"), F.bool_and(F.expr("U rlike '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'")).alias("shaped")))
described("run_expression_parameters", "SELECT (i + 1)::VARCHAR AS \"Id\", (10 * (i + 1))::VARCHAR AS \"N\", printf('%.2f', 2.0 * (i + 1) + 1) AS \"M\" FROM range(0, 200) r(i)",
          ID + s("N", g("number", distribution="normal", mean="Id * 10", sd="0", decimals="0")) + s("M", g("number", distribution="normal", mean="Id * 2 + 1", sd="0")), 200)
described("run_distribution_clip", "SELECT true AS inside, true AS whole, true AS ranks", s("N", g("number", distribution="normal", mean="50", sd="40", min="0", max="100", decimals="1")) + s("P", g("number", distribution="poisson", lambda_="3")) + s("Z", g("number", distribution="zipf", n="10", s="1")), 3000,
          then=every(inside="cast(N as double) between 0 and 100 and N rlike '^[0-9]+[.][0-9]$'", whole="P rlike '^[0-9]+$'", ranks="cast(Z as int) between 1 and 10"))
described("run_pack", "SELECT 10 AS names, true AS by_gender", s("G", g("text", value="male,female")) + s("L", g("template", value="person.lastName")) + s("F", g("template", value="person.${{G}}.firstName")), 2000,
          then=lambda r: r.table().agg(F.countDistinct("L").cast("int").alias("names"), F.bool_and((F.col("G") == "male") == F.col("F").isin("Adam", "Boris", "Carl", "David", "Erik", "Frank", "Georg", "Hugo", "Ivan", "Jakob")).alias("by_gender")))

# --- dates ---

described("run_dates", "SELECT true AS inside, true AS due, true AS works", s("D", g("date", range="2020-01-01..2020-12-31")) + s("E", g("date", of="D", plus="3..10d")) + s("W", g("date", order="sequential", from_="2024-03-06", step="1d", weekdays="mon..fri")), 1000,
          then=every(inside="D between '2020-01-01' and '2020-12-31'", due="datediff(cast(E as date), cast(D as date)) between 3 and 10", works="weekday(cast(W as date)) < 5"))
described("run_birthdays", "SELECT true AS aged", s("B", g("template", value="person.b_day", oldest="65", youngest="18")), 2000, then=lambda r: Run(r.spark, '<tdc><env count="2000" seed="s">' + s("B", g("template", value="person.b_day", oldest="65", youngest="18", format="YYYY-MM-DD")) + "</env></tdc>", now=sinks_now()).table().agg(F.bool_and(F.expr("B between '1958-01-01' and '2007-01-02'")).alias("aged")))


def sinks_now():
    from datetime import datetime

    return datetime(2025, 1, 1)


described("run_date_locales", """SELECT concat(d, ' ', list_extract(['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'], i + 1)) AS "F", concat(list_extract(['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'], isodow(t)::INT), ', ', d) AS "G",
concat(strftime(t, '%B'), ' ', d, ', 2024 00:00') AS "E" FROM (SELECT i::INT AS i, make_timestamp(2024, i + 1, 15, 0, 0, 0.0) AS t, 15 AS d FROM range(0, 12) r(i))""",
          s("F", g("date", order="sequential", from_="2024-01-15", step="1mo", format="D MMM", local="fr")) + s("G", g("date", order="sequential", from_="2024-01-15", step="1mo", format="ddd, D", local="de")) + s("E", g("date", order="sequential", from_="2024-01-15", step="1mo", format="LLL")), 12)

# --- relations ---

described("run_parent", "SELECT * FROM (VALUES ('m', 'p', 300), ('m', 'q', 300), ('f', NULL, 400)) v(\"G\", \"O\", n)", s("G", g("text", value="m,f", percent="60,40")) + s("O", g("text", value="p,q", percent="50,50"), ' parent="G.m"'), 1000, then=shares("G", "O"))
described("run_bare_parent", "SELECT CASE WHEN i % 2 = 0 THEN 'm' ELSE 'f' END AS \"G\", CASE WHEN i % 2 = 0 THEN 'x' END AS \"A\", CASE WHEN i % 2 = 0 THEN (i / 2 + 1)::INT::VARCHAR END AS \"B\" FROM range(0, 60) r(i)",
          s("G", g("text", value="m,f", order="sequential")) + s("A", g("text", value="x"), ' parent="G.m"') + s("B", g("increment", value="1"), ' parent="A"'), 60)
described("run_conditional", "SELECT (i + 1)::VARCHAR AS \"Id\", CASE WHEN i + 1 > 60 THEN 'high' WHEN i + 1 > 20 THEN 'mid' ELSE 'low' END AS \"C\" FROM range(0, 100) r(i)",
          ID + s("C", '<gen type="text" value="high" if="Id &gt; 60"/><gen type="text" value="mid" if="Id &gt; 20"/><gen type="text" value="low"/>'), 100)
described("run_nested_switch", "SELECT list_extract(['a', 'b', 'c'], (i % 3 + 1)::INT) AS \"K\", list_extract(['1', '2'], (i % 2 + 1)::INT) AS \"L\", CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN CASE WHEN i % 2 = 0 THEN 'B1' ELSE 'Bx' END ELSE concat('other ', list_extract(['1', '2'], (i % 2 + 1)::INT)) END AS \"S\" FROM range(0, 60) r(i)",
          s("K", g("text", value="a,b,c", order="sequential")) + s("L", g("text", value="1,2", order="sequential")) + '<switch name="S" on="K"><case is="a"><data>A</data></case><case is="b"><switch on="L"><case is="1"><data>B1</data></case><default><data>Bx</data></default></switch></case><default><data>other ${{L}}</data></default></switch>', 60)
described("run_mix_flag", "SELECT * FROM (VALUES ('true', true, 50), ('false', false, 950)) v(\"Odd\", high, n)", '<mix name="M" percent="95,5" flag="Odd"><case>' + g("number", value="1..9") + '</case><case anomaly="true">' + g("number", value="1000..1009") + "</case></mix>", 1000,
          then=lambda r: r.table().groupBy("Odd", (F.col("M").cast("int") >= 1000).alias("high")).agg(F.count("*").alias("n")))
described("run_pool", "SELECT 20 AS members, true AS whole, true AS same_kind", '<pool name="Q" count="3">' + s("K", g("text", value="a,b,c", order="sequential")) + '</pool><pool name="P" count="20">' + s("City", g("increment", value="1")) + s("Zip", g("increment", value="1001")) + s("Kind", g("text", value="a,b,c", order="sequential")) + "</pool>"
          + s("K", g("text", value="a,b,c", order="sequential")) + s("W", g("pool", value="P")) + s("E", g("pool", value="P", filter="Kind == K")), 2000,
          then=lambda r: r.table().agg(F.countDistinct("`W.City`").cast("int").alias("members"), F.bool_and(F.expr("cast(`W.Zip` as int) - cast(`W.City` as int) = 1000")).alias("whole"), F.bool_and(F.col("`E.Kind`") == F.col("K")).alias("same_kind")))
described("run_nested_pool", "SELECT 4 AS cities, true AS follows", '<pool name="City" count="4">' + s("Name", g("increment", value="1")) + s("Zip", g("increment", value="101")) + '</pool><pool name="Shop" count="30">' + s("At", g("pool", value="City")) + "</pool>" + s("S", g("pool", value="Shop")), 2000,
          then=lambda r: r.table().agg(F.countDistinct("`S.At.Name`").cast("int").alias("cities"), F.bool_and(F.expr("cast(`S.At.Zip` as int) - cast(`S.At.Name` as int) = 100")).alias("follows")))
described("run_running", "SELECT (i + 1)::VARCHAR AS \"Id\", (100 + (i + 1) * (i + 2) / 2)::BIGINT::VARCHAR AS \"T\", '1' AS \"L\", (i % 4 + 1)::VARCHAR AS \"R\", '400' AS \"N\", '200.50' AS \"M\", '400' AS \"X\" FROM range(0, 400) r(i)",
          ID + s("One", g("text", value="1")) + s("G", g("text", value="a,a,a,a,b,b,b,b", order="sequential")) + s("T", g("running", of="Id", base="100")) + s("L", g("running", of="Id", accumulate="min")) + s("R", g("running", of="One", reset="G"))
          + s("N", g("stat", of="Id", op="count")) + s("M", g("stat", of="Id", op="mean")) + s("X", g("stat", of="Id", op="max")), 400, then=lambda r: r.table().drop("One", "G"))

# --- lists ---

described("run_list_lengths", "SELECT * FROM (VALUES (0, 100), (1, 400), (2, 300), (3, 200)) v(size, n)", s("L", g("text", value="x,y", repeat="0..3", lengths="10,40,30,20")), 1000,
          then=lambda r: r.df.groupBy(F.size(r.info["L"].items).alias("size")).agg(F.count("*").alias("n")))
described("run_list_quota", "SELECT * FROM (VALUES ('x', 1200), ('y', 400)) v(item, n)", s("L", g("text", value="x,y", percent="75,25", repeat="0..3", lengths="10,40,30,20")), 1000,
          then=lambda r: r.df.select(F.explode(r.info["L"].items).alias("item")).groupBy("item").agg(F.count("*").alias("n")))
described("run_list_distinct", "SELECT true AS apart, 3 AS size", s("L", g("number", value="1..5", repeat="3..3", distinct="true")), 1000,
          then=lambda r: r.df.agg(F.bool_and(F.size(F.array_distinct(r.info["L"].items)) == 3).alias("apart"), F.max(F.size(r.info["L"].items)).alias("size")))
described("run_list_accumulate", "SELECT '5,10,15' AS \"A\", '0.10,0.20,0.30' AS \"B\", '9007199254740993;18014398509481986' AS \"C\" FROM range(0, 20)",
          s("A", g("number", value="5..5", repeat="3..3", accumulate="sum")) + s("B", g("number", value="0.10..0.10", decimals="2", repeat="3..3", accumulate="sum")) + s("C", g("text", value="9007199254740993", repeat="2..2", accumulate="sum", separator=";")), 20)
described("run_line_each", """SELECT i AS _id, concat('record ', i + 1, chr(10), 'n ', i * 3 + 1, ' ', i + 1, ' 5 1', chr(10), 'n ', i * 3 + 2, ' ', i + 1, ' 5 2', chr(10), 'm ', i * 3 + 3, ' 7', chr(10)) AS text FROM range(0, 50) r(i)""",
          ID + s("N", g("number", value="5..5", repeat="2..2")) + s("M", g("number", value="7..7", repeat="1..1")), 50,
          block("record ${{Id}}", '<line each="N"><data>n ${{_item_id}} ${{Id}} ${{N}} ${{_item}}</data></line>', '<line each="M"><data>m ${{_item_id}} ${{M}}</data></line>'), lambda r: r.rendered())
described("run_line_each_empty", "SELECT * FROM (VALUES (1, 25), (2, 25), (3, 25), (4, 25)) v(lines, n)", ID + s("N", g("text", value="x,y", repeat="0..3")), 100, block("${{Id}}", '<line each="N"><data>${{N}}</data></line>'),
          lambda r: r.rendered().groupBy((F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("lines")).agg(F.count("*").alias("n")))

# --- layout and sinks ---

_CARD = ('<before><line><data>[</data></line></before><after><line><data>]</data></line></after><delimiter_block><line><data>,</data></line></delimiter_block>', block('{"id": ${{Id}}, "k": "${{K|upper}}", "q": ${{K|csv}}, "s": \'${{Q|sql}}\', "t": "${{P|trim}}", "u": "${{Unknown}}"}'))
described("run_layout", "SELECT i AS _id, concat(CASE WHEN i = 0 THEN concat('[', chr(10)) ELSE '' END, '{\"id\": ', i + 1, ', \"k\": \"', CASE WHEN i % 2 = 0 THEN 'RED' ELSE 'BLUE' END, '\", \"q\": \"', CASE WHEN i % 2 = 0 THEN 'red' ELSE 'blue' END, '\", \"s\": ''it''''s'', \"t\": \"x y\", \"u\": \"${{Unknown}}\"}', chr(10), CASE WHEN i = 29 THEN concat(']', chr(10)) ELSE concat(',', chr(10)) END) AS text FROM range(0, 30) r(i)",
          ID + s("K", g("text", value="red,blue", order="sequential")) + s("Q", g("text", value="it's")) + s("P", g("text", value="  x y ")) + _CARD[0], 30, _CARD[1], lambda r: r.rendered())
described("run_lines_if", "SELECT i AS _id, concat('<', chr(10), 'placed ', i + 1, CASE WHEN i + 1 > 5 THEN '!' ELSE '' END, chr(10), CASE WHEN (i + 1) % 2 = 0 THEN concat('--', chr(10), '<', chr(10), 'shipped', chr(10)) ELSE '' END, CASE WHEN (i + 1) % 3 = 0 THEN concat('--', chr(10), '<', chr(10), 'closed', chr(10)) ELSE '' END) AS text FROM range(0, 30) r(i)",
          ID + "<before_line><line><data>&lt;</data></line></before_line><delimiter_line><line><data>--</data></line></delimiter_line>", 30,
          block('<line><data>placed ${{Id}}</data><data if="Id &gt; 5">!</data></line>', '<line if="Id % 2 == 0"><data>shipped</data></line>', '<line if="Id % 3 == 0"><data>closed</data></line>'), lambda r: r.rendered())


def _read_back(r: Run) -> DataFrame:
    path = folder(r.spark) + ".txt"
    r.write(path, single=True)
    return r.spark.read.text(path).select(F.col("value").alias("line"))


described("run_text_file", "SELECT 'id,k' AS line UNION ALL SELECT concat(i + 1, ',', CASE WHEN i % 2 = 0 THEN 'red' ELSE 'blue' END) FROM range(0, 500) r(i)",
          ID + s("K", g("text", value="red,blue", order="sequential")) + "<before><line><data>id,k</data></line></before>", 500, block("${{Id}},${{K}}"), _read_back)


def _typed_back(r: Run) -> DataFrame:
    path = folder(r.spark) + ".parquet"
    r.write(path)
    return r.spark.read.parquet(path).withColumn("items", F.array_join("items", "+"))


described("run_parquet_file", "SELECT i + 1 AS id, ((i + 1) * 2)::INT AS twice, ((i % 200) + 1)::SMALLINT AS small, (i + 1)::DOUBLE / 4 AS quarter, i % 2 = 0 AS even, (DATE '2024-01-01' + i::INT) AS day, CASE WHEN i % 2 = 0 THEN 'x' END AS maybe, concat('no ', i + 1) AS label, ((i + 1) * 1.25)::DECIMAL(10, 2)::DOUBLE AS price, '5+5' AS items FROM range(0, 300) r(i)",
          ID + s("T", g("increment", value="2", step="2")) + s("S", g("formula", expr="(Id - 1) % 200 + 1", decimals="0")) + s("Q", g("increment", value="0.25", step="0.25")) + s("B", g("text", value="true,false", order="sequential")) + s("D", g("date", order="sequential", from_="2024-01-01", step="1d"))
          + s("M", g("text", value="x"), ' parent="B.true"') + s("P", g("increment", value="1.25", step="1.25")) + s("L", g("number", value="5..5", repeat="2..2")), 300,
          "<block><line>" + "".join(f'<data name="{n}"{k}>{v}</data>' for n, v, k in (("id", "${{Id}}", ""), ("twice", "${{T}}", ' type="int32"'), ("small", "${{S}}", ' type="uint8"'), ("quarter", "${{Q}}", ""), ("even", "${{B}}", ' type="bool"'), ("day", "${{D}}", ""), ("maybe", "${{M}}", ""), ("label", "no ${{Id}}", ""), ("price", "${{P}}", ' type="decimal(10,2)"'), ("items", "${{L}}", ""))) + "</line></block>",
          lambda r: _typed_back(r).withColumn("price", F.col("price").cast("double")))

_CASTS = [("int32", " 7 ", "7"), ("int64", "-9223372036854775808", "-9223372036854775808"), ("uint8", "255", "255"), ("uint64", "18446744073709551615", "18446744073709551615"), ("float16", "1.0004", "1.0"), ("float16", "65503", "65504.0"), ("bool", "TRUE", "true"), ("bool", "0", "false"),
          ("decimal(5,2)", "-123.4", "-123.40"), ("date", "2024-02-29", "2024-02-29"), ("timestamp", "2024-02-29T12:30:00+02:00", "2024-02-29 10:30:00"), ("timestamp", "2024-02-29", "2024-02-29 00:00:00"), ("uuid", "00112233445566778899AABBCCDDEEFF", "00112233-4455-6677-8899-aabbccddeeff"), ("string", " as it is ", " as it is "), ("int32|null", "", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {'NULL' if w is None else chr(39) + w + chr(39)})" for k, v, w in _CASTS) + ") v(kind, given, made)")
def checked_casts(spark, d):
    df = spark.createDataFrame([(k, v) for k, v, _ in _CASTS], "kind string, given string")
    made = None
    for k in dict.fromkeys(k for k, _, _ in _CASTS):
        c = sinks.checked(F.col("given"), sinks.parse_type(k), "given").cast("string")
        made = F.when(F.col("kind") == k, c) if made is None else made.when(F.col("kind") == k, c)
    return df.select("kind", "given", made.alias("made"))


# --- constraints ---

described("run_uniq", "SELECT 3000 AS n, 15 AS a, 20 AS b", s("P", g("text", name="A", value=",".join(f"a{i}" for i in range(15))) + g("number", name="B", value="1..20") + g("number", name="C", value="1..10"), ' uniq="true"'), 3000,
          then=lambda r: r.table().agg(F.countDistinct("`P.A`", "`P.B`", "`P.C`").cast("int").alias("n"), F.countDistinct("`P.A`").cast("int").alias("a"), F.countDistinct("`P.B`").cast("int").alias("b")))
described("run_uniq_counter", "SELECT (i + 1)::VARCHAR AS \"P.A\", 'k' AS \"P.B\" FROM range(0, 100) r(i)", s("P", g("increment", name="A", value="1") + g("text", name="B", value="k"), ' uniq="true"'), 100)
described("run_uniq_number", "SELECT 500 AS n, '1' AS low", s("N", g("number", value="1..600"), ' uniq="true"'), 500, then=lambda r: r.table().agg(F.countDistinct("N").cast("int").alias("n"), F.min(F.when(F.col("N").cast("int").between(1, 600), "1").otherwise("outside")).alias("low")))
described("run_env_uniq", "SELECT list_extract(['a', 'b', 'c'], (i % 3 + 1)::INT) AS \"A\", list_extract(['x', 'y', 'z', 'w'], (i % 4 + 1)::INT) AS \"B\" FROM range(0, 12) r(i)", s("A", g("text", value="a,b,c", order="sequential")) + s("B", g("text", value="x,y,z,w", order="sequential")) + '<uniq of="A,B"/>', 12)
described("run_env_distinct", "SELECT 4000 AS n", "".join(s(x, g("number", value="1..4")) for x in "ABC") + '<distinct of="A,B,C"/>', 4000, then=lambda r: r.table().where("A <> B and B <> C and A <> C").agg(F.count("*").cast("int").alias("n")))
described("run_missing_order", "SELECT '' AS \"A\", 'n/a' AS \"B\", '**' AS \"C\", 'false' AS \"F\" FROM range(0, 30)",
          s("A", g("number", value="1..9", missing="1")) + s("B", g("number", value="1..9", missing="1", missing_as="n/a")) + s("C", g("number", value="10..99", mask="\\*\\*")) + s("D", g("number", value="1..9", anomaly="1", anomaly_flag="F", missing="1")), 30, then=lambda r: r.table().drop("D"))
described("run_anomaly_rounds", "SELECT '15.1' AS \"A\", '0050' AS \"B\", 'word' AS \"C\", '-15.1' AS \"D\" FROM range(0, 10)",
          s("A", g("text", value="5.5", anomaly="1", anomaly_factor="2.75")) + s("B", g("text", value="0005", anomaly="1")) + s("C", g("text", value="word", anomaly="1")) + s("D", g("text", value="-5.5", anomaly="1", anomaly_factor="2.75")), 10)

# --- expressions and computing over tables ---


@query("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderstatus || '-' || o_orderpriority AS b, (-o_totalprice)::DOUBLE AS c, least(o_orderkey, 100) AS d, greatest(o_orderkey, o_custkey) AS e, NOT (o_orderkey > 100) AS f FROM orders")
def expression_signs_and_sums(spark, d):
    o = t(spark, d, "orders")
    v = lambda e: expr.of_frame(o, e)
    return o.select("o_orderkey", v("o_orderkey + 1").int.alias("a"), v("o_orderstatus + '-' + o_orderpriority").text.alias("b"), v("-o_totalprice").num.alias("c"), v("min(o_orderkey, 100)").int.alias("d"), v("max(o_orderkey, o_custkey)").int.alias("e"), expr.truth(v("!(o_orderkey > 100)")).alias("f"))


@query("SELECT 6.0 AS a, 3 AS b, 2.0 AS c, 1.0 AS d, 3.0 AS e, 2.0 AS f, 0.8165 AS g FROM range(0, 1)")
def expression_list_statistics(spark, d):
    df = spark.range(1).withColumn("l", F.lit("1;3;2"))
    v = lambda e: expr.of_frame(df, e)
    return df.select(v("sum(split(l, ';'))").num.alias("a"), v("count(split(l, ';'))").int.alias("b"), v("mean(split(l, ';'))").num.alias("c"), v("min(split(l, ';'))").num.alias("d"), v("max(split(l, ';'))").num.alias("e"), v("median(split(l, ';'))").num.alias("f"), F.round(v("stddev(split(l, ';'))").num, 4).alias("g"))


@query("SELECT n_nationkey, array_to_string(string_split(n_name, ' '), '_') AS joined, string_split(n_name, ' ')[1] AS first, coalesce(string_split(n_name, ' ')[2], 'none') AS second, length(n_name)::BIGINT AS n, upper(left(lower(n_name), 1)) || substr(lower(n_name), 2) AS cap, replace(n_name, 'A', '4') AS leet, substr(n_name, 2, 2) AS cut FROM nation")
def compute_texts(spark, d):
    low = compute.Lowering(lambda name: F.col(name))
    name, words = n_("field", name="n_name"), n_("split", n_("field", name="n_name"), sep=" ")
    at = lambda i, **a: n_("at", n_("in", words), n_("index", n_("int", v=str(i))), **a)
    made = {"joined": n_("join", n_("in", words), sep="_"), "first": at(0), "second": at(1, default="none"), "n": n_("length", name), "cap": n_("capitalize", n_("lower", name)), "leet": n_("replace", name, from_="A", to="4"), "cut": n_("slice", name, from_="1", to="3")}
    return t(spark, d, "nation").select("n_nationkey", *[low(x).col.alias(k) for k, x in made.items()])


described("run_compute", "SELECT (i + 1)::VARCHAR AS \"Id\", concat('T', lpad((i + 1)::VARCHAR, 5, '0'), '-', 3 * (i + 1)) AS \"C\" FROM range(0, 100) r(i)",
          ID + s("C", '<compute><let name="x"><multiply><to_number><field name="Id"/></to_number><int v="3"/></multiply></let><result><concat><str v="T"/><pad width="5"><field name="Id"/></pad><str v="-"/><use name="x"/></concat></result></compute>'), 100)
described("run_formula", "SELECT (i + 1)::VARCHAR AS \"Id\", printf('%.2f', (i + 1) / 4.0) AS \"Q\", (7 * (i + 1) + 2)::VARCHAR AS \"W\" FROM range(0, 100) r(i)", ID + s("Q", g("formula", expr="Id / 4", decimals="2")) + s("W", g("formula", expr="Id * 7 + 2", decimals="0")), 100)

# --- files ---


def _with_file(make, body: str, count: int, then):
    def f(spark, d):
        path = folder(spark)
        make(spark, d).coalesce(1).write.csv(path, header=True)
        return then(run(spark, body.replace("@", path), count))

    return f


def _file_query(name: str, sql: str, make, body: str, count: int, then=lambda r: r.table()):
    f = _with_file(make, body, count, then)
    f.__name__ = name
    query(sql)(f)


def _nations(spark, d):
    return t(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") % 3).alias("w")).orderBy("n_nationkey")


_file_query("run_csv_column", "SELECT n_name AS \"N\" FROM range(0, 50) r(i) JOIN nation ON n_nationkey = i % 25", _nations, s("N", g("file", src="@", column="n_name", order="sequential")), 50)
_file_query("run_csv_weights", "SELECT n_name AS \"N\", (20 * (n_nationkey % 3))::BIGINT AS n FROM nation WHERE n_nationkey % 3 > 0", _nations, s("N", g("file", src="@", column="n_name", weight="w")), 480, shares("N"))
_file_query("run_csv_row", "SELECT 25 AS n, true AS linked", _nations, s("L", g("file", name="K", src="@", column="n_nationkey", row="r") + g("file", name="N", src="@", column="w", row="r")), 3000,
            lambda r: r.table().agg(F.countDistinct("`L.K`").cast("int").alias("n"), F.bool_and(F.expr("cast(`L.K` as int) % 3 = cast(`L.N` as int)")).alias("linked")))
_file_query("run_quantile_exact", "SELECT round(greatest(least((i + 0.5) / 100 * 25 - 0.5, 24), 0), 2) AS q, count(*) AS n FROM range(0, 100) r(i) GROUP BY 1", _nations, s("Q", g("file", src="@", column="n_nationkey", read="quantile", sample="exact", decimals="2")), 100,
            lambda r: r.table().groupBy(F.col("Q").cast("double").alias("q")).agg(F.count("*").alias("n")))


@query("SELECT n_name AS \"N\" FROM range(0, 50) r(i) JOIN nation ON n_nationkey = i % 25")
def run_file_list(spark, d):
    path = folder(spark)
    t(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return run(spark, s("N", g("file", src=path, order="sequential")), 50).table()


described("run_corridor", "SELECT printf('%.2f', 10.0 * i / 99) AS \"C\" FROM range(0, 100) r(i)", s("C", g("pattern", upper="0,0;1,10", lower="0,0;1,10", y_range="0..10")), 100)
described("run_curve", "SELECT printf('%.2f', 10.0 * i / 99) AS \"C\", CASE WHEN i < 99 THEN '0.00' ELSE '10.00' END AS \"S\" FROM range(0, 100) r(i)", s("C", g("pattern", points="0,0;1,10", y_range="0..10")) + s("S", g("pattern", points="0,0;1,10", y_range="0..10", interp="step")), 100)
