"""Descriptions: the same rows on any number of partitions, exact shares, relations, lists, checks."""
import pytest

from rowloom.plans import sinks
from rowloom.plans.build import Run
from rowloom.plans.config import ConfigError
from rowloom.sources import files


def env(body, count=20, extra=""):
    return f'<tdc><env count="{count}" seed="s"{extra}>{body}</env></tdc>'


def seq(name, gen, attrs=""):
    return f'<sequence name="{name}"{attrs}>{gen}</sequence>'


def rows(spark, body, count=20, **how):
    return [r.asDict() for r in Run(spark, env(body, count), **how).table(keep_id=True).orderBy("_id").collect()]


BASIC = (
    seq("Id", '<gen type="increment" value="1000" step="5"/>') + seq("Kind", '<gen type="text" value="A,B,C" percent="50,,20"/>')
    + seq("N", '<gen type="number" value="-5..5"/>') + seq("P", '<gen type="number" value="0000..9999"/>') + seq("D", '<gen type="number" value="0..9" decimals="2"/>')
    + seq("Code", '<gen type="regex" value="[A-Z]{2}[0-9]{4}"/>') + seq("Sym", '<gen type="symbol" value="[a-c]" length="3"/>')
    + seq("Day", '<gen type="date" range="2020-01-01..2020-12-31"/>') + seq("U", '<gen type="template" value="common.id.uuid"/>')
)


def test_partitions_do_not_matter(spark):
    one, many = rows(spark, BASIC, 50, partitions=1), rows(spark, BASIC, 50, partitions=7)
    assert one == many
    assert [r["Id"] for r in one[:2]] == ["1000", "1005"]
    kinds = [r["Kind"] for r in one]
    assert (kinds.count("A"), kinds.count("B"), kinds.count("C")) == (25, 15, 10)
    assert all(len(r["P"]) == 4 and -5 <= int(r["N"]) <= 5 and r["Day"][:4] == "2020" for r in one)
    assert len({r["U"] for r in one}) == 50


@pytest.mark.parametrize("n", [0, 1, 3, 7, 8, 201])
def test_shares_add_up(spark, n):
    assert len(rows(spark, seq("K", '<gen type="text" value="x,y,z"/>'), n)) == n


def test_parent_and_switch(spark):
    got = rows(spark, seq("G", '<gen type="text" value="m,f" percent="60,40"/>') + seq("Only", '<gen type="text" value="p,q" percent="50,50"/>', ' parent="G.m"')
               + '<switch name="Title" on="G"><case is="m"><data>Mr</data></case><default><data>Ms</data></default></switch>')
    assert sum(r["Only"] is not None for r in got) == 12 and [r["Only"] for r in got].count("p") == 6
    assert all((r["Only"] is None) == (r["G"] == "f") and r["Title"] == {"m": "Mr", "f": "Ms"}[r["G"]] for r in got)


def test_mix_running_stat_formula(spark):
    body = (
        '<mix name="M" percent="75,25" flag="Odd"><case><gen type="number" value="1..9"/></case><case anomaly="true"><data>99</data></case></mix>'
        + seq("N", '<gen type="number" value="1..9"/>') + seq("Sum", '<gen type="running" of="N" base="100"/>') + seq("All", '<gen type="stat" of="N" op="sum"/>')
        + seq("Twice", '<gen type="formula" expr="N * 2 + 1"/>')
    )
    got, total = rows(spark, body), 100
    assert sum(r["Odd"] == "true" for r in got) == 5 and all((r["M"] == "99") == (r["Odd"] == "true") for r in got)
    for r in got:
        total += int(r["N"])
        assert r["Sum"] == str(total) and int(r["Twice"]) == 2 * int(r["N"]) + 1
    assert {r["All"] for r in got} == {str(total - 100)}


def test_lists_pools_uniq(spark):
    body = (
        '<pool name="P" count="5">' + seq("City", '<gen type="text" value="a,b,c,d,e"/>') + seq("Zip", '<gen type="number" value="100..999"/>') + "</pool>"
        + seq("Tags", '<gen type="text" value="x,y" repeat="0..3"/>') + seq("Where", '<gen type="pool" value="P"/>')
        + seq("Pair", '<gen name="A" type="number" value="1..5"/><gen name="B" type="number" value="1..4"/>', ' uniq="true"')
    )
    got = rows(spark, body)
    sizes = [len(r["Tags"].split(",")) if r["Tags"] else 0 for r in got]
    assert sorted(sizes) == sorted([0, 1, 2, 3] * 5)
    assert len({(r["Pair.A"], r["Pair.B"]) for r in got}) == 20
    assert len({(r["Where.City"], r["Where.Zip"]) for r in got}) <= 5


LINKED = '<gen name="A" type="file" src="{0}" column="a" row="i"{1}/><gen name="B" type="file" src="{0}" column="b" row="i"/>'


@pytest.mark.parametrize("limit,parts", [(5, 1), (5, 3), (100, 1)])
def test_linked_rows_beyond_the_limit(spark, tmp_path, monkeypatch, limit, parts):
    monkeypatch.setattr(files, "LIMIT", limit)
    (tmp_path / "c").mkdir()
    for k in range(parts):
        (tmp_path / "c" / f"{k}.csv").write_text("a,b\n" + "".join(f"x{i},y{i}\n" for i in range(k, 30, parts)))
    got = rows(spark, seq("L", LINKED.format(tmp_path / "c", "")), 600)
    assert len(got) == 600 and all(r["L.A"][1:] == r["L.B"][1:] for r in got)
    assert {r["L.A"] for r in got} == {f"x{i}" for i in range(30)}


@pytest.mark.parametrize("limit", [2, 100])
def test_linked_rows_by_weight(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(files, "LIMIT", limit)
    path = tmp_path / "c.csv"
    path.write_text("a,b,n\nx0,y0,500\nx1,y1,0\nx2,y2,1200\nx3,y3,300\n")
    got = rows(spark, seq("L", LINKED.format(path, ' weight="n"')), 200)
    drawn = [r["L.A"] for r in got]
    assert {x: drawn.count(x) for x in set(drawn)} == {"x0": 50, "x2": 120, "x3": 30}
    assert all(r["L.A"][1:] == r["L.B"][1:] for r in got)
    with pytest.raises(ConfigError, match="weight"):
        rows(spark, seq("L", LINKED.format(path, "") + f'<gen name="C" type="file" src="{path}" column="a" row="i" weight="n"/>'), 20)
    path.write_text("a,b,n\nx0,y0,\nx1,y1,3\n")
    with pytest.raises(ConfigError, match="numbers"):
        rows(spark, seq("L", LINKED.format(path, ' weight="n"')), 20)


def test_distinct_redraws_until_a_value_is_left(spark):
    body = "".join(seq(x, '<gen type="number" value="1..4"/>') for x in "ABC") + '<distinct of="A,B,C"/>'
    df = Run(spark, env(body, 40_000)).table()
    assert df.where("A != B and B != C and A != C").count() == 40_000


@pytest.mark.parametrize("body,code", [
    (seq("A", '<gen type="nothing"/>'), "E012"), (seq("_A", '<gen type="increment"/>'), "E014"), (seq("A", '<gen type="increment"/>') * 2, "E015"), (seq("A", '<gen type="increment"/>', ' parent="B.x"'), "E016"),
    (seq("A", "<gen type='text' value=\"a\"/>"), "E005"), (seq("A", '<gen type="text" value="a,b" percnt="90,10"/>'), "E018"), ('<sequence name="A"></sequence>', "E017"), (seq("A", '<gen type="text"/>'), "E019"),
    (seq("A", '<gen type="text" name="X" value="a,b" percent="90,10"/><gen type="number" name="Y" value="1..99"/>', ' uniq="true"'), "E083"), (seq("A", '<gen type="number" value="1..99" missing="0.5"/>', ' uniq="true"'), "E083"),
    (seq("A", '<gen type="number" value="1..9" missing="2"/>'), "E030"), (seq("A", '<gen type="number" value="1..3"/>', ' uniq="true"'), "E080"),
])
def test_refusals(spark, body, code):
    with pytest.raises(ConfigError) as e:
        rows(spark, body)
    assert e.value.code == code


def test_assert_stops_the_run(spark):
    with pytest.raises(AssertionError, match="too many"):
        rows(spark, seq("N", '<gen type="number" value="1..9"/>') + seq("S", '<gen type="stat" of="N" op="count"/>') + '<assert that="S &lt; 5" says="too many"/>')


@pytest.mark.parametrize("kind,text", [
    ("int32", "2147483648"), ("uint8", "-1"), ("int64", "1.0"), ("float", "1e39"), ("float16", "65520"), ("double", "inf"), ("bool", "yes"), ("decimal(5,2)", "1.234"), ("decimal(5,2)", "1234.5"), ("date", "2023-02-29"), ("timestamp", "noon"), ("uuid", "12"), ("int32", ""),
])
def test_what_a_type_cannot_hold_stops_the_run(spark, kind, text):
    df = spark.createDataFrame([(text,)], "v string")
    with pytest.raises(Exception, match="v: "):
        df.select(sinks.checked(df.v, sinks.parse_type(kind), "v")).collect()


@pytest.mark.parametrize("text", ["int", "[]", "decimal", "decimal(19,2)", "int32(1,2)", "int32|none"])
def test_types_that_are_none(text):
    with pytest.raises(ConfigError, match="E075"):
        sinks.parse_type(text)


def test_pool_without_an_allowed_member_stops_the_run(spark):
    body = '<pool name="P" count="3">' + seq("A", '<gen type="increment" value="5"/>') + "</pool>" + seq("N", '<gen type="increment" value="1"/>') + seq("X", '<gen type="pool" value="P" filter="A &lt; N"/>')
    with pytest.raises(Exception, match="no member"):
        rows(spark, body, 3)


def test_formula_to_no_number_stops_the_run(spark):
    with pytest.raises(Exception, match="no number|DIVIDE_BY_ZERO"):
        rows(spark, seq("N", '<gen type="text" value="0"/>') + seq("F", '<gen type="formula" expr="1 / N"/>'), 2)


def test_text_keeps_the_order_of_rows_after_a_shuffle(spark, tmp_path):
    body = seq("Id", '<gen type="increment" value="1"/>') + seq("G", '<gen type="text" value="a,b"/>') + seq("R", '<gen type="running" of="Id" reset="G"/>')
    r = Run(spark, f'<tdc><env count="300" seed="s">{body}</env><block><line><data>${{{{Id}}}} ${{{{R}}}}</data></line></block></tdc>')
    r.write(str(tmp_path / "out.txt"), single=True)
    assert [x.split()[0] for x in (tmp_path / "out.txt").read_text().splitlines()] == [str(i + 1) for i in range(300)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.txt"]


def test_a_run_without_a_seed_invents_one(spark):
    text = '<tdc><env count="20">' + seq("N", '<gen type="number" value="1..1000000"/>') + "</env></tdc>"
    a, b = Run(spark, text), Run(spark, text)
    assert a.seed != b.seed and a.table().collect() != b.table().collect()
    assert Run(spark, text, seed=a.seed).table().collect() == a.table().collect()
