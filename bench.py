"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""
import importlib.util
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowloom.plans import queries as own
from rowloom.plans.build import Run

HEADLINE = ["running_reset_segments", "running_total", "stat_exact", "pool_equi_pick", "switch_lookup", "formula", "loose_strict_truth", "each_explode_item_id", "compute_check_digits", "filters", "date_format_tokens", "mix_nested_share", "keyed_permutation"]
_NAMES = [",".join(f"{c}{i:03d}" for i in range(150)) for c in "CGS"]
#: Six fields and a line assembled of them, and combinations of three lists of 150 that repeat nowhere; both written as one text file.
CUSTOMERS = """<tdc><env count="{n}" seed="bench" local="en">
<sequence name="Id"><gen type="increment" value="1"/></sequence>
<sequence name="First"><gen type="template" value="person.male.firstName"/></sequence>
<sequence name="Last"><gen type="template" value="person.lastName"/></sequence>
<sequence name="Status"><gen type="text" value="active,trial,closed" percent="70,20,10"/></sequence>
<sequence name="Balance"><gen type="number" value="0..99999" decimals="2"/></sequence>
<sequence name="Joined"><gen type="date" range="2015-01-01..2025-12-31" format="YYYY-MM-DD"/></sequence>
</env><block><line><data>${{{{Id}}}},${{{{First}}}} ${{{{Last}}}},${{{{Status}}}},${{{{Balance}}}},${{{{Joined}}}},${{{{First|lower}}}}.${{{{Last|lower}}}}@example.com</data></line></block></tdc>"""
UNIQ = """<tdc><env count="{n}" seed="bench" local="en">
<sequence name="Id"><gen type="increment" value="1"/></sequence>
<sequence name="Pair" uniq="true">""" + "".join(f'<gen type="text" name="{f}" value="{v}"/>' for f, v in zip(("City", "Grade", "Slot"), _NAMES, strict=True)) + """</sequence>
</env><block><line><data>${{{{Id}}}},${{{{Pair.City}}}},${{{{Pair.Grade}}}},${{{{Pair.Slot}}}}</data></line></block></tdc>"""


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).select(F.sum("id")).collect()  # the session has started

    def written(df) -> float:
        began = time.time()
        df().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took = {name: written(lambda f=own.QUERIES[name]: f(spark, sf)) for name in HEADLINE}
    folder = tempfile.mkdtemp()
    for name, text in (("customers", CUSTOMERS), ("uniq", UNIQ)):
        for n in (10_000, 200_000, 2_000_000):
            began = time.time()
            Run(spark, text.format(n=n)).write(f"file://{folder}/{name}-{n}.txt", single=True)
            took[f"{name}_{n}"] = round(time.time() - began, 3)
    if importlib.util.find_spec("rowloom.llm"):  # the subpackage may be absent
        from rowloom.llm import queries as llm

        took |= {name: written(lambda f=f: f(spark, sf)) for name, f in llm.QUERIES.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
