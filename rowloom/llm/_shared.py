"""Folders that all machines share, and cuts of lineage that survive the loss of an executor."""
from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_kept: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset, and only in local mode, a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rowloom-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and read from the shared folder from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows of df, written as compressed Parquet to the shared folder and read from there."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _kept[id(out)] = (weakref.ref(out, lambda _, i=id(out): _kept.pop(i, None)), path)
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what keep() wrote for these, once nothing will read them again."""
    for df in tables:
        _, path = _kept.pop(id(df))
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Bitmaps of the id filter: 256 of 4 KB, so it takes 1 MB whatever the input.
BITMAPS, BITS_EACH = 256, 32768


def _place(column: str):
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAPS * BITS_EACH))
    return (slot / BITS_EACH).cast("int"), (slot % BITS_EACH).cast("long")


def mark_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """df with a flag: whether the key may be among ids. True for all that are, and few others.

    Bitmaps of fixed size stand for the ids and are broadcast; they are applied in the
    scan's own stage, so texts that nothing asks for need no shuffle. When ids are many
    they let more through and stay right; the caller's join is what decides.
    """
    b, m = free(df, "_b", "_m")
    number, bit = _place(id_col)
    maps = ids.where(F.col(id_col).isNotNull()).select(number.alias(b), bit.alias("_p")).groupBy(b).agg(F.bitmap_construct_agg("_p").alias(m))
    number, bit = _place(key)
    byte = F.conv(F.hex(F.substring(F.col(m), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
    out = df.withColumn(b, number).join(F.broadcast(maps), b, "left")
    return out.select(*df.columns, F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False)).alias(name))


def only_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose key may be among ids."""
    (maybe,) = free(df, "_maybe")
    return mark_ids(df, key, ids, id_col, maybe).where(F.col(maybe)).drop(maybe)
