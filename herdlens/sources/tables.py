"""Base table access and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` right away keeps ``ReadSchema`` narrow."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder (``spark.checkpoint.dir``).

    Read from the session. Where it is unset, a single-machine session
    (``local`` master: tests, bench) gets a folder of its own; any other
    master is refused, as executors elsewhere could not see such a folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="herdlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current.rstrip("/")


_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique path under the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/herdlens/{purpose}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(path: str, spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_scratch() -> None:
    """Delete this program's scratch folders; what a stopped session left stays for the cluster's cleaner."""
    while _scratch:
        try:
            _delete(*_scratch.popitem())
        except Exception:  # the JVM may be gone already
            return


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, as Spark's own Python file."""
    sc = spark.sparkContext
    if any(os.path.basename(f) == "herdlens.zip" for f in sc._python_includes):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="herdlens-ship-"), "herdlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("herdlens", os.path.relpath(full, package)))
    sc.addPyFile(path)


@contextmanager
def passing_scratch() -> Iterator[None]:
    """Delete, on leaving, the scratch folders made inside: around steps whose result is written to a path from outside.

    On an error they stay until the program ends.
    """
    held = set(_scratch)
    yield
    for path in set(_scratch) - held:
        _delete(path, _scratch.pop(path))


def stored(df: DataFrame, purpose: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here.

    Row groups of ``group_bytes`` let a small table be read by several tasks.
    """
    path = scratch_path(df.sparkSession, purpose)
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], purpose: str, position: str = "position") -> DataFrame:
    """Add a gapless long position (from 0) by a total order, without a single-task sort.

    Rows are range-partitioned, sorted and stored with their place; the rows
    before each partition come from one count per partition.
    """
    t = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_mid", F.monotonically_increasing_id()), purpose)
    t = t.withColumn("_part", F.shiftright("_mid", 33))
    counts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as there are partitions, which bounds the window and the broadcast.
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (t.join(F.broadcast(before), "_part")
            .withColumn(position, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_before", "_mid"))
