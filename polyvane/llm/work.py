"""Shared scratch tables: the only way these operators cut lineage.

Tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and executors on a cluster).
Where it is unset, as in local tests, a private temporary folder is used and set as checkpoint dir.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: one without a scheme is in Hadoop's default file system, which need not be the local one."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path).makeQualified(jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf), jvm.org.apache.hadoop.fs.Path("/")).toString()
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def arrow_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified URI, on executors: local, HDFS, S3, GCS, whatever Arrow opens."""
    if ":" not in path:
        raise ValueError(f"not a URI: {path}")
    return pyarrow.fs.FileSystem.from_uri(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as a URI. Where the session has none, a local folder of our own in local mode; an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="polyvane-")
        spark.sparkContext.setCheckpointDir(path)
    return qualified(spark, path).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_open: list[Work] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, the folders of all operators called in it: their results must have been written elsewhere by then."""
    before = len(_open)
    try:
        yield
    finally:
        while len(_open) > before:
            _open[-1].close()


class Work:
    """A run's own folder under the shared one; holds Parquet tables by name. It goes with its ``scope``, or with the interpreter."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back with the same schema: lost executors then cost no recomputation."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Tables that no result will read again."""
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
        with contextlib.suppress(Exception):  # the session may have ended; nothing is left to clean with
            delete(self.spark, self.path)


@atexit.register
def _close_all() -> None:
    while _open:
        _open[-1].close()


def components(work: Work, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)`` as (node, component = smallest id): alternating large-star
    and small-star rounds, each written as a table. Nothing is collected; a hub's edges are only joined
    with its one minimum, a join that AQE splits. Rows with a null end and loops are ignored.
    """
    from pyspark.sql import functions as F

    now = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, k = work.table(now, f"{name}0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        now = work.table(small, f"{name}{k}")
        work.drop(f"{name}{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
