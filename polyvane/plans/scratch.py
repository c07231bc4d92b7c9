"""Shared relations of a plan written once as tables, in the folder of spark.checkpoint.dir where the session has one."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a write. The JVM never compiles a method of more than 8,000 bytes: such a stage's expressions are compiled one by one instead. Rows by piece
#: take about 12 bytes in a shuffle and, with a sort for each of a chain's windows, 1 KB and more in a task: merged by size, as adaptive execution does it,
#: one task would get those of all pieces.
WRITING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true"}
_roots: dict[str, str] = {}
_made: dict[tuple, DataFrame] = {}


def state(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple:
    """What the files of the tables are now: names, lengths and times. A table that is rewritten in place is another input."""
    conf, path, out = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path, []
    for _, f in sorted(tables.items()):
        for name in sorted(f.inputFiles()):
            at = path(name)
            s = at.getFileSystem(conf).getFileStatus(at)
            out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def shared(spark: SparkSession, key: tuple, make) -> DataFrame:
    """The table of a relation over the same inputs in this application; written by its first reader."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Have shared relations computed anew, as benchmarks must."""
    _made.clear()


def root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="polyvane-")
        spark.sparkContext.setCheckpointDir(base)
    return _roots.setdefault(spark.sparkContext.applicationId, f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}")


def write(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            pass

    atexit.register(clean)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete what write wrote, once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if root(spark).rsplit("/", 1)[-1] in folder.split("/"):
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
