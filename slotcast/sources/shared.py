"""Tables in the folder all executors share, to cut lineage before repeated reads."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set with ``SparkContext.setCheckpointDir``.

    Where neither is set, a local folder serves a local master, as in tests, and goes with the
    process. On a cluster that would scatter the tables over machines, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="slotcast-"))
    return _LOCAL[0].name


def new_path(spark: SparkSession, label: str = "table") -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled", paths: list[str] | None = None) -> DataFrame:
    """Compute ``df`` once, write it as parquet and go on from the written table.

    Unlike a cached or locally checkpointed frame it outlives a lost executor, and
    later reads still prune columns. ``paths`` collects the folder for `drop_tables`.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of `settle` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    Spark does so once the driver has collected the frames that made them, which a driver with
    little garbage may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
