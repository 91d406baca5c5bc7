"""Versioned model folders: parts first, the manifest last.

``root/1``, ``root/2``, ... A version counts once its manifest is there, so a driver lost while saving leaves nothing
that a reader would take for a model, and readers of earlier versions are not disturbed.
"""

import json

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest"


def _names(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions, ascending."""
    found = sorted(int(n) for n in _names(spark, root) if n.isdigit())
    return [v for v in found if "_SUCCESS" in _names(spark, f"{root}/{v}/{MANIFEST}")]


def save_version(model, root: str, spark: SparkSession, scores: DataFrame | None = None) -> int:
    """Save ``model`` as a new version with its settings, and with ``scores`` (rows of its evaluation), in the manifest."""
    taken = [int(n) for n in _names(spark, root) if n.isdigit()]
    version = max(taken, default=0) + 1
    path = f"{root}/{version}"
    model.save(path, spark)
    rows = [] if scores is None else [json.loads(r) for r in scores.toJSON().collect()]
    content = {"model": type(model).__name__, "version": version, "settings": model.settings(), "tuned": model.tuned(), "scores": rows}
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")
    return version


def read_manifest(root: str, spark: SparkSession, version: int | None = None) -> dict:
    """The manifest of a version, by default of the newest one."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no finished version {version or ''} in {root}")
    return json.loads(spark.read.text(f"{root}/{version or known[-1]}/{MANIFEST}", wholetext=True).first()["value"])


def load_version(kind, root: str, spark: SparkSession, version: int | None = None):
    """A model of class ``kind``; ``TypeError`` where the version holds another one."""
    found = read_manifest(root, spark, version)
    if found["model"] != kind.__name__:
        raise TypeError(f"{root}/{found['version']} holds a {found['model']}, not a {kind.__name__}")
    return kind.load(f"{root}/{found['version']}", spark)
