"""Session settings and the shared folder for tables written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. Partition counts are left to the
# cluster: AQE coalesces small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# For results that are written and not computed again: shuffle files go with the execution that made them, and not
# when the driver happens to collect its garbage.
SHUFFLES_FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_roots: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session somebody else built."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """``wanted`` for a while; a stream keeps the settings of its start."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def build_session(app: str = "basketlens", master: str | None = None, **conf) -> SparkSession:
    """A session with ``SETTINGS``; leave ``master`` to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster the
    executors would not see it.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="basketlens-")
        _roots[app] = f"{base.rstrip('/')}/basketlens/{app}"
    return _roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whichever file system it names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The existing paths that a path or glob pattern names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return [] if found is None else [str(f.getPath()) for f in found]


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; ``target`` may be an empty folder and must not be anything else."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        fs.delete(path(target), False)
    if not fs.rename(path(source), path(target)):
        raise RuntimeError(f"{source} could not be moved to {target}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    For jobs that read the same rows several times or need them to stay put: the
    copy survives lost executors, cuts the lineage, and later passes over it read
    only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's folder; call when its results are no longer read."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        delete_path(spark, root)
