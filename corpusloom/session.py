"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "corpusloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` does; once per
    application. Needed wherever the package is not installed on the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few megabytes, unless the session says otherwise. Spark's own
    bound is 10 000 rows or 64 MB, of which a function on texts makes many times as much in each of
    an executor's workers."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may do without: there a
    temporary folder is set. Elsewhere executors would write to their own disks."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return context.getCheckpointDir()


def own_scratch(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder. For the end of a
    run: frames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, under the shared folder. All paths of an application
    lie in one folder of its own, so that they can be dropped together when it has ended."""
    return f"{own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give Python-heavy work at least one task per core.

    For DataFrames straight off a scan: a small table is often a single row group and so a
    single task. A scan that already has enough splits is returned as it is, with no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
