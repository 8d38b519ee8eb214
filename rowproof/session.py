"""Session and shared-folder helpers used by the queries, tests and command line."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def _given() -> SparkConf:
    """The settings that Spark was started with: by spark-submit, PYSPARK_SUBMIT_ARGS or a folder of settings."""
    if any(os.environ.get(k) for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")):
        SparkContext._ensure_initialized()  # the JVM has them as its properties
    return SparkConf()


def get_session(app: str = "rowproof", cores: str | int = "*", **conf: str) -> SparkSession:
    """The session. Settings that Spark was started with win over `conf`, and both over our defaults; most of these, and the local master of `cores` cores, hold only where no master is given."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if "SPARK_REMOTE" in os.environ:
        given = SparkConf(loadDefaults=False)
    else:
        given = _given()
        master = given.get("spark.master", os.environ.get("MASTER"))
        defaults |= {"spark.master": master or f"local[{cores}]"}
        if not master:
            defaults |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    for key, value in {**defaults, **conf}.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if "SPARK_REMOTE" not in os.environ:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, with a local master only, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables that executors share need a folder that all of them reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-rowproof-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables saved within are removed at the end: for jobs that have written or collected their results by then."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        removed(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_scratch[-1] if _scratch else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer the true size of the table,
    so that it broadcasts the table only below spark.sql.autoBroadcastJoinThreshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application; needed for Python functions only."""
    context = spark.sparkContext
    if any(str(f).endswith("rowproof.zip") for f in context._python_includes):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-rowproof-")) / "rowproof.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer parts, for work that costs far more than a shuffle of its rows.

    Large inputs have more parts than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
