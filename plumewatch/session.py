"""Session helpers: scratch tables, stream checkpoints, code for the workers."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_shipped: set[str] = set()


def build_session(cpus: str | int = "*", app: str = "plumewatch", **conf: str) -> SparkSession:
    """Session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers refer to it by name, and only the driver is sure to have it on its
    path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="spark-"), "plumewatch"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a session that sets none and runs in one
    process, as tests may, falls back to a temporary folder of this machine.
    """
    global _local_root
    configured = (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that no plan reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def build_or_read(build: Callable[[], DataFrame], spark: SparkSession, label: str, key: str,
                  ) -> DataFrame:
    """The stored table of a key: read if it has been published, else built and published.

    `key` must name everything the table depends on. A table is written whole to a folder of its own; then a small
    file under the key's name, put in place by one rename, tells where it is. A folder left half-written is never
    read, since nothing points to it. Of two builders at a time one publishes, and both read complete tables.
    """
    target = f"{scratch_root(spark)}/{label}-{hashlib.md5(key.encode()).hexdigest()}.at"
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    final = jvm(target)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(final):
        made = scratch_path(spark, label)
        build().write.parquet(made)
        note = jvm(f"{made}.at")
        out = files.create(note, True)
        out.write(made.encode())
        out.close()
        if files.exists(final) or not files.rename(note, final):
            files.delete(note, False)  # another builder was first
    return spark.read.parquet(spark.read.text(target, wholetext=True).first()[0])


def table_state(spark: SparkSession, path: str) -> str:
    """Path, bytes and number of files of a table, for keys of what is built from it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = files.getContentSummary(target)
    changed = files.getFileStatus(target).getModificationTime()
    return f"{path}:{held.getLength()}:{held.getFileCount()}:{changed}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write once, read many: the stored table outlives any executor."""
    spark = df.sparkSession
    target = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
