"""Shipping this package to the Python workers of a cluster."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; with a local master, where it is unset, one of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="vecmill-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        folder = "file://" + _LOCAL[0]
    return folder.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the application ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def delete_now(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_vecmill_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="vecmill-")) / "vecmill.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    context._vecmill_shipped = True


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
