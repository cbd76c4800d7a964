"""Session settings and durable intermediate results."""

from __future__ import annotations

from collections.abc import Iterable
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column costs more than building most plans here.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tallywork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; the caller's ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate results (``spark.checkpoint.dir``).

    A temporary folder is used only on a local master; elsewhere executors could not
    read each other's files, so a missing setting is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="tallywork-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes the row placement."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, for written tables; see ``drop_scratch``."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def still_there(path: str | None) -> bool:
    """Whether a folder of ``new_folder`` has not been dropped."""
    return path in _WRITTEN


def scratch_paths() -> list[str]:
    """The folders of ``new_folder`` that are still there."""
    return list(_WRITTEN)


def drop_scratch(spark: SparkSession, only: Iterable[str] | None = None) -> int:
    """Remove tables written to the shared folder (all, or ``only`` some), once the results that read them are done with."""
    paths, files = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    for name in set(_WRITTEN) if only is None else set(only) & set(_WRITTEN):
        _WRITTEN.remove(name)
        path = paths.Path(name)
        dropped += path.getFileSystem(files).delete(path, True)
    return dropped


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed by the operators that run Python inside tasks; submitting the package with
    ``--py-files`` does the same.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallywork-"), "tallywork")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(context.applicationId)
