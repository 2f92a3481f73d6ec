"""Session helpers: a local builder for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_stages: ContextVar[str | None] = ContextVar("stages", default=None)


def ship(spark: SparkSession) -> SparkSession:
    """Make ``voxloom`` importable by the executors' Python workers, once for each application.

    The package's sources travel as a small zip through ``SparkContext.addPyFile``; nothing needs to be
    installed on the executors, and a lost executor's successor fetches the file again from the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="voxloom-py-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "voxloom_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent).as_posix())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for materialised stages: the session's spark.checkpoint.dir, else, for a local master only, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="voxloom-"))
    return sc.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """Where materialised stages go: the innermost ``own_stages``, else the shared folder."""
    return _stages.get() or shared_folder(spark)


@contextlib.contextmanager
def own_stages(spark: SparkSession) -> Iterator[str]:
    """Stages that are materialised inside lie in a folder of their own, which is deleted at the end, after an error too.

    It gives the folder that stages had before. A result is lazy and reads its stages, so it must be written before the end:
    with ``materialised(result, folder)`` or as a table of its own.
    """
    outer = stage_folder(spark)
    inner = f"{outer}/own-{uuid.uuid4().hex}"
    token = _stages.set(inner)
    try:
        yield outer
    finally:
        _stages.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as Parquet in the stages' folder, read back: its lineage is cut, and a lost executor loses none of it."""
    path = f"{folder or stage_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str | int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benches use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("voxloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
