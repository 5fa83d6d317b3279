"""Session and table helpers shared by every module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palaver")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Only where the setting is absent and the master is local (tests) a folder of this machine is taken; on a cluster it must be set. What was written is deleted when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "_own", None) or "file://" + tempfile.mkdtemp(prefix="palaver-")
        shared_dir._own = base
    to = f"{base.rstrip('/')}/palaver-{uuid.uuid4().hex}"
    _MADE.append(to)
    return to


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> bool:
    """Sends the package to the executors' Python, unless they find it by themselves (through PYTHONPATH, or because the driver runs in its folder)."""
    root = Path(__file__).resolve().parents[1]
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return False
    _SHIPPED.add(app)
    own = tempfile.mkdtemp(prefix="palaver-code-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{own}/palaver", "zip", root, "palaver"))  # the driver hands it out as long as it lives
    return True


_MADE: list[str] = []


def _clean_at_exit() -> None:
    """Deletes what is left once the process ends; where the JVM is gone already, only folders of this machine."""
    while _MADE:
        to = _MADE.pop()
        if to.startswith(("file:", "/")):
            shutil.rmtree(to.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            continue
        try:
            jvm = SparkSession.getActiveSession()._jvm
            p = jvm.org.apache.hadoop.fs.Path(to)
            p.getFileSystem(SparkSession.getActiveSession().sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001
            return


atexit.register(_clean_at_exit)


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote below the shared folder, once nothing reads them any more; gives their number."""
    n = 0
    while _MADE:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a written table in the shared folder: it survives lost executors, unlike a cache."""
    spark = df.sparkSession
    to = shared_dir(spark)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
