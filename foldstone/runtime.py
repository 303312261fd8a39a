"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foldstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names in
    ``spark.checkpoint.dir``; only where that is unset, and on one machine (tests, a
    laptop), a temporary one, which goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(sc, "_foldstone_folder", None) is None:
        sc._foldstone_folder = tempfile.mkdtemp(prefix="foldstone-")
        atexit.register(shutil.rmtree, sc._foldstone_folder, ignore_errors=True)
    return sc._foldstone_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that are written and read again; it is
    deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/foldstone/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if getattr(sc, "_foldstone_scratch", None) is None:
        sc._foldstone_scratch = []
        atexit.register(_sweep, sc)
    sc._foldstone_scratch.append(path)
    return path


def _sweep(sc) -> None:
    """Delete the scratch folders of a context that still runs, through its file system."""
    try:
        for path in sc._foldstone_scratch:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the context is gone; the folder's owner sweeps it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors of a cluster, once per application.

    Functions that run in Python workers are found there by name; a cluster whose
    workers don't have the package on their path gets it from the driver.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_foldstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foldstone-")  # the driver serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/foldstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._foldstone_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer tasks than there are cores, over all cores.

    For costly functions on small tables; larger scans have tasks enough and are left
    as they are, so what moves is bounded by the cores. Only for plain scans, since
    the number of tasks is asked of the plan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
