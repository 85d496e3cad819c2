"""Session factory with the settings the library is written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession, package: str = "tessera") -> None:
    """Send the package to the workers, once per context, unless they find it anyway.

    Workers that inherit the driver's ``PYTHONPATH`` or working folder import
    it from there; others get a zip through Spark's own file distribution.
    """
    root = Path(__file__).resolve().parents[1]
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in inherited or Path.cwd() == root or getattr(context, "_tessera_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="tessera-"))
    path = folder / f"{package}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((root / package).rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(path))
    context._tessera_shipped = True


def ensure_shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()
