"""What a Spark session needs to run this package on other machines."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's URI under the one that all machines share; local sessions without one get their own."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        told = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(told)
    return f"{told.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Gives the package's code to the executors, once for each application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # it runs from an archive, which was given already
        return
    folder = tempfile.mkdtemp(prefix="siltstone-code-")  # on the driver alone; Spark hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / "siltstone-code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(at))
