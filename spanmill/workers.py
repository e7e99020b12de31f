"""What a job needs beyond one machine: the package on the workers, and a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it, once a context.

    On a local master workers inherit the working folder and PYTHONPATH; where these lead to the package, nothing is
    sent. On any other master it always is: the driver's folders say nothing about an executor's.
    """
    home = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if context.master.startswith("local") else []
    if any(p and Path(p).resolve() == home for p in known) or getattr(context, "_spanmill_shipped", False):
        return
    at = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{at}/spanmill", "zip", home, "spanmill"))
    context._spanmill_shipped = True


#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints/spanmill"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else a local one on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED_DIR


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there, which goes when the JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at
