"""What a Spark session needs before it runs this package's functions on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once a Spark context (Spark's own file server deals it out)."""
    sc = spark.sparkContext
    if getattr(sc, "_kinfold_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="kinfold-")  # the file server reads from here as long as the driver lives
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(here, f"{tmp}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", f"{tmp}/src"))
    sc._kinfold_shipped = True
    return spark
