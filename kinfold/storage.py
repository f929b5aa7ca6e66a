"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    """The file system of a path, and the path, in Hadoop's terms (any store that Spark can open)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which goes when the application ends.

    Without that setting a local session takes a folder of its warehouse; on a cluster that is an error, as
    no folder is known there that all executors can open.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    folder = f"{top.rstrip('/')}/kinfold-{uuid.uuid4().hex}"
    fs, p = path_of(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # a result that is read lazily may need its tables until then
    return folder


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = path_of(spark, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def listed(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    fs, p = path_of(spark, folder)
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().endswith(suffix)) if fs.exists(p) else []


def merged(spark: SparkSession, folder: str, path: str, header: str) -> None:
    """The text parts of a folder, in order, as one file behind a header line. Bytes run through the driver; nothing is held."""
    fs, p = path_of(spark, path)
    out = fs.create(p, True)
    out.write(f"{header}\n".encode())
    for part in listed(spark, folder):
        if "/part-" in part:
            source, q = path_of(spark, part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source.open(q), out, 1 << 20, False)
    out.close()
    removed(spark, folder)
