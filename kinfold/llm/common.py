"""Helpers shared by the training-data operators: table reading and Arrow row mapping."""

from __future__ import annotations

import ctypes
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import storage
from kinfold.session import ship
from kinfold.storage import removed, written  # noqa: F401

#: Rows in one Arrow batch. Texts run to 100 KB and more, so Spark's 10,000 would be hundreds of MB a batch.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any store that Spark can open)."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body): the id as long and the UTF-8 bytes of the text (null text: empty). All other columns go."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def map_rows(df: DataFrame, make, schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """Map batches of Python rows through ``make()``, a factory that is called once a task.

    ``make()`` returns a function from the batch's columns (lists) to the result's columns (lists).
    """

    def run(batches):
        fn = make()
        for b in batches:
            cols = fn(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow_schema, strict=True)], schema=arrow_schema)
            del b, cols
        del fn
        tidy()

    return df.mapInArrow(run, schema)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` by sorting, so no side goes through the driver.

    Spark's guess of a size misses what explode and decompression add, tens of times over, and a broadcast
    stays in the driver until its plan is collected.
    """
    return left.join(right.hint("merge"), on, how)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark drop the shuffle files and broadcasts of finished plans, and the classes made for them."""
    spark._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """A folder for an operator's tables, with what the operators before have left let go."""
    forget(spark)
    return storage.shared_dir(spark)


def tidy() -> None:
    """Give freed memory back to the system at the end of a task: workers stay alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


class WordHashes(dict):
    """64-bit hashes of words, of which a worker keeps ``most`` in memory."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
