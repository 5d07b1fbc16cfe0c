"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the contracts: blank, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names close to the wanted ones that no column in `taken` bears (case is ignored)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from a hash of the parts, in steps of 2**-53."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


#: The folder of the scratch block that is open, if any.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    if open_ := _scratch.get():
        return open_
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sedge-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; one that is not there is no fault."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside the block go to one folder of the shared folder, which is deleted at its end.

    Whatever reads them must have been written before: a frame that leaves the block unread cannot be read any more.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor never recomputes what led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
