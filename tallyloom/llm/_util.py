"""Shared folder, written tables and row keys."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tallyloom-")
        shared_dir.own = folder
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tallyloom-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(clean)
    return path


class _Made(threading.local):
    """Folders of tables that this thread has written, in the order they were made."""

    def __init__(self) -> None:
        self.paths: list[str] = []


MADE = _Made()


def settled(df: DataFrame, since: int) -> DataFrame:
    """cut, after which the tables that this thread wrote from place ``since`` on are removed but for the new one: nothing reads them any more."""
    out = cut(df)
    for path in MADE.paths[since:-1]:
        remove(df.sparkSession, path)
    del MADE.paths[since:-1]
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost no recomputation beyond this point."""
    spark = df.sparkSession
    path = new_folder(spark)
    MADE.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Sent to every task at most: so many numbers.
SENT = 500_000


def sent(df: DataFrame, on: DataFrame, keys: list[str], how: str) -> DataFrame:
    """df joined with a table of whole numbers: sent to every task if it is small, else both are dealt out by key."""
    return df.join(F.broadcast(on) if on.limit(SENT + 1).count() <= SENT else on, keys, how)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and text, under fixed names."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def row_key() -> list:
    """What tells rows apart whose id repeats: id and text hash. Equal rows share a key and get equal results."""
    return [F.col("doc_id"), F.xxhash64("text").alias("tk")]
