"""Places and files that the driver and every executor share.

Everything that outlives a task goes to the folder named in ``spark.checkpoint.dir``, so a
lost executor loses nothing (``lineage.shared_root``). Tables that a lazy result still reads
stay there until the folder itself is cleared.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_root, workspace  # noqa: F401


def pick(docs: DataFrame, *names: str, key: str = "doc_id") -> DataFrame:
    """The named columns of the rows that have a key, as long where they are the key.

    Other columns are dropped by place, so one that differs from a name in case alone, or
    repeats it, does no harm (the first column of exactly that name counts).
    """
    cols = docs.columns
    place = {n: cols.index(n) for n in names}
    plain = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    return plain.select(*(F.col(f"c{place[n]}").cast("long").alias(n) if n == key else F.col(f"c{place[n]}").alias(n) for n in names)).filter(F.col(key).isNotNull())


def unclashed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with one column of each name, case apart: the exact ``names`` where there are
    such, else the first; the others are dropped by place."""
    cols = docs.columns
    best: dict[str, int] = {}
    for i, c in enumerate(cols):
        at = best.setdefault(c.lower(), i)
        if c in names and cols[at] not in names:
            best[c.lower()] = i
    if len(best) == len(cols):
        return docs
    plain = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    return plain.select(*(F.col(f"c{i}").alias(cols[i]) for i in sorted(best.values())))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The plan that has just run is held by objects which a first collection only queues, so a
    second one follows.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def materialise(df: DataFrame, base: str, name: str, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the workspace and read it back: cuts lineage, survives lost executors.

    After a ``heavy`` one, whose shuffle holds a good part of the input, its shuffle files go.
    """
    spark = df.sparkSession
    path = f"{base}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    if heavy:
        release(spark)
    return spark.read.parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a URI, on the driver or on an executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class TaskFile:
    """A file that a task writes under the workspace: complete under its final name or absent.

    The name is new for every attempt, so a retried task never touches another attempt's file,
    and only files named in the rows of successful tasks are ever read.
    """

    def __init__(self, base: str, suffix: str):
        self.uri = f"{base}/{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = filesystem(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.offset = 0

    def write(self, data: bytes) -> int:
        """Append; returns where the data begins."""
        at = self.offset
        self.out.write(data)
        self.offset += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri
