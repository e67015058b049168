"""Following a folder of tournament files: an extension, the batch build stays the reference.

New files are picked up by a file stream; each batch keeps events whose address is not yet
in the table, for all time and not only within a watermark, and appends them. A batch that
is run again after a failure finds its events present and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import event_type
from ..sources.tournaments import SCHEMA, first_per

EVENTS = "uri string, date date, name string, event_type string, players int, path string, source string"


def _events(files: DataFrame, fmt: str) -> DataFrame:
    kept = files.filter("_corrupt_record is null").filter(F.lower(F.coalesce("Tournament.Formats", F.lit(""))) == fmt.lower())
    source = F.regexp_extract("path", "/Tournaments/([^/]+)/", 1)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = kept.select(
        F.coalesce(F.nullif(F.col("Tournament.Uri"), F.lit("")), "path").alias("uri"), F.try_to_date(F.substring("Tournament.Date", 1, 10), "yyyy-MM-dd").alias("date"), F.col("Tournament.Name").alias("name"),
        event_type(source, F.col("Tournament.Name")).alias("event_type"), F.when(size("Standings") > 0, size("Standings")).otherwise(size("Decks")).alias("players"), "path", source.alias("source"),
    )
    return first_per(rows, "uri", F.split("path", "/"))


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, fmt: str):
    """Append the events of files that are new since the last call; returns the finished query."""
    stream = (
        spark.readStream.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/Tournaments").withColumn("path", F.col("_metadata.file_path"))
    )

    def append(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema(EVENTS).parquet(out) if _exists(batch.sparkSession, out) else None
        fresh = _events(batch, fmt)
        if known is not None:
            fresh = fresh.join(known.select("uri"), "uri", "left_anti")
        fresh.select("uri", "date", "name", "event_type", "players", "path", "source").write.mode("append").partitionBy("source").parquet(out)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
