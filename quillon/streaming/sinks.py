"""Sinks of streams that a batch replayed after a failure does not change.

A batch writes a folder of its own id, and overwrites what an earlier attempt left there.  Tables that are merged,
the last lessons of each host and the newest sessions, are written anew by each batch from the newest
version of an earlier batch; readers take the newest version that was finished.  The tables are bounded by what they keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.checkpoint import remove
from quillon.operators.sessions import retain, upsert_lessons
from quillon.sources.io import capture_rows

Sink = Callable[[DataFrame, int], None]


def append_by_batch(path: str, form: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """An append-only log: what ``form`` makes of a batch, once for each batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        form(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def capture_log(path: str, image: str = "screenshot_b64") -> Sink:
    """Requests with the image's length in place of the image."""
    return append_by_batch(path, lambda df: capture_rows(df, image))


def finished(spark: SparkSession, path: str, part: str = "batch_id") -> list[int]:
    """Ids of the batches whose folder was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith(f"{part}=")]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def batches_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a log with the id of their batch."""
    if not finished(spark, path):
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
    return spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())])).parquet(path)


def merged(path: str, merge: Callable[[DataFrame], DataFrame], keep: int = 2) -> Sink:
    """A table that each batch replaces by ``merge`` of its newest earlier version and the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [b for b in finished(spark, path) if b < batch_id]
        rows = batch
        if earlier:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/batch_id={earlier[-1]}").unionByName(batch)
        merge(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        for b in earlier[:-keep]:
            remove(spark, f"{path}/batch_id={b}")

    return write


def newest_version(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    done = finished(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={done[-1]}") if done else spark.createDataFrame([], schema)


def lessons_sink(path: str, host: str = "host", lesson: str = "lesson", order: str = "at", most: int = 8) -> Sink:
    """The last ``most`` lessons of each host; one told again moves to the end."""

    def merge(rows: DataFrame) -> DataFrame:
        last = upsert_lessons(rows.select(host, lesson, order), host, lesson, [order], most)
        return last.select(host, lesson, F.col(f"at.{order}").alias(order))

    return merged(path, merge)


def sessions_sink(path: str, most: int = 25, entries: int = 40) -> Sink:
    """The newest sessions; a session that comes again replaces its earlier state, the later start first."""

    def merge(rows: DataFrame) -> DataFrame:
        own = F.struct(F.size("entries"), *[c for c in rows.columns if c != "id"])
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(F.coalesce(F.size("entries"), F.lit(-1)), F.xxhash64(own))).alias("r"))
        return retain(last.select("id", "r.*"), most, entries)

    return merged(path, merge)
