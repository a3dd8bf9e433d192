"""Tables as streams: rows fed in order, a part of them each micro-batch, with as many files as tasks wrote.

Everything lies in a folder of its own under the shared checkpoint folder and goes when the result has been kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.checkpoint import durable, remove, shared_folder
from quillon.streaming.sinks import Sink, append_by_batch, batches_of, newest_version

STORE = "spark.sql.streaming.stateStore.providerClass"
#: Keyed processors ask for this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder, if it is there, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(source)):
        files.rename(path(source), path(target))


def staged(df: DataFrame, order: str, cuts: list[float], top: str) -> DataFrame:
    """Writes the rows by parts in one job; the stream sees a part once its folder is moved in."""
    spark = df.sparkSession
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(order) > cut).cast("int")
    df.withColumn("__part", F.coalesce(part, F.lit(0))).write.partitionBy("__part").parquet(f"{top}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/in")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{top}/in")


def fed(sources: list[tuple[DataFrame, str]], step: Callable[..., DataFrame], sink: Sink, mode: str, parts: int, top: str) -> DataFrame:
    """Runs what ``step`` makes of the streams of the tables into the sink, part after part; the stream that ran."""
    spark = sources[0][0].sparkSession
    first, order = sources[0]
    cuts = sorted(set(first.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    out = step(*[staged(df, by, cuts, f"{top}/{k}") for k, (df, by) in enumerate(sources)])
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)
    try:
        query = out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{top}/state").start()
        try:
            for part in range(len(cuts) + 1):
                for k in range(len(sources)):
                    moved(spark, f"{top}/{k}/staged/__part={part}", f"{top}/{k}/in/{part}")
                query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.set(STORE, before)
    return out


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"


def run(sources: list[tuple[DataFrame, str]], step: Callable[..., DataFrame], mode: str = "append", parts: int = 3) -> DataFrame:
    """What ``step`` makes of the streams of the tables, whose order columns rise from batch to batch; parts are cut
    by the first one's.  In update mode the last row of each key, the first column, counts."""
    spark = sources[0][0].sparkSession
    top = folder(spark)
    out = fed(sources, step, append_by_batch(f"{top}/out"), mode, parts, top)
    rows = batches_of(spark, f"{top}/out", out.schema)
    if mode == "update":
        key, rest = out.columns[0], out.columns[1:]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(key, "r.*")
    else:
        rows = rows.drop("batch_id")
    kept = durable(rows)
    remove(spark, top)
    return kept


def merged_table(df: DataFrame, order: str, sink: Callable[[str], Sink], parts: int = 3) -> DataFrame:
    """The table that a merging sink has after the rows have gone through it as a stream."""
    spark = df.sparkSession
    top = folder(spark)
    fed([(df, order)], lambda stream: stream, sink(f"{top}/out"), "append", parts, top)
    kept = durable(newest_version(spark, f"{top}/out", df.schema))
    remove(spark, top)
    return kept
