"""Where lineage is cut: the shared checkpoint folder of the cluster."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The size that Spark takes a table of unknown size to have.
UNKNOWN = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a local one only where none is named and all runs on one machine, as in tests."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "quillon-checkpoints")


def swept(spark: SparkSession) -> None:
    """Lets go of shuffle files that no plan needs any more, which Spark deletes only when the driver collects its
    garbage; worth its time between steps that shuffle a whole corpus."""
    gc.collect()
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    # the files go when the last plan that reads them is gone
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return estimated(df.checkpoint(eager=True))


def estimated(kept: DataFrame) -> DataFrame:
    """Forgets an estimate of the size that no table can have.

    A checkpoint keeps its plan's estimate, which is the product of those of the joined sides.  In a loop its digits would
    double from round to round, to millions of them, which fill the driver and take it minutes to multiply.
    """
    plan, jvm = kept._jdf.logicalPlan(), kept.sparkSession._jvm
    if plan.stats().sizeInBytes() <= UNKNOWN:
        return kept
    known = [plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream()]
    plan = plan.copy(*known, kept._jdf.sparkSession(), jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(kept._jdf.sparkSession(), plan), kept.sparkSession)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
