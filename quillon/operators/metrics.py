"""Evaluation: percentiles, waterfalls, precision and recall, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.checkpoint import durable


def nearest_index(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p n))] of an array; 0 if it is empty."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(v)
    at = F.least(n - 1, F.floor(n * F.lit(p))).cast("int")
    return F.when(n == 0, 0.0).otherwise(F.try_element_at(v, at + 1))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum over a whole table: rows are dealt over ranges, summed in each, and each range's sum is carried on."""
    dealt = durable(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = dealt.groupBy("__p").agg(F.sum(value).alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s")
    within = F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(sums, "__p").withColumn(name, F.col("__before") + within).drop("__p", "__before")


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Nearest-index percentiles by counts of distinct values, never an array of all rows.

    Equal values are combined before the shuffle; a running count finds the value at each index.
    """
    n = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        run = n.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    else:
        run = running_total(n, "v", "c", "upto")
        run = run.crossJoin(F.broadcast(n.agg(F.sum("c").alias("n"))))  # one row
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    picks = [F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in points]
    return run.groupBy(*keys).agg(*picks, F.min("v").alias("min"), F.max("v").alias("max"), F.max("n").alias("n"))


def waterfall(df: DataFrame, keys: list[str], phases: list[str], missing_zero: bool = False) -> DataFrame:
    """Per phase mean, p50, p95, min and max of a wide table of durations."""
    pairs = ", ".join(f"'{p}', cast({p} as double)" for p in phases)
    long = df.selectExpr(*keys, f"stack({len(phases)}, {pairs}) as (phase, ms)")
    if missing_zero:
        long = long.fillna(0.0, ["ms"])
    mean = long.groupBy(*keys, "phase").agg(F.avg("ms").alias("mean"))
    return mean.join(ranked_percentiles(long, [*keys, "phase"], "ms", (0.5, 0.95)), [*keys, "phase"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(df: DataFrame, pred: str, gt: str, inter: str) -> DataFrame:
    p, r = ratio(F.col(inter), F.col(pred)), ratio(F.col(inter), F.col(gt))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def recall_percent(rows: DataFrame, keys: list[str], hit: str = "hit") -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("found"))
    return out.withColumn("recall_pct", F.round((F.col("found") * 100).cast("decimal(20,6)") / F.col("n"), 1).cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def megabytes(files: DataFrame, prefix: str, name: str = "file", size: str = "bytes", keys: list[str] | None = None) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col(name).startswith(prefix), F.col(size))), F.lit(0))
    return files.groupBy(*(keys or [])).agg(total.alias("bytes"), F.round((total / 1048576).cast("decimal(20,6)"), 2).cast("double").alias("mib"))


#: Weights of the five criteria.
WEIGHTS = (0.25, 0.20, 0.20, 0.20, 0.15)


def scorecard(criteria: list[Column]) -> Column:
    return sum((c * w for c, w in zip(criteria, WEIGHTS, strict=True)), F.lit(0.0))


def accuracy(pairs: DataFrame, keys: list[str], expected: str, got: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col(expected) == F.col(got), 1.0).otherwise(0.0)).alias("accuracy"))
