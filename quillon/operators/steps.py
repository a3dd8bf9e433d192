"""Analytics over step sequences: repeats, runs, throttles and order-dependent folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def run_length(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds how many rows in a row had the same value so far (gaps and islands; nulls are a value)."""
    w = by(keys, order)
    changed = (~value.eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__i", F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn(name, F.row_number().over(by([*keys, "__i"], order))).drop("__i")


def stuck(df: DataFrame, keys: list[str], order: list[str], sig: str, within: int = 3) -> DataFrame:
    """Adds ``stuck``: the last ``within`` steps have one signature."""
    w = by(keys, order).rowsBetween(1 - within, 0)
    same = (F.min(sig).over(w) == F.max(sig).over(w)) & (F.count(sig).over(w) == within)
    return df.withColumn("stuck", F.coalesce(same, F.lit(False)))


def no_progress(df: DataFrame, keys: list[str], order: list[str], fingerprint: str, least: int = 4) -> DataFrame:
    """Adds ``same_run`` (repeats after the first) and ``no_progress``."""
    out = run_length(df, keys, order, F.col(fingerprint), "same_run").withColumn("same_run", F.col("same_run") - 1)
    return out.withColumn("no_progress", F.col("same_run") >= least)


def streak(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str, keep: Column | None = None) -> DataFrame:
    """Adds how many flagged rows in a row end here; rows of ``keep`` neither count nor break."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    broken = ~flag if keep is None else ~flag & ~keep
    marked = df.withColumn("__i", F.sum(F.when(broken, 1).otherwise(0)).over(w))
    inner = by([*keys, "__i"], order).rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(flag, 1).otherwise(0)).over(inner)
    return marked.withColumn(name, F.when(flag, count).otherwise(0)).drop("__i")


def forgot_to_type(df: DataFrame, keys: list[str], order: list[str], kind: str, target: str) -> DataFrame:
    w = by(keys, order)
    return df.withColumn("forgot", F.coalesce((F.col(kind) == "click") & (F.lag(kind).over(w) == "click") & (F.lag(target).over(w) == F.col(target)), F.lit(False)))


def first_and_rest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("part", F.when(F.row_number().over(by(keys, order)) == 1, "first").otherwise("subsequent"))


def capture_delay(df: DataFrame, keys: list[str], order: list[str], ms: Column, gap: int = 1000) -> DataFrame:
    before = F.lag(ms).over(by(keys, order))
    return df.withColumn("delay_ms", F.coalesce(F.greatest(F.lit(0).cast("long"), gap - (ms - before)), F.lit(0).cast("long")))


def cooldown(times: Column, gap: int) -> Column:
    """Times at which an attempt is made, each at least a gap after the attempt before: from each to the next by bisection."""

    def made(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in arrays:
            out = []
            for held in rows:
                t = np.sort(np.asarray([] if held is None else held, np.int64))
                following = np.searchsorted(t, t + gap)  # of every attempt at once
                at, kept = 0, []
                while at < len(t):
                    kept.append(t[at])
                    at = max(at + 1, following[at]) if gap > 0 else at + 1
                out.append(kept)
            yield pd.Series(out)

    return F.pandas_udf(made, "array<long>")(times)


def fifo_hits(keys: Column, size: int = 6) -> Column:
    """For each key in order whether it is in a cache of the last ``size`` inserted keys; a hit does not refresh."""

    def hits(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in arrays:
            out = []
            for asked in rows:
                held: dict = {}  # in the order of insertion
                found = []
                for k in () if asked is None else asked:
                    found.append(k in held)
                    if k not in held:
                        held[k] = None
                        if len(held) > size:
                            del held[next(iter(held))]
                out.append(found)
            yield pd.Series(out)

    return F.pandas_udf(hits, "array<boolean>")(keys)


def durable_lessons(df: DataFrame, keys: list[str], order: list[str], lesson: str, ok: Column) -> DataFrame:
    """Lessons whose next step succeeds."""
    nxt = F.lead(ok).over(by(keys, order))
    return df.withColumn("__ok", F.coalesce(nxt, F.lit(False))).where(F.col(lesson).isNotNull() & F.col("__ok")).drop("__ok")


def recoveries(df: DataFrame, keys: list[str], order: list[str], flag: Column, most: int = 3) -> DataFrame:
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("recoveries", F.sum(F.when(flag, 1).otherwise(0)).over(w)).withColumn("stop", F.col("recoveries") > most)


def fingerprint(elements: Column, most: int = 80) -> Column:
    one = lambda e: F.concat_ws(":", e["id"].cast("string"), e["tag"], F.coalesce(e["label"], F.lit("")), F.left(F.coalesce(e["text"], F.lit("")), F.lit(12)))
    return F.array_join(F.transform(F.slice(elements, 1, most), one), "|")


def preview(elements: Column, most: int = 20) -> Column:
    one = lambda e: F.concat(F.lit("#"), e["id"].cast("string"), F.lit(" "), F.left(F.coalesce(F.nullif(e["label"], F.lit("")), e["text"], F.lit("")), F.lit(24)))
    return F.array_join(F.transform(F.slice(elements, 1, most), one), "  ")


def decision_trace(steps: DataFrame, elements: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Observed and protected counts and the described target of each step."""
    el = elements.select(*keys, F.col("id").alias("target"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("text")).alias("target_desc"))
    seen = elements.groupBy(*keys).agg(F.count("*").alias("observed"))
    safe = protected.groupBy(*keys).agg(F.count("*").alias("protected"))
    out = steps.join(seen, keys, "left").join(safe, keys, "left").join(el, [*keys, "target"], "left")
    return out.withColumns({"observed": F.coalesce("observed", F.lit(0)), "protected": F.coalesce("protected", F.lit(0))})
