"""Sessions, receipts, retention and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.steps import by


def newest(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The last rows of each key; the filter becomes a window group limit."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def last_of(items: Column, k: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - k + 1), k)


def marked_sessions(df: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Adds ``session``: how many start rows there were so far; rows before the first belong to session 0."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(F.when(start, 1).otherwise(0)).over(w))


def session_states(df: DataFrame, keys: list[str], order: list[str], start: Column, terminal: Column, status: Column) -> DataFrame:
    """One row per session with its last terminal status, else running."""
    at = F.struct(*order)
    s = marked_sessions(df, keys, order, start).where("session > 0")
    return s.groupBy(*keys, "session").agg(F.count("*").alias("n_entries"), F.coalesce(F.max_by(status, F.when(terminal, at)), F.lit("running")).alias("status"))


def tail_distinct(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Of neighbours that agree in ``same`` only the last stays."""
    nxt = F.lit(True)
    for c in same:
        nxt = nxt & F.col(c).eqNullSafe(F.lead(c).over(by(keys, order)))
    is_last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])) == 1
    return df.withColumn("__same", nxt & ~is_last).where("not __same").drop("__same")


def upsert_lessons(lessons: DataFrame, host: str, text: str, order: list[str], most: int = 8) -> DataFrame:
    """Latest row of each (host, text), then the last ``most`` of each host."""
    last = lessons.groupBy(host, text).agg(F.max(F.struct(*order)).alias("at"))
    return newest(last, [host], [F.col("at").desc(), F.col(text)], most)


def retain(sessions: DataFrame, most: int = 25, entries: int = 40) -> DataFrame:
    """Newest sessions with their last entries; frames only on the newest."""
    rank = F.row_number().over(Window.orderBy(F.col("started").desc(), "id"))
    top = sessions.orderBy(F.col("started").desc(), "id").limit(most).withColumn("__r", rank)
    return top.withColumns({"entries": last_of(F.col("entries"), entries), "frames": F.when(F.col("__r") == 1, F.col("frames"))}).drop("__r")


def receipt(redactions: DataFrame, verdicts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Totals by type, tokens in first-seen order and the final verdict of each run."""
    total = redactions.groupBy(*keys).agg(F.count("*").alias("protected"))
    by_type = redactions.groupBy(*keys, "type").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))), ",").alias("by_type"))
    first = redactions.where("token is not null").groupBy(*keys, "token").agg(F.min(order).alias("at"))
    tokens = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), ",").alias("tokens"))
    bad = verdicts.groupBy(*keys).agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").when(F.min((F.col("verdict") == "pass").cast("int")) == 1, "pass").otherwise("skip").alias("verdict"))
    out = total.join(by_type, keys).join(tokens, keys, "left").join(bad, keys, "left")
    return out
