"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the mean number of times that its documents are taken.  The whole
part is taken for certain; the fraction is an inclusion probability.  The cube method moves the
vector of probabilities inside the null space of two balancing constraints (number of documents,
number of words) until nearly all are 0 or 1:

* flight: blocks of at most BLOCK documents of one source move independently, each leaving at most
  two undecided; what is left meets in blocks again, until every source fits one block.  A hot source
  is many blocks, and no group ever holds more than about BLOCK rows.
* landing: the last two or fewer of a source, with RESERVE documents of it that were kept out of the
  flight (those with the least hashes), are decided together for the least error in words.

Directions are drawn from a hash of the document, hence reruns agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.store import durable

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 512
RESERVE = 11
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
TINY = 1e-9
UNITS = "doc_id long, size long, source string, ratio double, p double, tag long"


def word_count(text: str = "text"):
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total_share: float = 1.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``total_share`` of all
    words; a target stops at three times its source's size and the excess goes to the others by
    weight.  The level of words per unit of weight is found by Newton steps on a piecewise linear
    function, each one aggregate; it stops after as many steps as levels change, a handful.
    """
    # positions: sources are range-partitioned and counted for each partition, so no task sees them all
    ranked = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = durable(ranked.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id() - F.col("part").cast("long") * (1 << 33)))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("before") + F.col("seq"), F.lit(len(weights))) + 1).cast("int"))
    weighed = durable(ranked.join(before, "part").select("source", "source_size", pick.alias("weight")))
    cap = F.col("source_size") * F.lit(float(MOST_TIMES))
    total = float((weighed.agg(F.sum("source_size")).first()[0] or 0) * total_share)
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        held, free = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        nxt = (total - (held or 0.0)) / free if free else level
        if not free or nxt <= level * (1 + 1e-12):
            break
        level = nxt
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def fly(size: list[float], p: list[float], tag: list[int]) -> list[float]:
    """The cube's flight over one block; afterwards at most two values are strictly between 0 and 1."""
    open_: list[int] = []
    for i in range(len(p)):
        if TINY < p[i] < 1 - TINY:
            open_.append(i)
        while len(open_) >= 3:
            a, b, c = open_
            # a vector that changes neither the number of documents nor the words
            u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = down = math.inf
            for j, d in zip(open_, u, strict=True):
                if d:
                    to_one, to_zero = (1 - p[j]) / abs(d), p[j] / abs(d)
                    up, down = (min(up, to_one), min(down, to_zero)) if d > 0 else (min(up, to_zero), min(down, to_one))
            draw = int.from_bytes(hashlib.blake2b(f"{tag[a]},{tag[b]},{tag[c]}".encode(), digest_size=6).digest(), "big") / 2**48
            step = up if draw * (up + down) < down else -down
            for j, d in zip(open_, u, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * d))
            left = [j for j in open_ if TINY < p[j] < 1 - TINY]
            if len(left) == 3:  # rounding kept all three off the boundary
                near = min(left, key=lambda j: min(p[j], 1 - p[j]))
                p[near] = float(round(p[near]))
                left.remove(near)
            open_ = left
    return [float(round(x)) if x < TINY or x > 1 - TINY else x for x in p]


def flight(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["size", "doc_id", "tag"], ascending=[False, True, True], kind="stable")
    block["p"] = fly(block["size"].astype(float).tolist(), block["p"].tolist(), block["tag"].tolist())
    return block[["doc_id", "size", "source", "ratio", "p", "tag"]]


def landing(block: pd.DataFrame) -> pd.DataFrame:
    """Decides the last documents of a source together: the least error in words, and then in documents."""
    block = block.sort_values(["size", "doc_id", "tag"], ascending=[False, True, True], kind="stable")
    size, p = block["size"].to_numpy(dtype=float), block["p"].to_numpy(dtype=float)
    choice = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    words, count = np.abs(choice @ size - size @ p), np.abs(choice.sum(axis=1) - p.sum())
    # a document too many or too few weighs as much as two hundredths of a mean document's words
    block["p"] = choice[np.argmin(words / max(1.0, size.mean()) + 0.02 * count)].astype(float)
    return block[["doc_id", "size", "source", "ratio", "p", "tag"]]


def row_hash(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string"))


def nth_tag(n: Column) -> Column:
    """The tag of the n-th of several rows with one id, text and source."""
    return F.when(n == 1, F.col("tag")).otherwise(F.xxhash64("tag", n))


def numbered(rows: DataFrame) -> DataFrame:
    """Gives rows that share (doc_id, tag) tags of their own, as mix does, wherever they lie.

    Rows are counted for each partition of the input, which must be a stored table, so that no task sees
    all repeats of a row.
    """
    rows = rows.withColumn("__part", F.spark_partition_id())
    count = rows.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("__part").alias("__in")).agg(F.count("*").alias("__n"))
    before = count.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__id", "__tag").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = rows.join(before, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")) & (F.col("__part") == F.col("__in")))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("doc_id", "tag", "__part").orderBy("__before"))
    return joined.withColumn("tag", nth_tag(nth)).drop("__part", "__id", "__tag", "__in", "__n", "__before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, a whole number of copies), copies.

    One row for each row of ``docs``; rows that share an id are separate documents.  Null text counts
    as empty and is taken zero times, null source is a source of its own.  Very long texts only count their
    words.  Repeats of a row are told apart by number; the numbers of one row's repeats are an array in one task, eight
    bytes each.  Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), row_hash(id_col, text_col, source_col).alias("tag"))
    # equal rows are counted and then numbered, so that no task gathers them
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("many"))
    ahead = Window.partitionBy("doc_id", "tag").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("ahead", F.coalesce(F.sum("many").over(ahead), F.lit(0)))
    each = equal.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    rows = durable(each.select("doc_id", "size", "source", nth_tag(F.col("ahead") + F.col("n")).alias("tag")))
    targets = durable(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total_share))
    small = targets.limit(10_001).count() <= 10_000
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = rows.join(F.broadcast(targets) if small else targets, rows["source"].eqNullSafe(targets["source"])).select("doc_id", "size", rows["source"], ratio.alias("ratio"), "tag")
    part = F.col("ratio") - F.floor("ratio")
    settled = F.round(part, 9).isin(0.0, 1.0) | (F.col("size") == 0)
    done = [units.where(settled).select("doc_id", "size", "source", "ratio", F.round(part, 9).alias("p"), "tag")]
    live = units.where(~settled).select("doc_id", "size", "source", "ratio", part.alias("p"), "tag")
    least = F.row_number().over(Window.partitionBy("source").orderBy("tag", "doc_id", "size"))
    reserve = durable(live.withColumn("r", least).where(F.col("r") <= RESERVE).drop("r"))
    mark = reserve.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("tag", "doc_id", "size")).alias("upto"))
    live = live.join(F.broadcast(mark) if small else mark, F.col("source").eqNullSafe(F.col("of"))).where(F.struct("tag", "doc_id", "size") > F.col("upto")).drop("of", "upto")
    count = rows.groupBy("source").count()
    step = 0
    while True:
        blocks = count.select(F.col("source").alias("of"), F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).alias("blocks"))
        blocks = F.broadcast(blocks) if small else blocks
        keyed = live.join(blocks, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("tag", F.lit(step)), F.col("blocks")))
        moved = durable(keyed.groupBy("source", "block").applyInPandas(lambda x: flight(x), UNITS))
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.where(~undecided))
        live = moved.where(undecided)
        count = durable(live.groupBy("source").count())
        step += 1
        if not count.where(F.col("count") > 2).limit(1).count():
            break
    done.append(durable(live.union(reserve).groupBy("source").applyInPandas(lambda x: landing(x), UNITS)))
    taken = done[0]
    for more in done[1:]:
        taken = taken.union(more)
    copies = F.when(F.col("size") > 0, (F.floor("ratio") + F.col("p")).cast("long")).otherwise(0)
    both = taken.join(F.broadcast(targets) if small else targets, taken["source"].eqNullSafe(targets["source"]))
    return both.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("tag"))
