"""Connected components by repeated minimum-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node reachable.

    Each round maps every node to its least neighbour, doubles these pointers until each reaches a
    local minimum, and replaces edge ends by their images.  At most half of the nodes are local
    minima, so that the number of rounds is logarithmic; a star vanishes in one.  Least neighbours are combined before the shuffle, hence a hub
    with very many links is no hot spot.  Self-loops, repeats and an empty table are fine; null ends
    are ignored.
    """
    live = settled(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct())
    whole = None
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("v"), "p")
        up = settled(up)
        moved = True
        while moved:  # pointer doubling, until every node points at the root of its tree
            jump = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = settled(up.join(jump, "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") < F.col("p")).alias("moved")))
            moved = up.where("moved").limit(1).count() > 0
            up = up.drop("moved")
        one = up.select(F.col("v").alias("a"), F.col("p").alias("x"))
        two = up.select(F.col("v").alias("b"), F.col("p").alias("y"))
        live = settled(live.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        if whole is None:
            whole = up
        else:
            step = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            whole = settled(whole.join(step, "p", "left").select("v", F.coalesce("q", "p").alias("p")))
    if whole is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return whole.select(F.col("v").alias("node"), F.col("p").alias("component"))
