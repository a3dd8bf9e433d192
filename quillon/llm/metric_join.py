"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors are scaled to length one, where cosine >= t is distance <= r = sqrt(2 - 2t).  Equal vectors of
one label are one point with a weight.  A cell with more than BLOCK home points is split by pivots, up to
FAN of its own points.  Every home point goes to the cell of its nearest pivot.  A point y within r of x
lies on y's side of the bisector between their pivots, so by the triangle inequality x is at most r beyond
that bisector; x is replicated to exactly the cells for which

    x . p_nearest - x . p_cell <= r |p_nearest - p_cell|

and whose covering radius allows it: d(x, p_cell) <= r + the radius of the cell.  Each ordered pair
meets once, in the home cell of its second point.  Cells are split again until they are small or
splitting saves no comparisons (all their points are near each other); so the number of pivots grows
with the data, while a task only holds FAN of them.

A cell left with many points is dealt over blocks of its home points, and its other points go to every
block, so that cells join independently and no task holds more than a block and one slice of visitors.

Rounding: the test of the bisector is a product, not a quotient, and allows for the error of two sums of
products; pivots nearer than MERGE are one.  Pivots change work, never the result.  In a block only
counts and one edge for each point and local component leave; pairs are never emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.store import durable

FAN = 64
BLOCK = 2048
#: A split must save this share of the comparisons, or its cells are not split again.
SAVED = 0.1
#: Slack for rounding of distances, which near 0 have half the digits of a product; it only adds work.
SLACK = 1e-6
MERGE = 1e-6
#: Products this near the threshold are summed again without rounding error.
CLOSE = 1e-12


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish; angles stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    rows = scaled(vectors)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * a @ b.T))


def apart(pivots: np.ndarray) -> np.ndarray:
    """The unit rows without those nearer than MERGE to an earlier one."""
    kept: list[np.ndarray] = []
    for p in pivots:
        if not kept or np.linalg.norm(np.vstack(kept) - p, axis=1).min() >= MERGE:
            kept.append(p)
    return np.vstack(kept)


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row of x its nearest pivot, and which cells it must visit (that one included)."""
    dot = x @ pivots.T
    nearest = dot.argmax(axis=1)
    gap = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
    # a sum of d products of unit vectors is off by at most about d roundings; four sums meet here
    error = 8 * (x.shape[1] + 8) * np.finfo(float).eps
    beyond = dot[np.arange(len(x)), nearest][:, None] - dot
    return nearest, beyond <= (radius + SLACK) * gap[nearest] + error


def split(visits: pd.DataFrame, picked: pd.DataFrame, radius: float) -> pd.DataFrame:
    """The visits of one cell, dealt over the cells of its pivots."""
    columns = ["point", "label", "dim", "weight", "embedding", "cell", "part", "home", "far"]
    if not len(visits):
        return pd.DataFrame([], columns=columns)
    pivots = apart(unit(matrix(picked.sort_values("rank")["pivot"])))
    x = unit(matrix(visits["embedding"]))
    nearest, visit = cells_of(x, pivots, radius)
    row, cell = np.nonzero(visit)
    out = visits.iloc[row][["point", "label", "dim", "weight", "embedding", "cell"]].copy()
    out["part"] = cell.astype(np.int32)
    out["home"] = visits["home"].to_numpy()[row] & (nearest[row] == cell)
    out["far"] = distances(x, pivots)[row, cell]
    return out[columns]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    from math import fsum, sqrt

    return fsum(a * b) / sqrt(fsum(a * a) * fsum(b * b))


class Groups:
    """Local components over the rows of a block; the least point of each stands for it."""

    def __init__(self, point: np.ndarray):
        self.point, self.parent = point, np.arange(len(point))

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            low, high = (i, j) if self.point[i] <= self.point[j] else (j, i)
            self.parent[high] = low

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def compare(key: tuple, pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of every visitor of a block with the block's home points.

    Only links between groups are looked at one by one, a visitor's first at a time, so a dense block
    costs a few matrix operations.
    """
    raw = scaled(matrix(pdf["embedding"]))
    x = unit(raw)
    home = np.flatnonzero(pdf["is_home"].to_numpy())
    point, weight = pdf["point"].to_numpy(), pdf["weight"].to_numpy()
    links = np.zeros(len(x), dtype=np.int64)
    groups = Groups(point)
    for lo in range(0, len(x), 1024):
        c = x[lo : lo + 1024] @ x[home].T
        near = c >= threshold
        for i, j in np.argwhere(np.abs(c - threshold) <= CLOSE):
            near[i, j] = exact_cosine(raw[lo + i], raw[home[j]]) >= threshold
        near &= point[lo : lo + 1024, None] != point[home][None, :]
        links[lo : lo + 1024] = near @ weight[home]
        while True:
            own = groups.labels()
            across = near & (own[lo : lo + 1024, None] != own[home][None, :])
            rows = np.flatnonzero(across.any(axis=1))
            if not len(rows):
                break
            for i, j in zip((rows + lo).tolist(), home[across[rows].argmax(axis=1)].tolist(), strict=True):
                groups.join(i, j)
    top = point[groups.labels()]
    some = (links > 0) | (top != point)
    return pd.DataFrame({"point": point[some], "links": links[some], "top": top[some]})


def smaller_cells(visits: DataFrame, kind: str, radius: float, fan: int, block: int) -> DataFrame:
    """Splits cells until each has at most ``block`` home points or splitting no longer helps.

    ``visits`` has point, label, dim, weight, embedding, cell, home, final.
    """
    cell = ["label", "dim", "cell"]
    schema = f"point long, label string, dim int, weight long, embedding {kind}, cell long, part int, home boolean, far double"
    while True:
        sizes = durable(visits.groupBy(*cell, "final").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")))
        large = sizes.where(~F.col("final") & (F.col("homes") > block))
        if not large.limit(1).count():
            return visits
        large = durable(large.withColumn("shares", F.ceil(F.col("n") / block)))
        todo = visits.join(large.select(*cell, "shares"), cell)
        rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.xxhash64("point", F.col("cell")), "point"))
        picked = todo.where("home").select(*cell, "shares", "point", F.col("embedding").alias("pivot")).withColumn("rank", rank).where(F.col("rank") <= fan)
        picked = picked.where(F.col("rank") <= F.greatest(F.lit(2), F.ceil(F.col("shares") * 2)))
        picked = durable(picked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select(*cell, "share", "rank", "pivot").toDF("of_label", "of_dim", "of_cell", "of_share", "rank", "pivot"))
        dealt = todo.withColumn("share", F.pmod(F.xxhash64("point", F.lit(3)), F.col("shares")))
        parts = dealt.groupBy(*cell, "share").cogroup(picked.groupBy("of_label", "of_dim", "of_cell", "of_share")).applyInPandas(lambda x, y: split(x, y, radius), schema)
        parts = durable(parts)
        own = parts.groupBy(*cell, "part").agg(F.max(F.when(F.col("home"), F.col("far"))).alias("reach"), F.sum(F.col("home").cast("long")).alias("h")).where("h > 0")
        parts = parts.join(own, [*cell, "part"]).where(F.col("far") <= F.col("reach") + radius + SLACK)
        work = parts.groupBy(*cell, "part").agg((F.count("*") * F.sum(F.col("home").cast("long"))).cast("double").alias("w")).groupBy(*cell).agg(F.sum("w").alias("after"))
        done = work.join(large, cell).select(*cell, (F.col("after") > F.col("n").cast("double") * F.col("homes") * (1 - SAVED)).alias("final"))
        parts = parts.join(done, cell).select("point", "label", "dim", "weight", "embedding", F.xxhash64("cell", "part").alias("cell"), "home", "final")
        kept = visits.join(large.select(*cell), cell, "left_anti").select(*parts.columns)
        visits = durable(kept.union(parts))


def metric_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Null labels, null, zero or non-finite vectors and empty arrays link with nothing; vectors of
    different lengths are never compared.  Rows that share an id are one node, whose links are added
    up; a null id links with nothing and gets no component.  Very long vectors are compared whole.  Empty
    table: no rows.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # -0.0 and 0.0 are one value
    clean = rows.where("ok").withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(kind[6:-1])).otherwise(v)))
    point = clean.groupBy("label", "embedding").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))
    point = durable(point)
    if not point.limit(1).count():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    visits = point.select("point", "label", F.size("embedding").alias("dim"), "weight", "embedding", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(False).alias("final"))
    visits = smaller_cells(visits, kind, radius, fan, block)
    cells = visits.groupBy("label", "dim", "cell").agg(F.sum(F.col("home").cast("long")).alias("n"), F.count("*").alias("all")).where("n > 0")
    cells = cells.select("label", "dim", "cell", F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("all") / block).alias("slices"))
    visits = visits.join(cells, ["label", "dim", "cell"])
    own = F.pmod(F.xxhash64("point"), F.col("blocks"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    visits = visits.withColumn("is_home", F.col("home") & (own == F.col("block")))
    # visitors of a block are dealt over slices as well; each slice has all the block's home points
    slice_ = F.when(F.col("is_home"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("point", F.lit(7)), F.col("slices"))))
    visits = visits.withColumn("slice", F.explode(slice_))
    found = visits.groupBy("label", "dim", "cell", "block", "slice").applyInPandas(
        lambda key, pdf: compare_slice(key, pdf, threshold), "point long, links long, top long"
    )
    found = durable(found)
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    edges = found.where("top <> point").select(F.col("point").alias("a"), F.col("top").alias("b")).distinct()
    joined = components(edges)
    per_point = point.select("point", "label", "embedding", "weight").join(counts, "point", "left").join(joined.withColumnRenamed("node", "point"), "point", "left")
    per_point = per_point.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    linked = clean.join(per_point, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def compare_slice(key: tuple, pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """As compare; a home point counts its links with its own block in one slice only."""
    found = compare(key, pdf, threshold)
    if key[4] != 0:
        home = set(pdf["point"][pdf["is_home"]])
        found.loc[found["point"].isin(home), "links"] = 0
    return found
