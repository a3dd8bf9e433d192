"""Boxes (x, y, w, h): overlap, containment, union area and tolerance joins, always within a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.io import dealt


def area(w: Column, h: Column) -> Column:
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlap(a: str, b: str) -> Column:
    """Shared area of two boxes given by column prefixes."""
    c = lambda p, f: F.col(f"{p}{f}")
    w = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    h = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return area(w, h)


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    union = area(F.col(f"{a}w"), F.col(f"{a}h")) + area(F.col(f"{b}w"), F.col(f"{b}h")) - both
    return both / F.when(union == 0, 1).otherwise(union)


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


#: Levels of grids: cells have sides of 2^LOWEST, and CELL_STEP powers of two more at each level.
LOWEST, CELL_STEP, LEVELS = 9, 2, 12


def level(extent: Column) -> Column:
    """The finest grid whose cells are as wide and high as a box, so that it touches at most four of them."""
    need = F.ceil((F.log2(F.greatest(extent.cast("double"), F.lit(1.0))) - LOWEST) / CELL_STEP)
    return F.least(F.greatest(need, F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def cell(at: Column, of: Column) -> Column:
    return F.floor(at.cast("double") / F.pow(F.lit(2.0), LOWEST + CELL_STEP * of)).cast("long")


def in_cells(df: DataFrame, p: str, of: Column) -> DataFrame:
    """Rows once for each cell of a level that their box touches, edges included."""
    x0, y0, x1, y1 = F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}x") + F.greatest(F.col(f"{p}w"), F.lit(0)), F.col(f"{p}y") + F.greatest(F.col(f"{p}h"), F.lit(0))
    df = df.withColumn("__level", of)
    df = df.withColumn("__cx", F.explode(F.sequence(cell(x0, F.col("__level")), cell(x1, F.col("__level")))))
    return df.withColumn("__cy", F.explode(F.sequence(cell(y0, F.col("__level")), cell(y1, F.col("__level")))))


def meeting(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes a_*, b_* of equal keys that touch or overlap, each once: a join on cells of a grid.

    A box lies in the grid whose cells are as large as it, hence in four cells at most.  A pair is looked for in the grid
    of its larger box, so each box goes to its own level and, as the smaller one, to those above that the other side has.
    It is counted in the one cell that holds the upper left corner of what both share.  Boxes without extent are points.
    """
    sized = lambda df, p: df.withColumn("__own", level(F.greatest(F.col(f"{p}w"), F.col(f"{p}h"))))
    a, b = sized(a, "a_"), sized(b, "b_")
    on = [*keys, "__level", "__cx", "__cy"]
    used = a.select("__own", F.lit("a_").alias("of")).union(b.select("__own", F.lit("b_"))).distinct().collect()  # twice LEVELS at most

    def side(large: DataFrame, p: str, small: DataFrame, q: str, equal: bool) -> DataFrame:
        levels = [F.lit(r["__own"]) for r in used if r["of"] == p and r["__own"] is not None]
        above = F.filter(F.array(*levels).cast("array<int>"), lambda k: k >= F.col("__own") if equal else k > F.col("__own"))
        rising = in_cells(small.withColumn("__at", F.explode(above)), q, F.col("__at")).drop("__at", "__own")
        return in_cells(large, p, F.col("__own")).drop("__own").join(rising, on)

    pairs = side(a, "a_", b, "b_", True)
    rank = lambda p: [r["__own"] for r in used if r["of"] == p and r["__own"] is not None]
    if max(rank("b_"), default=0) > min(rank("a_"), default=LEVELS):  # else no box of b is larger than one of a
        pairs = pairs.unionByName(side(b, "b_", a, "a_", False))
    reach = lambda p, c, d: F.col(f"{p}{c}") + F.greatest(F.col(f"{p}{d}"), F.lit(0))
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    touch = (left <= F.least(reach("a_", "x", "w"), reach("b_", "x", "w"))) & (top <= F.least(reach("a_", "y", "h"), reach("b_", "y", "h")))
    here = (cell(left, F.col("__level")) == F.col("__cx")) & (cell(top, F.col("__level")) == F.col("__cy"))
    return pairs.where(touch & here).drop("__level", "__cx", "__cy")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], least: float, of: str = "right") -> DataFrame:
    """Pairs a_*, b_* whose shared area is at least a part, more than none, of the right (or left) box."""
    pairs = meeting(prefixed(left, "a_", keys), prefixed(right, "b_", keys), keys)
    base = area(F.col("b_w"), F.col("b_h")) if of == "right" else area(F.col("a_w"), F.col("a_h"))
    pairs = pairs.withColumn("shared", overlap("a_", "b_")).withColumn("base", base)
    return pairs.where((F.col("base") > 0) & (F.col("shared") > 0) & (F.col("shared") >= F.col("base") * least))


def first_containing(points: DataFrame, regions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each box with the first region that holds its centre, else null (left join)."""
    a, b = prefixed(points, "a_", keys), prefixed(regions, "b_", keys)
    cx, cy = F.col("a_x") + F.col("a_w") / 2, F.col("a_y") + F.col("a_h") / 2
    inside = (cx >= F.col("b_x")) & (cx <= F.col("b_x") + F.col("b_w")) & (cy >= F.col("b_y")) & (cy <= F.col("b_y") + F.col("b_h"))
    # the centre of a box stands in a region that meets the box
    hit = meeting(a, b, keys).where(inside).groupBy(*keys, "a_ord").agg(F.min(f"b_{order}").alias("region"))
    return a.join(hit, [*keys, "a_ord"], "left").select(*keys, "a_ord", "region")


def recalled(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Truth rows with ``hit``: some found box of the same keys covers at least that part of it."""
    t, p = prefixed(truth, "a_", keys), prefixed(found, "b_", keys)
    base = area(F.col("a_w"), F.col("a_h"))
    hits = meeting(t, p, keys).where((base > 0) & (overlap("a_", "b_") >= base * least)).select(*keys, "a_ord").distinct().withColumn("hit", F.lit(True))
    return t.join(hits, [*keys, "a_ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def not_near(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int = 4) -> DataFrame:
    """Left boxes without a right box whose four numbers all differ by at most the tolerance."""
    a, b = prefixed(left, "a_", keys), prefixed(right, "b_", keys)
    # corners that are near lie in one square of the tolerance's size, or in neighbouring ones
    step = F.lit(max(1, tolerance))
    square = lambda p, c, move=None: (F.floor(F.col(f"{p}{c}") / step) + (move if move is not None else 0)).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = b.withColumn("__d", around).withColumns({"__cx": square("b_", "x", F.col("__d.i")), "__cy": square("b_", "y", F.col("__d.j"))}).drop("__d")
    a = a.withColumns({"__cx": square("a_", "x"), "__cy": square("a_", "y")})
    on = [a[k] == b[k] for k in [*keys, "__cx", "__cy"]] + [F.abs(a[f"a_{c}"] - b[f"b_{c}"]) <= tolerance for c in "xywh"]
    return a.join(b, on, "left_anti").drop("__cx", "__cy")


#: Height of the bands that a page is cut into before its boxes are swept, and pieces of boxes that a task sweeps.
BAND, PIECES = 256, 100_000


def covered_areas(boxes: DataFrame, keys: list[str], width: int | None = None, height: int | None = None, groups: dict[str, Column] | None = None) -> DataFrame:
    """``area`` covered by the boxes of each key, and by those of each named group; one sweep, no pixels.

    Pages are cut into bands, bands into slabs between neighbouring y edges.  A box joins the slabs that it
    spans; boxes of a slab that start together are one interval, so that a slab holds at most as
    many rows as there are places to start, however many boxes a page has.
    """
    groups = groups or {}
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    if width is not None:
        x0, x1 = F.greatest(x0, F.lit(0)), F.least(x1, F.lit(width))
    if height is not None:
        y0, y1 = F.greatest(y0, F.lit(0)), F.least(y1, F.lit(height))
    flat = boxes.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), *[c.alias(f"in_{g}") for g, c in groups.items()]).where("x1 > x0 and y1 > y0")
    first, last = F.floor(F.col("y0") / BAND), F.ceil(F.col("y1") / BAND) - 1
    cut = flat.withColumn("band", F.explode(F.sequence(first, last))).withColumns({"y0": F.greatest("y0", F.col("band") * BAND), "y1": F.least("y1", (F.col("band") + 1) * BAND)})
    own = [*keys, "band"]
    # dealt once, by the number of pieces: all steps up to the sum keep a band's rows where they are
    pieces = flat.agg(F.coalesce(F.sum(last - first + 1), F.lit(0)).cast("long")).first()[0]
    cut = dealt(cut, *own, rows=pieces, each=PIECES).distinct()
    edge = cut.select(*own, F.explode(F.array("y0", "y1")).alias("lo")).distinct()
    slab = edge.withColumn("hi", F.lead("lo").over(Window.partitionBy(*own).orderBy("lo"))).where("hi is not null")
    part = cut.join(slab, own).where("y0 <= lo and y1 >= hi")
    ends = {"area": F.max("x1")} | {g: F.max(F.when(F.col(f"in_{g}"), F.col("x1"))) for g in groups}
    part = part.groupBy(*own, "lo", "hi", "x0").agg(*[c.alias(g) for g, c in ends.items()])
    before = Window.partitionBy(*own, "lo").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1)
    reach = part.withColumns({f"reach_{g}": F.coalesce(F.max(g).over(before), F.col("x0")) for g in ends})
    run = lambda g: F.coalesce(F.greatest(F.col(g), F.col(f"reach_{g}")) - F.greatest("x0", F.col(f"reach_{g}")), F.lit(0))
    # without an end of its own group a row adds nothing: greatest() would skip the null
    grown = [F.sum(F.when(F.col(g).isNotNull(), (F.col("hi") - F.col("lo")) * run(g)).otherwise(0)).cast("long").alias(g) for g in ends]
    return reach.groupBy(*keys).agg(*grown)


def union_area(boxes: DataFrame, keys: list[str], width: int | None = None, height: int | None = None) -> DataFrame:
    """Area covered by the boxes of each key."""
    return covered_areas(boxes, keys, width, height)


def pixel_areas(truth: DataFrame, found: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys…, gt, pred, inter) areas; intersection = both - union of all."""
    box = [*keys, "x", "y", "w", "h"]
    both = truth.select(*box, F.lit(True).alias("true_box")).union(found.select(*box, F.lit(False)))
    out = covered_areas(both, keys, width, height, {"gt": F.col("true_box"), "pred": ~F.col("true_box")})
    return out.select(*keys, "gt", "pred", (F.col("gt") + F.col("pred") - F.col("area")).alias("inter"))


def fuzzy_distinct(items: Column, kind: str, tolerance: int = 2) -> Column:
    """Keeps an item (type, x, y, …) unless one of the same type and near place was kept; order matters.

    ``kind`` is the array's type.  Kept ones stand in a hash of squares as wide as the tolerance, of which an item looks at nine.
    """

    def keep(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        side = max(1, tolerance)
        for rows in arrays:
            out = []
            for held in rows:
                squares: dict[tuple, list] = {}
                kept = []
                for m in () if held is None else held:
                    x, y = int(m["x"] // side), int(m["y"] // side)
                    near = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in squares.get((m["type"], x + i, y + j), ()))
                    if not any(abs(k["x"] - m["x"]) <= tolerance and abs(k["y"] - m["y"]) <= tolerance for k in near):
                        squares.setdefault((m["type"], x, y), []).append(m)
                        kept.append(m)
                out.append(kept)
            yield pd.Series(out)

    return F.pandas_udf(keep, kind)(items)


def bounding_box(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def scaled(df: DataFrame, factor: Column) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * factor + 0.5).cast("int") for c in "xywh"})


def padded(df: DataFrame, share: float = 0.15) -> DataFrame:
    return df.withColumns({"x": F.col("x") - F.col("w") * share, "y": F.col("y") - F.col("h") * share, "w": F.col("w") * (1 + 2 * share), "h": F.col("h") * (1 + 2 * share)})


def largest(df: DataFrame, keys: list[str], most: int = 24) -> DataFrame:
    """Top boxes by area; Catalyst turns the filter into a window group limit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(area(F.col("w"), F.col("h")).desc(), "ord"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)
