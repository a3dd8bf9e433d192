"""Classifier post-processing: probabilities, tags, tiles, region decisions, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.geometry import overlapping

# ---- fixed values: class sets and thresholds, which must equal the specification ----
CLASS_TAGS = {
    "ui": (487, 508, 527, 590, 620, 664, 673, 681, 761, 782, 851),
    "document": (446, 549, 553, 893, 917, 921, 922),
    "data": (409, 426, 530, 531, 781, 826, 892),
}
BLANK_BELOW, UNCERTAIN_BELOW, OVERLAP, SMALLEST = 0.22, 0.5, 0.25, 24
TILE, TAG_ORDER = 480, ("photo", "ui", "document", "data", "blank", "uncertain")
# ---- end of fixed values ----


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def top1(logits: Column) -> Column:
    """struct(cls, conf); the first index wins ties."""
    conf = 1.0 / F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(logits)))
    return F.struct((F.array_position(logits, F.array_max(logits)) - 1).cast("int").alias("cls"), conf.alias("conf"))


def tag(cls: Column, conf: Column) -> Column:
    named = [F.when(cls.isin(list(ids)), F.lit(name)) for name, ids in CLASS_TAGS.items()]
    return F.when(conf < BLANK_BELOW, "blank").when(conf < UNCERTAIN_BELOW, "uncertain").otherwise(F.coalesce(*named, F.lit("photo")))


def class_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``label`` from (cls, name); an unknown class shows its number."""
    return df.join(names.select("cls", F.col("name").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", F.col("cls").cast("string")))


def grid(width: Column, height: Column, most: Column) -> tuple[Column, Column]:
    cols = F.least(F.greatest(F.ceil(width / TILE), F.lit(2)), F.lit(4)).cast("int")
    rows = F.least(F.greatest(F.ceil(height / TILE), F.lit(1)), F.lit(3)).cast("int")
    return cols, F.least(rows, F.greatest(F.lit(1), F.floor(most / cols))).cast("int")


def tiles(width: Column, height: Column, most: Column) -> Column:
    """Tile boxes row by row; edges are rounded so that tiles meet."""
    cols, rows = grid(width, height, most)
    at = lambda n, total, size: F.floor(n * size / total + 0.5).cast("int")

    def row(r):
        def cell(c):
            x, y = at(c, cols, width), at(r, rows, height)
            return F.struct(x.alias("x"), y.alias("y"), (at(c + 1, cols, width) - x).alias("w"), (at(r + 1, rows, height) - y).alias("h"))

        return F.transform(F.sequence(F.lit(0), cols - 1), cell)

    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), row))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tag counts as a map; absent tags have no key."""
    n = df.groupBy(*keys, "tag").agg(F.count("*").cast("int").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("summary"))


def decisions(tile: DataFrame, region: DataFrame, keys: list[str]) -> DataFrame:
    """Per region (keys…, ord) the dominant tag, and whether it escalates or looks like a captcha.

    Regions under 24 × 24 have no decision.  Tiles count when they cover a quarter of the region.
    """
    big = region.where((F.col("w") >= SMALLEST) & (F.col("h") >= SMALLEST))
    pairs = overlapping(tile, big, keys, OVERLAP)
    best = Window.partitionBy(*keys, "b_ord").orderBy(F.col("a_conf").desc(), "a_ord", "a_tag")
    top = pairs.withColumn("r", F.row_number().over(best)).where("r = 1")
    t = F.col("a_tag")
    return top.select(*keys, F.col("b_ord").alias("region"), t.alias("tag"), t.isin("photo", "ui", "document", "uncertain").alias("escalate"), (t == "uncertain").alias("captcha_like"))


def complexity(enabled: Column, summary_: Column, escalate: Column, captcha: Column) -> Column:
    get = lambda k: F.coalesce(F.try_element_at(summary_, F.lit(k)), F.lit(0))
    total = get("photo") + get("document") + get("uncertain") + escalate.cast("int") + captcha.cast("int")
    return F.when(F.coalesce(enabled, F.lit(False)), total).otherwise(0)


def route(requested: Column, enabled: Column, complexity_: Column, small: Column, big: Column, routing: Column) -> Column:
    """Model name, or null for the default."""
    none = lambda c: F.nullif(c, F.lit(""))
    skip = none(requested).isNotNull() | ~F.coalesce(routing, F.lit(False)) | ~F.coalesce(enabled, F.lit(False))
    return F.when(~skip, F.when(complexity_ > 0, none(big)).otherwise(none(small)))


def normalise_pixel(v: Column) -> Column:
    return v / 127.5 - 1


def image_scale(width: Column, most: int = 1280) -> Column:
    return F.least(F.lit(1.0), most / width)


def region_key(parts: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(parts, lambda p: p.cast("string"))), ";")
