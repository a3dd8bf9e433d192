"""Findings of all detectors as one ordered log, and boxes of values that were read from pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rules import mask_value
from quillon.functions.text import trim_nonword

BOX = ("x", "y", "w", "h")
LOG = ("type", "tier", "token", "source", "masked", *BOX)


def log_rows(df: DataFrame, keys: list[str], part: int, **fixed: str) -> DataFrame:
    """Rows as log entries: columns of LOG, fixed values first, what is missing null."""
    pick = lambda c: F.lit(fixed[c]) if c in fixed else F.col(c) if c in df.columns else F.lit(None)
    kinds = {c: "int" if c in BOX else "string" for c in LOG}
    return df.select(*keys, F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), *[pick(c).cast(kinds[c]).alias(c) for c in LOG])


def redaction_union(prose: DataFrame, faces: DataFrame, ocr: DataFrame, escalated: DataFrame, dom: DataFrame, keys: list[str], near: int = 4) -> DataFrame:
    """All redactions of a page in order: prose, faces, OCR values, escalated regions, elements; ``seq`` counts them.

    Every input has keys…, ord and a box.  An OCR value covers its whole region where one is known
    (region_x, …).  An escalated region is left out if an earlier finding lies within ``near`` of it on
    all four numbers.
    """
    region = [F.coalesce(F.col(f"region_{c}") if f"region_{c}" in ocr.columns else F.lit(None), F.col(c)).alias(c) for c in BOX]
    words = ocr.select(*[c for c in ocr.columns if c not in BOX], *region)
    if "value" in ocr.columns:
        words = words.withColumn("masked", mask_value(F.col("value")))
    before = [log_rows(prose, keys, 0), log_rows(faces, keys, 1, type="face", tier="C", source="vision"), log_rows(words, keys, 2, tier="B", source="vision")]
    known = reduce(DataFrame.union, before).select(*keys, *[F.col(c).alias(f"k_{c}") for c in BOX])
    e = log_rows(escalated, keys, 3, type="graphics", tier="C", source="perception")
    close = [F.abs(F.col(c) - F.col(f"k_{c}")) <= near for c in BOX]
    same = [e[k].eqNullSafe(known[k]) for k in keys]
    fresh = e.join(known, reduce(lambda a, b: a & b, [*same, *close]), "left_anti")
    every = reduce(DataFrame.union, [*before, fresh, log_rows(dom, keys, 4)])
    return every.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "ord", "type", *BOX)) - 1)


def word_boxes(words: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Union box (x0, y0, x1, y1) of the words of a line that belong to a value read in it.

    ``words`` has keys…, text and a box x0…y1; ``values`` has keys…, value and the line's own box
    line_x0…line_y1, which counts where no word fits.  A word belongs if it and a part of the value hold one
    another, after marks around the word are cut.
    """
    corners = ("x0", "y0", "x1", "y1")
    parts = F.filter(F.split("value", r"\s+"), lambda p: p != "")
    word = words.select(*keys, trim_nonword(F.col("text")).alias("t"), *[F.col(c).alias(f"w_{c}") for c in corners]).where("t <> ''")
    # both sides meet within one line
    hit = values.withColumn("parts", parts).join(word, keys).where(F.exists("parts", lambda p: p.contains(F.col("t")) | F.col("t").contains(p)))
    box = hit.groupBy(*keys, "value").agg(*[(F.min if c in ("x0", "y0") else F.max)(f"w_{c}").alias(c) for c in corners])
    out = values.join(box, [*keys, "value"], "left")
    return out.select(*keys, "value", *[F.coalesce(c, f"line_{c}").alias(c) for c in corners])
