"""The leak gate: a query of violations; nothing leaves for pages that have one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions.rules import RULES, all_values, may_match
from quillon.functions.text import squash
from quillon.operators.containment import contained


def text_columns(df: DataFrame, keys: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in keys]


def violations(payload: DataFrame, keys: list[str], columns: list[str] | None = None, ocr: bool = False) -> DataFrame:
    """One row for each value that a rule still finds in any text column of the payload."""
    columns = columns or text_columns(payload, keys)
    rules = [r for r in RULES if ocr or not r.ocr_only]
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]))
    cells = payload.select(*keys, fields.alias("f")).select(*keys, "f.*").where(may_match(F.col("text")))
    named = lambda r: F.transform(all_values(r, F.col("text")), lambda v: F.struct(F.lit(r.name).alias("type"), v.alias("value")))
    hits = F.concat(*[named(r) for r in rules])
    return cells.select(*keys, "field", F.explode(hits).alias("h")).select(*keys, "field", "h.type", "h.value")


def verdict(regions: Column, host_up: Column, hits: Column) -> Column:
    """pass only if proven: unknown is never a pass."""
    return F.when(hits > 0, "block").when(regions == 0, "pass").when(F.coalesce(host_up, F.lit(False)) & hits.isNotNull(), "pass").otherwise("skip")


def image_pass(ok: Column, error: Column) -> Column:
    return F.coalesce(ok & error.isNull(), F.lit(False))


def release(payload: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """Allow-listed columns of rows without violations, as JSON bodies."""
    bad = violations(payload, keys, allowed).select(*keys).distinct()
    safe = payload.join(bad, keys, "left_anti")
    return safe.select(*keys, F.to_json(F.struct(*allowed)).alias("body"))


def audit(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Union of scans as (keys…, origin, detail)."""
    named = [df.select(*keys, F.lit(o).alias("origin"), F.col("detail").cast("string")) for o, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def passes(hits: DataFrame, keys: list[str], everyone: DataFrame) -> DataFrame:
    n = hits.groupBy(*keys).agg(F.count("*").alias("n_hits"))
    return everyone.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), (F.coalesce("n_hits", F.lit(0)) == 0).alias("passed"))


__all__ = ["violations", "verdict", "image_pass", "release", "contained", "audit", "passes", "squash"]
