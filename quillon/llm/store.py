"""Tables kept between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillon.checkpoint import durable, remove, shared_folder, swept

__all__ = ["durable", "remove", "settled", "shared_folder", "swept"]


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """As durable, for a table that may be small: then dealt over one partition for each so many rows,
    which saves a file for each partition in every shuffle that follows."""
    out = durable(df)
    return out.coalesce(max(1, -(-out.count() // rows)))
