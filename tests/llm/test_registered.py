"""Registered queries over the smallest tables, and their SQL twins."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "client_changes"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    cell = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) else str(v)  # noqa: E731  a column with nulls may come as floats
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].astype(object).to_numpy().tolist())
    assert rows(got) == rows(want)


LABELLED = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,column,least", [("op5_toxicity_zstd", "toxic", "predicted", 0.95), ("op7_ordinal_quality", "quality", "kept", 0.85)])
def test_held_out_accuracy(spark, name, label, column, least):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", label)
    got = QUERIES[name](spark, LABELLED).where("held_out").select("doc_id", F.col(column).cast("int").alias("got"))
    right, n = got.join(labels, "doc_id").agg(F.avg((F.col("got") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 50 and right >= least


def test_planted_items_are_found(spark):
    """Every document that holds an item's words in a row is reported for it, without an edit."""
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in t).split()
    held = lambda name: [(r[0], f" {' '.join(words(r[1]))} ") for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect() if r[1]]
    want = {(d, i) for d, text in held("documents") for i, item in held("benchmark") if item.strip() and item in text}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op10_pigeonhole"](spark, FOLDER).collect()}
    assert want and all(got.get(pair) == 0 for pair in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op10_pigeonhole"}))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith(("op2_", "op4_")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = QUERIES[name](spark, FOLDER)
    assert got.select(key).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
