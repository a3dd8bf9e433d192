"""Every registered query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import agent, boxes, guards, reports, runs, streams, text  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def flat(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not isinstance(v, (list, dict, str)) and pd.isna(v)):
            return "∅"
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(round(float(v), 7))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES, "a query needs an SQL twin"
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert flat(got) == flat(want)


def test_text_nodes_with_cut_references(spark, tmp_path):
    bodies = ["token = &quot</p>", "a &amp;&amp</p><p>b &amp</p>", "R&D &copy; &copy &ampx &quot;</p><p>&amp", "x &middot", "x &quo", "x &am", "x &amp<", "x &copy</p", "&amp;quot &amp;amp;</p>&"]
    rows = [(i, f"http://h/{i}", f"<!DOCTYPE html><html><head><title>t &amp; u</title></head><body><!-- c --><p>{b}") for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["page_text_nodes"](spark, str(tmp_path)).toPandas()
    assert flat(got) == flat(con.execute(ORACLES["page_text_nodes"]).df()) and len(got) == len(bodies)


def test_plans_stay_in_the_engine(spark):
    for name in ("detect_card_luhn_docs", "union_area", "pixel_prf", "mask_values", "sensitive_pages", "stuck_runs", "softmax_top1"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan, name


def test_plans_gather_nothing(spark):
    plan = lambda name: QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan("token_numbering")  # numbered by ranges
    for name in ("gt_value_containment", "redaction_union", "ocr_word_boxes", "pixel_prf", "resolve_target_fuzzy", "region_decisions"):
        text = plan(name)
        assert "CartesianProduct" not in text, name
    for name in ("gt_value_containment", "redaction_union", "ocr_word_boxes", "pixel_prf"):
        assert "NestedLoop" not in plan(name), name
    # only the columns that are asked reach the scan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan("page_text_nodes")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("detect_phone_docs")
