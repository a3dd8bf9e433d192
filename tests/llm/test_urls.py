"""URL rules against brute force and SQL."""

import os
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import url_rules

FOLDER = "/root/testdata/sf0.001"


def test_url_rules(spark):
    urls = {
        1: ("http://x.example.com/en/1?q=1", "example.com/en/", "block"),
        2: ("https://WWW.example.com/en/1", "www.example.com/en/", "allow"),
        3: ("https://a.net/es/", "net/es/", "block"),
        4: ("https://net/fr/x#y", "net/fr/", "block"),
        5: ("https://example.com/de", "com/", "allow"),
        6: ("https://planet/es/", None, "allow"),
        7: (None, None, "allow"),
        8: ("mailto:x", None, "allow"),
        9: ("http://a.com", None, "allow"),
        10: ("http://b.org/en/3", None, "allow"),
    }
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame([(k, u) for k, (u, *_) in urls.items()], "page_id long, url string")).collect()}
    for k, (_, rule, verdict) in urls.items():
        assert got[k]["rule"] == rule
        if rule:
            assert got[k]["verdict"] == verdict
    assert (got[4]["host"], got[4]["path"]) == ("net", "/fr/x") and (got[7]["host"], got[8]["path"]) == ("", "")
    empty = spark.createDataFrame([], "page_id long, url string, items int, host string, verdict int")
    assert url_rules.judge(empty).count() == 0


FIXED = """with u as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
  p as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
  r(h, q, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
  f as (select page_id, h || q as rule, v, row_number() over (partition by page_id order by length(h || q) desc) as n
    from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
  select page_id, host, path, rule, v from p left join (select * from f where n = 1) using (page_id)"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_fixed_part_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(FIXED).fetchall()}
    got = {r["page_id"]: r for r in url_rules.judge(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    assert set(got) == set(want)
    for k, (host, path, rule, verdict) in want.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert verdict is None or got[k]["verdict"] == verdict


def brute_rules(rows, support, confidence):
    """All item sets, counted one by one."""
    found = {}
    names = sorted({x for own, _ in rows for x in own})
    for n in range(1, 5):
        for need in combinations(names, n):
            held = [v for own, v in rows if set(need) <= set(own)]
            for verdict in ("allow", "block"):
                times = held.count(verdict)
                if times < support * len(rows) or not times:
                    continue
                share, z, m = (times + held.count(None) / 2) / len(held), 1.96, len(held)
                sure = (share + z * z / (2 * m) - z * (share * (1 - share) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
                if sure >= confidence and m >= 10:
                    found[need, verdict] = sure, times / len(rows)
    return {
        (need, verdict): x
        for (need, verdict), x in found.items()
        if not any((tuple(i for i in need if i != gone), verdict) in found and found[tuple(i for i in need if i != gone), verdict][0] >= x[0] for gone in need)
    }


def transactions(rng, n):
    rows = []
    for _ in range(n):
        site, path, scheme = rng.choice("abc"), rng.choice("pqr"), rng.choice(["http", "https"])
        given = {"a": "block" if path == "p" else "allow", "b": "block" if path == "p" else None, "c": None if rng.random() < 0.9 else "block"}[site]
        rows.append((sorted([f"site:{site}", f"path:{path}", f"scheme:{scheme}"]), given))
    return rows


def test_rules_equal_brute_force(spark, monkeypatch):
    rows = transactions(random.Random(6), 400)
    df = spark.createDataFrame(rows, "items array<string>, verdict string")
    want = brute_rules(rows, 0.02, 0.8)
    rules = url_rules.mine(df, 0.02, 0.8)
    got = {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert set(got) == set(want) and len(want) >= 3
    assert all(got[k] == pytest.approx(want[k]) for k in want)

    def strongest(own):
        fits = [(round(c, 12), round(s, 12), len(need), list(need), v) for (need, v), (c, s) in want.items() if set(need) <= set(own)]
        return max(fits)[-1] if fits else None

    asked = [(i, own) for i, (own, _) in enumerate(rows)] + [(1000, []), (1001, None), (1002, ["site:zz", "path:p"])]
    for sent in (20_000, 0):  # rules sent or joined: the same verdicts, ties included
        monkeypatch.setattr(url_rules, "SENT_RULES", sent)
        out = {r["k"]: r["mined"] for r in url_rules.matched(spark.createDataFrame(asked, "k int, items array<string>"), rules).collect()}
        assert out == {k: strongest(own or []) for k, own in asked}


def test_one_sided_sites_do_not_decide(spark):
    # every decided URL of site b is blocked, but most of its URLs are undecided
    rows = transactions(random.Random(6), 400)
    rules = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()
    assert not any(list(r["antecedent"]) == ["site:b"] for r in rules)
    assert url_rules.mine(spark.createDataFrame([(["a"], None)], "items array<string>, verdict string")).count() == 0


def test_rules_hold_on_urls_that_were_not_mined(spark):
    rows = [(k, own, given) for k, (own, given) in enumerate(transactions(random.Random(9), 900))]
    df = spark.createDataFrame(rows, "k int, items array<string>, verdict string")
    rules = url_rules.mine(df.where("k % 3 <> 0").select("items", "verdict"))
    asked = url_rules.matched(df.where("k % 3 = 0 and verdict is not null and not array_contains(items, 'site:c')"), rules)
    hit, right, n = asked.agg(F.count("mined"), F.sum((F.col("mined") == F.col("verdict")).cast("int")), F.count("*")).first()
    assert hit >= 0.9 * n and right >= 0.95 * hit


def test_no_rule_rests_on_few_urls(spark):
    """Nine URLs of one site that are all blocked make no rule; among many others ninety do."""
    few = [(["site:a", f"path:{i}"], "block") for i in range(9)] + [(["site:b", f"path:{i}"], "allow") for i in range(90)]
    rules = {tuple(r["antecedent"]): r["verdict"] for r in url_rules.mine(spark.createDataFrame(few, "items array<string>, verdict string")).collect()}
    assert rules == {("site:b",): "allow"}


def test_strange_urls(spark):
    long = "http://net/fr/" + "x/" * 50_000
    urls = [long, long, None, "://", "http://", "a://b://c/en/", "http://?q=1", "http://A.COM/\u00c4/\n?x", ""]
    df = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate(urls)] + [(0, long, 1, "z"), (None, "http://x.net/es/", 1, "z")], "page_id long, url string, rule int, mined string")
    got = sorted(map(tuple, url_rules.judge(df).collect()), key=str)
    assert len(got) == len(urls) + 2
    assert [r[3:] for r in got if r[0] == 0] == [("net/fr/", "block")] * 2
    assert [r[1:4] for r in got if r[0] == 7] == [("a.com", "/\u00c4/\n", "com/")]
    assert [r[1:] for r in got if r[0] is None] == [("x.net", "/es/", "net/es/", "block")]
    assert [r[1:3] for r in got if r[0] == 5] == [("b:", "//c/en/")]
