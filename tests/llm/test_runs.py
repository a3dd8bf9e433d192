"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import periodic_runs as R
from quillon.llm.queries import op12_periodic_runs, repeated


def brute(x, least=12):
    """Each period by itself: stretches on which it holds; the least period of a stretch counts."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    n, kinds = rng.randint(0, 110), rng.choice([1, 2, 3, 9, 200])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        p, s = rng.randint(1, n // 3 + 1), rng.randrange(n)
        words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
    return words


def test_runs_of_sequences(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = random.Random(1)
    for _ in range(1500):
        x = [int(w[1:]) for w in random_words(rng)]
        least = rng.choice([12, 6, 2])
        assert R.maximal_runs(x, least) == brute(x, least)


def test_long_sequences():
    n = 60_000
    assert R.maximal_runs([1] * n) == [(0, n, 1)]
    assert R.maximal_runs([i % 7000 for i in range(n)]) == [(0, n, 7000)]
    assert R.maximal_runs(list(range(n))) == []


def test_texts_of_a_batch():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.03 else rng.choice([" ", "  ", "\t\n"]).join(random_words(rng)) for _ in range(1500)] + ["", " \n", "é ö " * 40, "a b " * 20]
    for text, got in zip(texts, R.found_in(pa.array(texts)).to_pylist(), strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
        assert got["collapsed"] == collapsed(words, want) and got["n_words"] == len(words)


def test_rows_of_any_table(spark):
    rows = [(1, "a b " * 9, "x"), (1, "a b " * 9, "x"), (None, None, "y"), (3, "", None), (4, "c " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("a.b", F.lit(1)).withColumn("n_words", F.lit("z"))
    got = sorted(map(str, [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in R.periodic_runs(docs).collect()]))
    assert got == sorted(map(str, [(1, 18, [(0, 18, 2)], "a b")] * 2 + [(None, 0, [], ""), (3, 0, [], ""), (4, 30_000, [(0, 30_000, 1)], "c")]))
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_query_over_given_documents(spark):
    """Every document short enough for brute force, and of all others that runs hold and are maximal."""
    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, folder).collect()}
    assert set(got) == set(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = {r[0]: r[1] for r in repeated(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    n_runs = 0
    for doc, text in texts.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert [w.decode() for w in (planted[doc] or "").encode().split()] == words
        if len(words) > 1500:
            continue
        runs = brute(words)
        n_runs += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))
        assert tuple(got[doc][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
    assert n_runs > 10
