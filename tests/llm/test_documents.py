"""Near duplicates, substring dedup, decontamination and the mix against brute force."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import cube_mix, decontaminate, near_minhash, substring_dedup
from quillon.llm.arrays import PUNCT, Rolling, Words, sliding_min, text_buffers
from quillon.llm.graph import components
from quillon.llm.store import settled

WORDS = [f"w{i}" for i in range(400)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(60, 140))] for _ in range(12)]
    docs = [" ".join(b) for b in base]
    for b in base[:5]:
        docs += [" ".join(edited(rng, b, rng.randint(0, 14))) for _ in range(30)]
    passage = " ".join(rng.choice(WORDS) for _ in range(70))
    docs += [" ".join(rng.choice(WORDS) for _ in range(40)) + "\n" + passage + "\t" + " ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(25)]
    docs += ["x " * 300, "x " * 260, "", None, " \n", "one", "ONE", "one two", "One  Two", docs[0], docs[0].upper()]
    docs += [" ".join(rng.choice(WORDS) for _ in range(9000))]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def shingles(text):
    w = [lower(x) for x in (text or "").encode().split()]
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_minhash, "BLOCK", 16)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_minhash.near_duplicates(df).collect()}
    want = brute_components(corpus)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, band string, a int"
    assert near_minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", "z", 1), (None, "a b c", "z", 1), (4, "a b c", "z", 1), (4, "a b c", "z", 1), (2, "a  B\tc", None, None), (9, None, "q", 0)]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]


def brute_spans(rows, span=50):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - span + 1):
            k = tuple(w[j : j + span])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if first[tuple(w[j : j + span])] < i:
                gone[j : j + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in substring_dedup.substring_dedup(df).collect()}
    want = brute_spans(corpus)
    assert got == want
    assert sum(n for v in want.values() for _, n, _ in v) > 1000


def test_substring_dedup_edges(spark):
    schema = "doc_id long, text string, spans string, bucket int"
    assert substring_dedup.substring_dedup(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"t{i}" for i in range(60))
    rows = [(5, t, "", 1), (5, "q " + t, "", 1), (7, t, "", 1), (None, t, "", 1), (8, None, None, None)]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 60, 0), (5, 60, 0), (5, 61, 0), (7, 60, 60), (8, 0, 0)]


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain_words(text):
    buf, off = text_buffers(__import__("pyarrow").array([text or ""]))
    w = Words(buf, off, space=PUNCT, lower=True)
    return [w.word(i) for i in range(len(w))]


def test_only_equal_words_are_removed():
    """Two documents marked alike, of which one has other words there: it keeps them."""
    rng = random.Random(23)
    same = [rng.choice(WORDS) for _ in range(60)]
    texts = ["\t".join(same), " ".join(rng.choice(WORDS) for _ in range(60))]
    digest = substring_dedup.Source(" ".join(same).encode().split()).digest(0, 60)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": texts, "spans": [[{"start": 0, "n": 11, "digest": digest}]] * 2})
    (out,) = substring_dedup.removed([batch], 50)
    assert out["n_removed"].to_pylist() == [60, 0]


def test_substring_dedup_of_long_and_clashing_rows(spark):
    rng = random.Random(29)
    long = " ".join(rng.choice(WORDS) for _ in range(120_000))
    rows = [(1, long, "a", 1), (2, long + " end", "a", 1), (3, None, "a", 1), (None, long, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, variant int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: (120_000, 0), 2: (120_001, 120_000), 3: (0, 0), None: (120_000, 0)}


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_decontamination_finds_all_within_budget(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", most)  # items sent whole, or joined by piece
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate((3, 5, 9, 12, 20, 37, 59))] + [(50, None), (51, ""), (52, "!!")]
    docs = []
    for i in range(60):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        if i % 2:
            words = (items[rng.randrange(7)][1]).split()
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(words))
                words[p : p + 1] = rng.choice([[], [rng.choice(WORDS)], [words[p], "zz"]])
                words = words or ["zz"]
            body[len(body) // 2 : len(body) // 2] = words
        docs.append((i, ", ".join(body).upper() if i % 3 else " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminations(d, b).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            a, w = plain_words(item), plain_words(t)
            if not a:
                continue
            budget = max(0, len(a) // 5 - 1)
            dist = semi_global(a, w)
            if dist <= budget and (len(a) >= 5 or dist == 0):
                want[(i, k)] = dist
    assert got == want and len(want) > 15


def test_many_items_take_one_scan(spark, monkeypatch):
    """Thousands of items, some of them repeated, give the same rows sent or joined; joined, no item reaches the driver."""
    rng = random.Random(21)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40)))) for k in range(3000)]
    items += items[:5]
    docs = [(i % 90, " ".join([rng.choice(WORDS) for _ in range(20)] + edited(rng, items[rng.randrange(3000)][1].split(), rng.randint(0, 3)) + [rng.choice(WORDS) for _ in range(20)])) for i in range(120)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    sent = sorted(map(tuple, decontaminate.contaminations(d, b).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    monkeypatch.setattr(decontaminate, "Items", None)
    got = decontaminate.contaminations(d, b)
    assert sorted(map(tuple, got.collect())) == sent and len(sent) > 100
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Union" not in plan and "Cartesian" not in plan and plan.count("MapInArrow") == 2


def test_decontamination_empty(spark):
    d = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, item_id int")
    assert decontaminate.contaminations(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.contaminations(d.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = []
    for s, n in (("b", 700), ("a", 60), ("é", 5), (None, 40), ("c", 300), ("z", 1)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(0, 200)), s, i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    one = {r["doc_id"]: r for r in cube_mix.mix(df).collect()}
    two = {r["doc_id"]: r["taken"] for r in cube_mix.mix(df.repartition(7)).collect()}
    assert {k: r["taken"] for k, r in one.items()} == two
    sizes = Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * sizes[s]]
        for s in full or list(free):
            target[s] = 3.0 * sizes[s] if full else weight[s] * level
            left -= target[s]
            free.discard(s)
    taken = Counter()
    for i, t, s, _ in rows:
        r = one[i]
        assert r["size"] == len(t.split()) and r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r["taken"]
    for s in ("a", "b", "c", None):
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], s


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert cube_mix.mix(spark.createDataFrame([], schema)).count() == 0
    got = cube_mix.mix(spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a")], schema)).collect()
    assert [r["taken"] for r in got] == [0, 0, 0]


def test_flight_keeps_totals():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        size = [float(rng.choice([1, 5, 5, 80, rng.randint(1, 1000)])) for _ in range(n)]
        p = [rng.random() for _ in range(n)]
        q = cube_mix.fly(size, list(p), list(range(n)))
        assert sum(0 < x < 1 for x in q) <= 2
        assert abs(sum(q) - sum(p)) < 1e-6 * n + 1e-6
        assert abs(sum(s * x for s, x in zip(size, q, strict=True)) - sum(s * x for s, x in zip(size, p, strict=True))) < 1e-4 * n + 1e-4


def test_large_groups_meet_only_the_rest(spark, monkeypatch):
    """Two large groups of near copies and strays between them: no link is lost, no group is compared with itself."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(2):
        base = [word() for _ in range(60)]
        for _ in range(40):
            own = list(base)
            own[rng.randrange(60)] = word()
            rows.append((len(rows), " ".join(own)))
        far = list(base)
        for _ in range(6):
            far[rng.randrange(60)] = word()
        rows += [(len(rows) + i, " ".join([*far, word()])) for i in range(5)]
    want = brute_groups(rows)
    monkeypatch.setattr(near_minhash, "BLOCK", 8)
    monkeypatch.setattr(near_minhash, "SMALL", 2)
    seen = []
    plain = near_minhash.family_links
    monkeypatch.setattr(near_minhash, "family_links", lambda *a: seen.append(1) or plain(*a))
    got = {r["doc_id"]: r["component_id"] for r in near_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and seen


def brute_groups(rows):
    sets = {i: {tuple(w[k : k + 2]) for w in [t.split()] for k in range(len(w) - 1)} for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_decontamination_odd_tables(spark):
    item = "one two three four five six seven eight nine ten"
    long = "filler " * 300_000 + item
    docs = spark.createDataFrame([(1, long, "z", 1), (1, long, "z", 1), (None, item, "z", 1), (2, None, "z", 1), (3, "", "z", 1)], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminations(docs, bench).collect())
    assert got == Counter({(1, 7, 0): 4, (None, 7, 0): 2, (1, None, 0): 2, (None, None, 0): 1})


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (301, 302), (302, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got[i] for i in range(61)) == {0} and got[200] == 100 and got[302] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_size_estimates_of_rounds_stay_small(spark):
    up = settled(spark.range(40).select(F.col("id").alias("v"), F.greatest(F.col("id") - 1, F.lit(0)).alias("p")))
    for _ in range(8):  # each round joins the table to itself, and so would square its estimate
        jump = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
        up = settled(up.join(jump, "p").select("v", F.col("q").alias("p")))
        assert up._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert {tuple(r) for r in up.collect()} == {(i, 0) for i in range(40)}


def test_array_primitives():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\t\x0b\x0c\rcé ") for _ in range(rng.randint(0, 70))) for _ in range(200)] + [None, ""]
    buf, off = text_buffers(__import__("pyarrow").array(texts))
    w = Words(buf, off)
    seen = {}
    hashes = w.hashes()
    for i, t in enumerate(texts):
        own = [w.word(j) for j in range(w.first[i], w.first[i + 1])]
        assert own == (t or "").encode().split()
    for j in range(len(w)):
        assert seen.setdefault(w.word(j), hashes[j]) == hashes[j]
    assert len(set(seen.values())) == len(seen)
    grams = Rolling(hashes).grams(3)
    assert (sliding_min(grams, 9) == [grams[i : i + 9].min() for i in range(len(grams) - 8)]).all()


def test_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3)], "doc_id long, text string, source string, taken int").withColumn("n_words", F.lit(7)).withColumn("component_id", F.lit("x"))
    assert substring_dedup.substring_dedup(df).count() == near_minhash.near_duplicates(df).count() == cube_mix.mix(df).count() == 1
