"""Toxicity, language model, quality, embeddings, HTML and URLs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import metric_join, ppm, quality_ordinal, toxicity
from quillon.llm.arrays import text_buffers

CLEAN = [f"{a}{b}" for a in ("tha", "ore", "sti", "nad", "uli") for b in ("ren", "so", "mik", "tal", "ver", "one")]
TOXIC = ["grobnik", "vilefoo", "zurgh", "snarl"]


def labelled(n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) + (rng.choice(CLEAN) if rng.random() < 0.3 else "") for _ in range(rng.randint(20, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(TOXIC)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    want = {i: y for i, _, y in rows}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in want)
    right = sum(got[i]["predicted"] == want[i] for i in held)
    assert right >= 0.95 * len(held)
    assert got[9000]["score"] == got[9001]["score"] == got[9002]["score"] < 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "q"), (2, None, "q")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def reference_ppm(counts, cut, text):
    """log10 probability by the definition: pruned counts, escape method C, exclusion."""
    order = ppm.ORDER
    data = bytes([ppm.PAD] * order) + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + bytes([ppm.END])
    total = 0.0
    for at in range(order, len(data)):
        excluded: set[int] = set()
        done = False
        for j in range(order, -1, -1):
            node = counts[j].get(data[at - j : at], {})
            kept = {s: n for s, n in node.items() if n >= cut}
            if not kept:
                continue
            escape = len(kept) + sum(node.values()) - sum(kept.values())
            live = {s: n for s, n in kept.items() if s not in excluded}
            width = sum(live.values()) + escape
            if data[at] in live:
                total += math.log10(live[data[at]] / width)
                done = True
                break
            total += math.log10(escape / width)
            excluded = set(kept)
        if not done:
            total -= math.log10(max(1, ppm.ALPHABET - len([1 for n in counts[0].get(b"", {}).values() if n >= cut])))
    return total


@pytest.mark.parametrize("nodes", [1 << 20, 150])
def test_language_model(spark, nodes):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sät", "on", "mat."]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "zebra quux"), (3, rows[3][1])]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), nodes=nodes).collect()
    assert len(got) == len(rows)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    words = Counter()
    counts = [dict() for _ in range(ppm.ORDER + 1)]
    for t in train:
        words.update(low(t).split())
        words["end"] += 1
        data = bytes([ppm.PAD] * ppm.ORDER) + low(t) + bytes([ppm.END])
        for at in range(ppm.ORDER, len(data)):
            for j in range(ppm.ORDER + 1):
                node = counts[j].setdefault(data[at - j : at], Counter())
                node[data[at]] += 1
    n_all, kinds = sum(words.values()), len(words)
    cut = 1
    for j in range(ppm.ORDER + 1):
        flat = sorted((n for node in counts[j].values() for n in node.values()), reverse=True)
        if len(flat) > nodes:
            cut = max(cut, flat[nodes] + 1)
    text = dict(rows)
    for r in got:
        own = low(text[r["doc_id"]]).split()
        tokens = [words[w] for w in own] + [words["end"]]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(c > 0 for c in tokens) and r["train_tokens"] == n_all
        assert abs(r["base_score"] - sum(math.log10((c + 1) / (n_all + kinds + 1)) for c in tokens)) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert abs(r["score"] - reference_ppm(counts, cut, text[r["doc_id"]] or "")) < 1e-6
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string, word string")).count() == 0


def test_language_model_keeps_every_gram(spark, monkeypatch):
    rng = random.Random(12)
    letters = "".join(chr(c) for c in range(33, 127) if not 65 <= c <= 90)
    rows = [(i, "".join(rng.choices(letters, k=20_000))) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    trained = [r for r in got.values() if not r["held_out"]]
    assert len(trained) * 20_000 > 1 << 20
    # nearly every context of five bytes was seen once, with one symbol: one half each
    assert all(abs(r["score"] / (20_000 * math.log10(2)) + 1) < 0.02 for r in trained)
    few = docs.where("doc_id < 5")
    whole = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    monkeypatch.setattr(ppm, "SENT_GRAMS", 64)
    joined = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    assert all(abs(joined[i] - whole[i]) < 1e-6 for i in whole)


def test_quality(spark):
    rng = random.Random(6)
    rows, rated = [], []
    for i in range(400):
        grade = i % 3
        words = [rng.choice(CLEAN) for _ in range(40)]
        for _ in range((2 - grade) * 8):
            words[rng.randrange(40)] += "%%%"
        rows.append((i, " ".join(words)))
        rated.append((i, grade, 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(rated, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_ordinal.quality(docs, labels).collect()}
    held = [i for i, *_ in rated if got[i]["held_out"]]
    mean = [np.mean([got[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert mean[0] + 0.5 < mean[1] < mean[2] - 0.3
    assert np.mean([got[i]["kept"] == (i % 3 >= 1) for i in held]) > 0.95
    assert got[900]["expected_grade"] == got[901]["expected_grade"]
    model = quality_ordinal.fit([(t, g) for (_, t), (_, g, _) in zip(rows, rated, strict=True)])
    assert (np.diff(model.thresholds) > 0).all()
    flat = quality_ordinal.quality(docs, labels.where("quality = 1")).collect()
    assert {r["expected_grade"] for r in flat} == {1.0}
    assert quality_ordinal.quality(docs.limit(0), labels.limit(0)).count() == 0


def brute_links(rows, threshold=0.93):
    ok = [(i, lb, np.array(v, float)) for i, v, lb in rows if lb is not None and v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), {i: i for i, *_ in ok}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, la, x), (j, lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in up}


@pytest.mark.parametrize("block,fan", [(5, 3), (16, 64), (2048, 64)])
def test_metric_join_is_exact(spark, block, fan):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = rng.normal(size=8)
        for _ in range(20):
            rows.append((len(rows) * 2, (base + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.4])).tolist(), int(c % 3)))
    rows += [(5001, None, 1), (5003, [0.0] * 8, 1), (5005, [1.0, None] + [0.0] * 6, 1), (5007, [float("nan")] * 8, 1), (5009, rows[0][1], None), (5011, [1.0, 2.0], 1), (5013, [2.0, 4.0], 1), (5015, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in metric_join.metric_links(df, block=block, fan=fan).collect()}
    want = {i: (0, i) for i, *_ in rows} | brute_links(rows)
    assert got == want and sum(n for n, _ in want.values()) > 100
    assert metric_join.metric_links(df.limit(0)).count() == 0


def test_links_of_very_large_and_very_small_vectors(spark):
    rows = [(1, "a", [1e200, 0.0]), (2, "a", [1e200, 1e196]), (3, "a", [1e-200, 0.0]), (4, "a", [3e-310, 1e-314]), (5, "a", [0.0, 1e308])]
    got = metric_join.metric_links(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_ordinal_fit_follows_the_likelihood():
    """Fine grades as many as texts, and weights that raise the likelihood of a straightforward sum over texts."""
    import math

    rng = random.Random(4)
    rows = []
    for i in range(24):
        g = i % 3
        rows.append((" ".join(rng.choice(["bad", "poor"] if g == 0 else ["fair", "plain"] if g == 1 else ["good", "fine"]) for _ in range(12)), float(g)))
    rows = sorted(set(rows))
    buf, offsets = text_buffers(pa.array([t for t, _ in rows]))

    def likelihood(model):
        above = model.above(buf, offsets)
        total = 0.0
        for (_, g), a in zip(rows, above, strict=True):
            k = model.grades.index(g)
            total += math.log(max(1e-12, (1.0 if k == 0 else a[k - 1]) - (0.0 if k == len(a) else a[k])))
        return total

    fits = [quality_ordinal.fit(rows, steps=n) for n in (0, 10, 40, 150)]
    scores = [likelihood(m) for m in fits]
    assert scores == sorted(scores) and scores[-1] > -4 > scores[0]
    best = fits[-1]
    assert list(best.thresholds) == sorted(best.thresholds)
    many = quality_ordinal.fit([(f"w{i} w{i % 7}", i / 3) for i in range(400)], steps=5)
    assert len(many.grades) == 400 and len(many.thresholds) == 399


@pytest.mark.parametrize("dim", [2, 3, 64])
def test_near_pivots_lose_no_link(spark, dim):
    """Clusters whose points lie 1e-9 to 1e-5 apart, around the edge of the radius, cut by pivots among them."""
    rng = np.random.default_rng(dim)
    rows = []
    for label, gap in enumerate((1e-9, 1e-8, 5e-8, 1e-7, 1e-6, 1e-5)):
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        edge = math.acos(0.93)
        for turn in (0.0, gap, 2 * gap, edge - 3 * gap, edge - gap, edge + 2 * gap, edge + 3 * gap, 2 * edge - gap):
            for _ in range(2):
                t = turn + gap * rng.normal() / 10
                rows.append((len(rows), (math.cos(t) * a + math.sin(t) * b).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in metric_join.metric_links(df, block=2, fan=2).collect()}
    assert got == {i: (0, i) for i, *_ in rows} | brute_links(rows)


def test_cells_cover_every_partner():
    """Crafted: whatever pivots are taken, a point visits the cell of each partner within the radius."""
    radius = math.sqrt(2 - 2 * 0.93)
    for dim in (2, 5, 64):
        for gap in (2e-6, 1e-5, 1e-3, 0.1):
            rng = np.random.default_rng(dim)
            base = metric_join.unit(rng.normal(size=(1, dim)))
            x = metric_join.unit(base + rng.normal(size=(300, dim)) * radius / math.sqrt(dim) * 0.7)
            pivots = metric_join.apart(metric_join.unit(base + rng.normal(size=(6, dim)) * gap))
            nearest, visit = metric_join.cells_of(x, pivots, radius)
            near = metric_join.distances(x, x) <= radius
            assert all(visit[i, nearest[j]] for i, j in np.argwhere(near))
    assert len(metric_join.apart(np.array([[1.0, 0.0], [1.0, 1e-7], [0.0, 1.0]]))) == 2


def test_metric_join_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 1, 9, 9), (1, [1.0, 0.0], 1, 9, 9), (2, [1.0, 0.1], 1, 9, 9), (None, [1.0, 0.0], 1, 9, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, point int, cell int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in metric_join.metric_links(df).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, True)]
    wide = spark.createDataFrame([(1, [1.0] * 50_000, 1), (2, [1.0] * 49_999 + [2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in metric_join.metric_links(wide).collect()] == [1, 1]


def test_fractions_are_grades_of_their_own(spark):
    docs = spark.createDataFrame([(i, ("low " if i % 2 else "high ") * 20 + f"w{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2.1 if i % 2 else 2.9) for i in range(80)] + [(3, float("nan")), (4, None)], "doc_id long, quality double")
    rows = [tuple(r) for r in toxicity.labelled_sample(docs, labels, labels["quality"], 10).collect()]
    assert {y for _, y in rows} == {2.1, 2.9} and len(rows) == 20
    got = quality_ordinal.quality(docs, labels, tail=2.5).collect()
    assert {r["kept"] for r in got if r["doc_id"] % 2 == 0} == {True} and {r["kept"] for r in got if r["doc_id"] % 2} == {False}
    assert all(2.1 <= r["expected_grade"] <= 2.9 for r in got)


def test_samples_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(60)] + [(1, "z" * 50), (2, None)], "doc_id long, text string, ".rstrip(", "))
    labels = spark.createDataFrame([(i, float(i)) for i in range(60)] + [(1, 1.0)], "doc_id long, quality double")
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 70)
    rows = [tuple(r) for r in toxicity.labelled_sample(docs, labels, labels["quality"], 5).collect()]
    assert 0 < len(rows) <= 20 and sum(len(t) for t, _ in rows) <= 70


def test_verdicts_equal_a_straightforward_coder():
    """Every window coded under both dictionaries, which share nothing but what both classes' texts do."""
    rows = [(t, int(y)) for _, t, y in labelled(400)]
    pair = toxicity.train(rows[:300])
    ordinary, toxic = toxicity.Coder(pair.ordinary), toxicity.Coder(pair.toxic)
    texts = [t for t, _ in rows[250:]] + ["", "grobnik", "GROBNIK vilefoo tharen", "grobn vilef zur"]
    words = {w for t in texts for w in toxicity.windows(t)} | {f" {a[:k]}{b[k:]} ".encode() for a in TOXIC for b in CLEAN for k in range(1, 5)}
    near = {w: w not in pair.ordinary and any(w[i : i + toxicity.RUN] in pair.toxic for i in range(len(w) - toxicity.RUN + 1)) for w in words}
    like = {w: near[w] and ordinary.cost(w) - toxic.cost(w) >= pair.margin for w in words}
    assert {w for w in words if pair.like(w)} == {w for w in words if like[w]} and any(like.values())
    for t in texts:
        own = toxicity.windows(t)
        assert pair.features(t) == (sum(like[w] for w in own), len(own))


def test_a_long_labelled_text_leaves_the_others(spark, monkeypatch):
    """Wherever an oversize text ranks, all texts that fit are in the sample."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    keys = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in keys], "doc_id long, quality double")
    for big in keys[::5]:
        docs = spark.createDataFrame([(i, "z" * 2000 if i == big else f"word{i}") for i in keys], "doc_id long, text string")
        rows = toxicity.labelled_sample(docs, labels, labels["quality"], 100).collect()
        assert sorted(r["text"] for r in rows) == sorted(f"word{i}" for i in keys if i != big)


def test_models_on_odd_tables(spark):
    long = "tha ore " * 200_000
    docs = spark.createDataFrame([(1, long, 1, 2, 3), (1, long, 1, 2, 3), (None, "tha", 1, 2, 3), (2, None, 1, 2, 3), (3, "", 1, 2, 3)], "doc_id long, text string, score int, variant int, label int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (toxicity.toxicity(docs, labels), quality_ordinal.quality(docs, labels), ppm.score(docs)):
        rows = sorted((str(r["doc_id"]), str(r)) for r in got.collect())
        assert [r[0] for r in rows] == ["1", "1", "2", "3", "None"] and rows[0] == rows[1]


def test_long_words_are_known_by_digest(spark):
    ruler = "-" * 500
    docs = spark.createDataFrame([(i, f"{ruler} word{i} {ruler}x") for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in (ruler, f"word{i}", ruler + "x", None))
    n, v = sum(count.values()), len(count)
    for i, r in got.items():
        own = [count[w] for w in (ruler, f"word{i}", ruler + "x", None)]
        assert (r["train_tokens"], r["n_known"]) == (n, sum(c > 0 for c in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in own))


def test_words_of_arrow_slices():
    col = pa.array(["a b", None, "c"]).slice(1, 2)
    buf, off = toxicity_buffers(col)
    assert len(off) == 3


def toxicity_buffers(col):
    from quillon.llm.arrays import text_buffers

    return text_buffers(col)
