"""The corpus pipeline against brute force on a small fixture."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402


def words(rng, n):
    return [rng.choice(["tha", "ore", "sti", "nad", "uli"]) + rng.choice(["ren", "so", "mik", "tal"]) + rng.choice(["", "x", "yo", "zu"]) for _ in range(n)]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 80)
        bad = i % 6 == 0
        if bad:
            for k in range(4):
                w[k * 9] = rng.choice(["grobnik", "vilefoo", "zurghle"])
        rows.append([i, " ".join(w), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(bad)))
    item = " ".join(words(rng, 30))
    passage = " ".join(words(rng, 60))
    rows.append([1001, rows[1][1] + " end", "en", "s0", 0])
    rows.append([1002, " ".join(words(rng, 30)) + " " + item + " " + " ".join(words(rng, 20)), "en", "s1", 0])
    rows.append([1003, " ".join(words(rng, 90)) + "\n" + passage, "en", "s1", 0])
    rows.append([1004, passage + "\n" + " ".join(words(rng, 90)), "en", "s2", 0])
    rows += [[1005, None, None, None, None], [1006, "", "en", "s2", 0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r[0] for r in rows if not (r[0] < 240 and r[0] % 6 == 0)}
    assert set(seen["toxicity"]) == clean
    assert set(seen["near_dedup"]) == clean - {1001}
    cut = seen["substring_dedup"]
    assert set(cut) == clean - {1001}
    assert passage in cut[1003]["text"] and "\n" in cut[1003]["text"]
    assert cut[1004]["text"] == " ".join(rows[-3][1].split()[60:]) and cut[1004]["n_chars"] == len(cut[1004]["text"])
    assert cut[1005]["text"] is None
    assert set(seen["decontamination"]) == clean - {1001, 1002}
    mix = seen["mix"]
    assert set(mix) <= set(seen["decontamination"]) and len(mix) > 60
    for s in ("s0", "s1", "s2"):
        own = [r for r in mix.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.03 * own[0]["target"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mix)


def test_near_dedup_compares_runs_of_five_words(spark, tmp_path):
    rng = random.Random(5)
    # distinct words, so that every replaced word costs two runs of two words and five of five
    text = [f"{w}{i}" for i, w in enumerate(words(rng, 100))]
    edited = [f"new{i}" if i in (20, 40, 60, 80) else w for i, w in enumerate(text)]
    rows = [(1, " ".join(text)), (2, " ".join(edited)), (3, " ".join(text) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loose = corpus_pipeline.near_minhash.near_duplicates(docs).where("kept").select("doc_id").collect()
    assert {r["doc_id"] for r in loose} == {1}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == {1, 2}


def test_contaminated_documents_without_an_id_go(spark, tmp_path):
    rng = random.Random(9)
    item, clean = " ".join(words(rng, 30)), " ".join(words(rng, 60))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, clean + " " + item), (None, clean), (1, item), (2, clean), (3, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.where("text is null or text = '" + clean + "'").collect()))


CLASHES = "tag source_size target taken copies row doc id of variant spans start n __id __nth __row __variant __other __spans __part item_id held_out score text_ component_id kept band".split() + ["a.b", "doc.text", "a blank", "a`tick"]


def write_side_tables(spark, tmp_path, item="none of these words stands anywhere"):
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_further_columns_pass_every_stage(spark, tmp_path):
    rng = random.Random(3)
    write_side_tables(spark, tmp_path)
    texts = [" ".join(words(rng, 70)) for _ in range(8)]
    texts[6] = texts[5][:-20] + " " + texts[2]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        own = [c for c in CLASHES if name != "mix" or c not in ("source_size", "target", "taken", "copies")]
        for r in got.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in own)
        assert set(got.columns) == set(docs.columns) and (name == "mix" or got.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeated_rows_nulls_and_nothing(spark, tmp_path):
    rng = random.Random(4)
    write_side_tables(spark, tmp_path)
    texts = [" ".join(words(rng, 70)) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [rows[0]] * 40 + [(0, texts[1], "en", "s1", 3), (None, None, None, None, None), (None, texts[3], None, None, 1), (9, "w " * 300_000, "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mix = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    want = {}
    for r in corpus_pipeline.cube_mix.mix(docs).collect():
        want[r["doc_id"], r["size"]] = want.get((r["doc_id"], r["size"]), 0) + r["copies"]
    got = {}
    for r in mix.collect():
        key = r["doc_id"], len(r["text"].split())
        got[key] = got.get(key, 0) + r["copies"]
    assert got == {k: n for k, n in want.items() if n}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
