"""Byte-level BPE against tiktoken over whole texts."""

import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import functions as F

from quillon.llm import byte_bpe as B
from quillon.llm.queries import op13_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=B.ranks_of(f.read()), special_tokens={})


def texts():
    rng = random.Random(6)
    alphabet = ["a", "Z", "é", "ß", "字", "1", "٣", " ", " ", "\n", "\t", " ", "​", "'", "'s", "'ll", "'re", ".", "-", "🙂", "\x1c", "\x00", "ab", "the "]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    some += ["x" * 900, " " * 900, "é" * 500 + " " + "7" * 500, "." * 700 + "'s" * 200, "a " * 300 + "b" * 500 + " c" * 300, "'" * 300 + "re" * 300, "\n" * 301 + "x", "<|endoftext|> hi"]
    return some


def test_ids_are_those_of_whole_texts(spark):
    """Chunks of 64 characters, of 150 and whole texts, with matches that are longer than an overlap or a chunk."""
    whole, given = reference(), [*texts(), "", None, "x y", "x y"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, ids string").withColumn("a.b", F.lit(1)).withColumn("digest", F.lit(1))
    want = {i: whole.encode_ordinary(t or "") for i, t in enumerate(given)}
    for chunk, overlap in ((64, 16), (150, 40), (B.CHUNK, B.OVERLAP)):
        coded = B.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap)
        assert {r[0]: list(r[1]) for r in coded.collect()} == want
        back = B.decode(coded, PATH)
        assert {r[0]: bytes(r[1]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(given)}


def test_cuts_are_boundaries_of_the_whole_text():
    match, many = regex.compile(P.PATTERN), 0
    for text in texts():
        chunk, overlap = 50, 12
        parts = [(s, text[s : s + chunk + overlap]) for s in range(0, len(text), chunk)]
        found = []
        for s, part in parts:
            ends = [0, *(m.end() for m in match.finditer(part))]
            turn = B.TURN.search(part, 1)
            found.append((s, [s + e for e in ends if e < overlap], [s + e for e in ends if chunk <= e <= len(part) - B.MARGIN and not part[e - 1].isspace()], turn and s + turn.start()))
        cuts = B.stitched(found)
        many += len(cuts)
        assert set(cuts) <= {m.end() for m in match.finditer(text)}
    assert many > 300


def test_copies_of_long_texts_and_empty_tables(spark):
    text = "word " * 100
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = B.encode(docs, PATH, P.PATTERN, chunk=60, overlap=20)
    assert sorted((str(r[0]), len(r[1])) for r in got.collect()) == [("1", 101), ("1", 101), ("2", 0), ("None", 101)]
    assert B.decode(B.encode(docs.limit(0), PATH, P.PATTERN), PATH).count() == 0


def test_unknown_ids_and_null_give_null(spark):
    rows = spark.createDataFrame([(1, [64, 10**6]), (2, None), (3, []), (4, [None])], "k long, ids array<int>")
    got = {r["k"]: r["decoded"] for r in B.decode(rows, PATH).collect()}
    assert got[1] is None and got[2] is None and bytes(got[3]) == b"" and got[4] is None


def test_query_over_given_documents(spark):
    folder, whole = "/root/testdata/sf0.001", reference()
    want = {}
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = whole.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in op13_byte_bpe(spark, folder).collect()} == want
