"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text of at most CHUNK characters is pre-tokenised and encoded where it lies.  A longer one, once for all its copies:

1. is cut into chunks that overlap by OVERLAP characters; chunks are dealt over all tasks and pre-tokenised each by itself;
2. is stitched: a match depends on nothing to its left, so once two neighbours share a boundary in their overlap they agree
   from there on.  The first one shared is a cut.  Boundaries of a chunk are sure from the cut it begins with, or else from
   its first change of class (to white space, from letters, from digits), where every reading has a boundary.  Where a
   match is longer than the overlap no boundary is shared, and that piece goes on to the next cut.  No cut follows
   white space, for how that is read depends on what comes after it;
3. is cut there into pieces, which are dealt over all tasks again, encoded, and their ids put in order.

Each match is encoded by itself, by ``tiktoken``'s merges of its bytes; frequent matches are looked up.  Decoding
concatenates the bytes of the ids.  What is sent to all workers is the rank file alone, a parameter of the model.

Defined results: null counts as empty and has no ids; repeated rows are encoded alike; an empty table gives no rows;
further columns are not read.  Decoding null, or an id that the ranks do not have, gives null.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import slices, text_buffers

CHUNK, OVERLAP = 65_536, 256
#: A boundary so near to the end of a cut text is not sure: a contraction or a blank may go on.
MARGIN = 4
#: Matches looked up at most, and the longest of them.
KNOWN, KNOWN_CHARS = 100_000, 32
#: Rows decoded at a time.
ROWS = 1024
TURN = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")

BLANK = regex.compile(r"\s")


def ranks_of(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 text and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


_models: dict[tuple[int, str], Model] = {}


class Model:
    """Pattern and merges in one worker."""

    def __init__(self, raw: bytes, pattern: str):
        self.raw, self.pattern = raw, pattern
        self.match = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    @cached_property
    def merges(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks_of(self.raw), special_tokens={})

    @cached_property
    def token(self) -> dict[int, bytes]:
        return {rank: token for token, rank in ranks_of(self.raw).items()}

    def encode(self, text: str, out: array) -> None:
        known = self.known
        for match in self.match.findall(text):
            ids = known.get(match)
            if ids is None:
                ids = self.merges._encode_single_piece(match)
                if len(match) <= KNOWN_CHARS:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[match] = ids
            out.extend(ids)


class Shared:
    """The model of a rank file, made once in each worker."""

    def __init__(self, raw: Broadcast, pattern: str):
        self.raw, self.pattern = raw, pattern

    def __call__(self) -> Model:
        at = (hash(self.raw.value), self.pattern)
        if at not in _models:
            _models[at] = Model(self.raw.value, self.pattern)
        return _models[at]


def few(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows a few megabytes of the column at a time."""
    _, offsets = text_buffers(batch.column(column))
    for a, b in slices(offsets):
        yield batch.slice(a, b - a)


def encoder(model: Shared, keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first columns and turns the text after them into ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for batch in (part for whole in batches for part in few(whole, keys)):
            ids, ends = array("i"), [0]
            for text in batch.column(keys):
                m.encode(text.as_py() or "", ids)
                ends.append(len(ids))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], found], [*batch.schema.names[:keys], "ids"])

    return run


def chunked(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                at = range(0, len(text), chunk)
                parts = [text[s : s + chunk + overlap] for s in at]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(parts)), pa.array(at, pa.int64()), pa.array(parts)], ["digest", "start", "part"])

    return run


def boundaries(model: Shared, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(digest, start, head, tail, sure) of chunks: boundaries in the overlap with the chunk before and after, and from
    where on they are sure whatever stands before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for batch in batches:
            heads, tails, sure = [], [], []
            for start, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ends = np.fromiter((0, *(x.end() for x in m.match.finditer(part))), np.int64)
                heads.append(ends[ends < overlap] + start)
                near = ends[(ends >= chunk) & (ends <= len(part) - MARGIN)]
                tails.append(np.array([start + e for e in near if not BLANK.match(part[e - 1])], np.int64))
                turn = TURN.search(part, 1)
                sure.append(None if turn is None else start + turn.start())
            kind = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind), pa.array(sure, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "start", "head", "tail", "sure"])

    return run


def stitched(chunks: list[tuple[int, list[int], list[int], int | None]]) -> list[int]:
    """Cuts of one text from (start, head, tail, sure) of its chunks in order."""
    cuts, trusted = [], 0
    for (_, _, tail, _), (_, head, _, sure) in zip(chunks, chunks[1:], strict=False):
        shared = [] if trusted is None else [b for b in sorted({*tail} & {*head}) if b >= trusted]
        if shared:
            cuts.append(shared[0])
        trusted = shared[0] if shared else sure
    return cuts


def cuts_of(chunks: pd.Series) -> pd.Series:
    return chunks.map(lambda c: stitched([(x["start"], list(x["head"]), list(x["tail"]), None if x["sure"] is None or x["sure"] != x["sure"] else int(x["sure"])) for x in c]))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, piece, part) from (digest, text, cuts)."""
    for batch in batches:
        for digest, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = [0, *cuts, len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts)], ["digest", "piece", "part"])


def shared_model(df: DataFrame, path: str, pattern: str) -> Shared:
    with open(path, "rb") as f:
        return Shared(df.sparkSession.sparkContext.broadcast(f.read()), pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and ids of every row, by the ranks in ``path``; ``overlap`` is less than ``chunk``."""
    model = shared_model(docs, path, pattern)
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    is_long = F.length("text") > chunk
    short = rows.where(~is_long).mapInArrow(encoder(model, 1), f"__key {kind}, ids array<int>")
    long = rows.where(is_long).withColumn("digest", F.sha2("text", 256))
    texts = long.groupBy("digest").agg(F.first("text").alias("text"))  # equal digests, equal texts
    parts = texts.mapInArrow(chunked(chunk, overlap), "digest string, start long, part string").repartition("digest", "start")
    found = parts.mapInArrow(boundaries(model, chunk, overlap), "digest string, start long, head array<long>, tail array<long>, sure long")
    cut = texts.join(stitch(found), "digest").select("digest", "text", "cuts").mapInArrow(pieces, "digest string, piece long, part string").repartition("digest", "piece")
    coded = cut.mapInArrow(encoder(model, 2), "digest string, piece long, ids array<int>")
    whole = coded.groupBy("digest").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    joined = long.select("__key", "digest").join(whole, "digest").select("__key", "ids")
    return short.unionByName(joined).withColumnRenamed("__key", key)


def stitch(found: DataFrame) -> DataFrame:
    """(digest, cuts) from the boundaries of all chunks."""
    chunks = found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "head", "tail", "sure"))).alias("chunks"))
    return chunks.select("digest", F.pandas_udf(cuts_of, "array<long>")("chunks").alias("cuts"))


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with the bytes of ``ids`` in place of them."""
    model = shared_model(rows, path, "")
    rest = [f"`{c}`" for c in rows.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = model().token
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            out = []
            for held in batch.column(batch.num_columns - 1):
                found = list(map(token.get, held.values.to_pylist())) if held.is_valid else None
                out.append(None if found is None or None in found else b"".join(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], name])

    schema = rows.select(*rest).schema.add(name, "binary")
    return rows.select(*rest, f"`{ids}`").mapInArrow(run, schema)


def joined_ids(ids: Column) -> Column:
    """Decimal ids between commas."""
    return F.array_join(ids.cast("array<string>"), ",")
