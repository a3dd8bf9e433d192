"""Long repeated spans: compaction of the word de Bruijn graph in minimiser buckets.

Edges are windows of ``span`` words; nodes are the ``anchor``-word k-mers inside.  Each window goes
to the bucket of its least k-mer hash, so equal windows share a bucket.  Consecutive windows of one
bucket form a path, sent as one row with the hash of its whole word sequence.

* A bucket that only one document visits, or whose visitor is its least document, has nothing
  to remove and stops at the first join.
* Paths of equal content are nonbranching copies of each other: later documents lose the whole path.
* Where a bucket branches (several contents), the first holder of each content is expanded to its
  edges, and edges with an earlier holder are marked.
* Rolling hashes only propose.  The first holder's words are read again at their source coordinates; a mark
  carries a digest of their bytes, and words are removed only where those at the marked coordinates have the
  same one.
* Marked source coordinates go back to their documents, and the covered words are removed.

Counts are combined before every shuffle and no group is gathered, so a passage in a third of all
documents costs what any other does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.llm.arrays import Rolling, Words, signed, slices, sliding_min, text_buffers
from quillon.llm.store import durable, swept

SPAN, ANCHOR = 50, 15
#: ``at`` packs the first window and how many follow, as paths are the largest table that is kept.
PATHS = "bucket long, path long, doc_id long, variant long, at long"
PACK = 1 << 31
#: Windows by the digest of their words.  A row that starts at WHOLE is a path instead, and its digest stands in ``variant``.
EDGES = "bucket long, edge long, doc_id long, variant long, start int"
WHOLE = -1
#: A run of n windows; its words have the digest, or are known to be right if that is null.
MARK = ("start", "n", "digest")


def window_buckets(hashes: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """For each window of ``span`` words its least k-mer hash."""
    return sliding_min(Rolling(hashes).grams(anchor), span - anchor + 1)


def paths(batches: Iterator[pa.RecordBatch], span: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffers(batch.column(2))
        for lo, hi in slices(offsets):
            words = Words(buf, offsets[lo : hi + 1])
            hashes = words.hashes()
            doc, start, end, bucket = [], [], [], []
            least = window_buckets(hashes, span, anchor)
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if b - a < span:
                    continue
                own = least[a : b - span + 1]
                cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                doc.append(np.full(len(cut) - 1, i))
                start.append(cut[:-1] + a)
                end.append(cut[1:] + a)
                bucket.append(own[cut[:-1]])
            if not doc:
                continue
            doc, start, end, bucket = (np.concatenate(x) for x in (doc, start, end, bucket))
            content = Rolling(hashes).runs(start, end + span - 1)
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays(
                [signed(bucket), signed(content), batch.column(0).take(take), batch.column(1).take(take), pa.array((start - words.first[doc]) * PACK + (end - start))],
                names=["bucket", "path", "doc_id", "variant", "at"],
            )


class Source:
    """The words of one text joined by single blanks, for digests of runs of words."""

    def __init__(self, own: list[bytes]):
        self.joined = b" ".join(own)
        self.begin = np.cumsum([0, *(len(w) + 1 for w in own)])

    def digest(self, start: int, end: int) -> int:
        """Signed 64 bits of the bytes of the words."""
        x = xxhash.xxh3_64_intdigest(self.joined[self.begin[start] : self.begin[end] - 1])
        return x - (1 << 64) if x >> 63 else x


def edges(batches: Iterator[pa.RecordBatch], span: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, variant, text, spans → the digest of each span that is asked whole, and every window of
    those to be expanded."""
    for batch in batches:
        buf, offsets = text_buffers(batch.column(2))
        spans = batch.column(3)
        for lo, hi in slices(offsets):
            words = Words(buf, offsets[lo : hi + 1])
            raw = words.buf.tobytes()
            hashes = words.hashes()
            least = window_buckets(hashes, span, anchor)
            doc, at, edge, variant, start = [], [], [], [], []
            own = batch.column(1).to_pylist()
            for i in range(hi - lo):
                source = Source(raw[words.offsets[i] : words.offsets[i + 1]].split())
                first = int(words.first[i])
                for x in spans[lo + i].as_py():
                    begin, n = divmod(x["at"], PACK)
                    if x["whole"]:
                        at.append(begin + first)
                        edge.append(x["path"])
                        variant.append(source.digest(begin, begin + n + span - 1))
                        start.append(WHOLE)
                    if x["expand"]:
                        at += range(begin + first, begin + first + n)
                        edge += [source.digest(k, k + span) for k in range(begin, begin + n)]
                        variant += [own[lo + i]] * n
                        start += range(begin, begin + n)
                doc += [lo + i] * (len(at) - len(doc))
            if not doc:
                continue
            yield pa.RecordBatch.from_arrays(
                [signed(least[np.array(at)]), pa.array(edge, pa.int64()), batch.column(0).take(pa.array(doc)), pa.array(variant, pa.int64()), pa.array(start, pa.int32())],
                names=["bucket", "edge", "doc_id", "variant", "start"],
            )


def verified(own: list[bytes], marks: list[dict], span: int) -> list[dict]:
    """The marks whose words are those that the first holder has."""
    source = Source(own)
    return [m for m in marks if m["digest"] is None or source.digest(m["start"], m["start"] + m["n"] + span - 1) == m["digest"]]


def covered(n_words: int, spans: list[dict] | None, span: int) -> np.ndarray:
    """Which words lie in a marked window; ``spans`` lists first windows and how many follow."""
    depth = np.zeros(n_words + 1, dtype=np.int64)
    if spans:
        start = np.array([x["start"] for x in spans])
        stop = start + np.array([x["n"] for x in spans]) + span - 1
        np.add.at(depth, start, 1)
        np.add.at(depth, stop, -1)
    return np.cumsum(depth[:-1]) > 0


def removed(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, spans → doc_id, n_words, n_removed, kept text (null only if nothing goes)."""
    for batch in batches:
        buf, offsets = text_buffers(batch.column(1))
        spans = batch.column(2)
        for lo, hi in slices(offsets):
            words = Words(buf, offsets[lo : hi + 1])
            raw = words.buf.tobytes()
            n_words, n_removed, digest, kept = [], [], [], []
            for i in range(hi - lo):
                own = raw[words.offsets[i] : words.offsets[i + 1]].split()
                marks = spans[lo + i].as_py()
                if marks:
                    gone = covered(len(own), verified(own, marks, span), span)
                    left = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                else:
                    left = own
                joined = b" ".join(left)
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "replace") if marks else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


@F.pandas_udf(StringType())
def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without the words of its marked windows, joined by single blanks."""
    out = []
    for text, marks in zip(texts, spans, strict=True):
        own = (text or "").encode().split()
        gone = covered(len(own), verified(own, [] if marks is None else list(marks), SPAN), SPAN)
        out.append(b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def repeated_spans(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, variant, start, n, digest): runs of n windows that also start in a document with a smaller id.

    ``docs`` has doc_id, variant, text; variant tells apart rows that share an id.
    """
    rows = docs.where("doc_id is not null")
    path = rows.select("doc_id", "variant", "text").mapInArrow(lambda it: paths(it, span, anchor), PATHS)
    shared = path.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("bucket", "least")
    live = durable(path.select("bucket", "path", "doc_id", "variant", "at").join(shared.select("bucket"), "bucket", "left_semi"))
    swept(docs.sparkSession)
    holder = live.groupBy("bucket", "path").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # a bucket whose paths do not all begin with its least document branches; of one content there is nothing to expand
    least = holder.groupBy("bucket").agg(F.min("first").alias("least"), F.max("first").alias("most")).select("bucket", (F.col("least") < F.col("most")).alias("branches"), "least")
    asked = holder.join(least, "bucket").select("bucket", "path", "first", (F.col("last") > F.col("first")).alias("whole"), "branches")
    leads = live.join(asked.where("whole or branches"), ["bucket", "path"]).where("doc_id = first")
    todo = leads.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("at", "whole", F.col("branches").alias("expand"), "path")).alias("spans"))
    edge = rows.join(todo, ["doc_id", "variant"]).select("doc_id", "variant", "text", "spans").mapInArrow(lambda it: edges(it, span, anchor), EDGES)
    edge = durable(edge)
    swept(docs.sparkSession)
    read = edge.where(F.col("start") == WHOLE).groupBy("bucket", F.col("edge").alias("path")).agg(F.min("doc_id").alias("first"), F.min("variant").alias("digest"))
    start, n = F.floor(F.col("at") / PACK).cast("int").alias("start"), F.pmod("at", F.lit(PACK)).cast("int").alias("n")
    whole = live.join(read, ["bucket", "path"]).where("doc_id > first").select("doc_id", "variant", start, n, "digest")
    # windows were read at their source on both sides
    window = edge.where(F.col("start") != WHOLE)
    early = window.groupBy("bucket", "edge").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("bucket", "edge", "first")
    single = window.join(early, ["bucket", "edge"]).where("doc_id > first")
    return whole.union(single.select("doc_id", "variant", "start", F.lit(1).alias("n"), F.lit(None).cast("long").alias("digest")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, one row for each row of ``docs``.

    Removes each word covered by a ``span``-word window whose word sequence also starts in a document
    with a smaller id, judged on the input.  Null or empty text: no words.  Rows that share an id are
    one document and do not dedup each other; ``variant``, a 64-bit hash of the text, tells them apart.  A null
    id is never compared.  Very long texts are read whole, a text at a time.  Empty table: no rows.
    kept_text is null where nothing was removed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("variant"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(rows, span, anchor)
    marks = spans.groupBy("doc_id", "variant").agg(F.collect_list(F.struct(*MARK)).alias("spans"))
    full = rows.join(marks, ["doc_id", "variant"], "left").select("doc_id", "text", "spans")
    return full.mapInArrow(lambda it: removed(it, span), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
