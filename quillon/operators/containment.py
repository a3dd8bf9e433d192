"""Which of very many values stand in which of very many texts: a partitioned index of grams.

Of each value one gram of GRAM bytes is chosen among its first ones, the one that fewest values have, so that what
all e-mail addresses share leads to none of them.  Texts are read once: at each place whose gram may be an anchor, as a
bitmap of fixed size tells, the place leaves with the bytes around it.  Places and anchors meet in a join on the gram,
and a value counts where all its bytes stand.  Values shorter than GRAM are grams of their own length.  No value
reaches the driver, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.checkpoint import durable

U = np.uint64
GRAM = 6
#: Anchors lie among so many bytes at the start of a value.
FRONT = 64
#: Longest values of the classes of lengths; a place carries bytes enough for its class, the last one as many as its longest value has.
REACHES = (64, 1024)
#: Bits of the bitmap of anchors, which is broadcast: 8 MB, however many values there are.
BITS_LOG = 26
#: Bytes whose grams are numbers at a time, of one text or of many, and bytes around places that leave at a time: what a
#: task holds beside the batch that it was given.
SLICE_BYTES, AROUND_BYTES = 500_000, 4_000_000
#: Values whose grams are found at a time.
VALUES = 1_000


def squeezed(text: Column, strip: bool = True) -> Column:
    """Lower-cased without blanks, the form in which values are searched."""
    return F.regexp_replace(F.lower(text), r"\s", "") if strip else text


def spread(gram: np.ndarray) -> np.ndarray:
    """Bit numbers of grams."""
    x = gram * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x >>= U(64 - BITS_LOG)
    return x


def grams(data: np.ndarray, n: int, code: int) -> np.ndarray:
    """The n bytes at each place, with a code of the class of lengths, as one number each."""
    places = max(0, len(data) - n + 1)
    out = np.full(places, code << 56, U)
    for k in range(n):
        out |= data[k : k + places].astype(U) << U(8 * k)
    return out


def code_of(size: Column) -> Column:
    """Short values by their length, others by the class of their length."""
    code = F.lit(GRAM + len(REACHES))
    for k, most in reversed(list(enumerate(REACHES))):
        code = F.when(size <= most, GRAM + k).otherwise(code)
    return F.when(size < GRAM, size).otherwise(code).cast("int")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def front_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gram, off) of each value (id, code, value)."""
    for batch in (whole.slice(i, VALUES) for whole in batches for i in range(0, whole.num_rows, VALUES)):
        ids, offs, found = [], [], []
        for key, code, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = min(code, GRAM)
            own = grams(np.frombuffer(value[: FRONT + n - 1].encode() if isinstance(value, str) else value[: FRONT + n - 1], np.uint8), n, code)[:FRONT]
            own, at = np.unique(own, return_index=True)
            ids += [key] * len(own)
            offs.append(at)
            found.append(own)
        columns = [pa.array(ids, pa.string()), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()), pa.array(np.concatenate(offs) if offs else [], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "gram", "off"])


def anchors(values: DataFrame) -> DataFrame:
    """(id, gram, off, value): of each of the values (id, code, value) the gram in front that fewest have."""
    every = values.mapInArrow(front_grams, "id string, gram long, off long")
    shared = every.groupBy("gram").agg(F.count("*").alias("n"))
    best = every.join(shared, "gram").groupBy("id").agg(F.min(F.struct("n", "off", "gram")).alias("best"))
    return values.join(best, "id").select("id", F.col("best.gram").alias("gram"), F.col("best.off").alias("off"), "value")


def prober(bits: Broadcast, reach: dict[int, int], kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of texts, the last column, that may be anchors: (kept columns, gram, before, around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, U)
        for batch in batches:
            data, ends = bytes_of(batch.column(kept))
            for lo in range(int(ends[0]), int(ends[-1]), SLICE_BYTES):
                yield from places(batch, data, ends, lo, held)
            del batch, data, ends  # before the next one is read

    def places(batch: pa.RecordBatch, data: np.ndarray, ends: np.ndarray, lo: int, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the grams that start in the slice at ``lo``; they and what is around them may end beyond it."""
        for code, most in reach.items():
            n = min(code, GRAM)
            own = grams(data[lo : min(lo + SLICE_BYTES + n - 1, int(ends[-1]))], n, code)
            bit = spread(own)
            at = np.flatnonzero((held[bit >> U(6)] >> (bit & U(63))) & U(1))
            own, at = own[at], at + lo
            row = np.searchsorted(ends, at, side="right") - 1
            inside = at + n <= ends[row + 1]
            own, at, row = own[inside], at[inside], row[inside]
            if code < GRAM and len(at):  # the gram is the value: one place of a text tells
                _, one = np.unique(np.stack([row, own.view(np.int64)]), axis=1, return_index=True)
                own, at, row = own[one], at[one], row[one]
            start = np.maximum(at - FRONT if code >= GRAM else at, ends[row])
            stop = np.minimum(at + most, ends[row + 1])
            sent, i = np.cumsum(stop - start), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(sent, (sent[i - 1] if i else 0) + AROUND_BYTES, side="right")))
                around = [data[a:b].tobytes() for a, b in zip(start[i:j].tolist(), stop[i:j].tolist(), strict=True)]
                columns = [c.take(pa.array(row[i:j])) for c in batch.columns[:kept]]
                more = [pa.array(own[i:j].view(np.int64)), pa.array(at[i:j] - start[i:j], pa.int64()), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names[:kept], "__gram", "__before", "__around"])
                i = j

    return run


def bitmap(found: DataFrame) -> bytes:
    """The bits of all anchors, put together by Spark in words of 64; at most 2^BITS_LOG / 64 of them reach the driver."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spread(batch.column(0).to_numpy(zero_copy_only=False).view(U)).view(np.int64))], ["bit"])

    bit = found.select("gram").mapInArrow(numbered, "bit long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    held = np.zeros(1 << (BITS_LOG - 6), np.int64)
    held[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return held.tobytes()


def contained(needles: DataFrame, haystack: DataFrame, needle: str, body: str, on: list[str] | None = None, strip: bool = True) -> DataFrame:
    """Pairs (columns of the haystack but the body, columns of the needles but the needle) whose needle stands in the body.

    Both are compared lower-cased and without blanks if ``strip``; null and empty needles and bodies match nothing.  Rows of
    the haystack that are equal in all columns count once.  With keys ``on`` the sides are joined on these.
    """
    sought = needles.withColumn(needle, squeezed(F.col(needle), strip)).where(F.length(needle) > 0)
    inside = haystack.withColumn(body, squeezed(F.col(body), strip)).where(F.length(body) > 0)
    if on:
        return inside.join(sought, on).where(F.col(body).contains(F.col(needle))).drop(body, needle)
    kept, named = [c for c in haystack.columns if c != body], [c for c in needles.columns if c != needle]
    marked = sought.withColumn("__id", F.sha2(needle, 256))
    values = marked.groupBy("__id").agg(F.first(needle).alias("value"))  # equal digests, equal values
    values = values.select(F.col("__id").alias("id"), code_of(F.octet_length("value")).alias("code"), F.col("value").cast("binary").alias("value"))
    lengths = {r["code"]: r["most"] for r in values.groupBy("code").agg(F.max(F.octet_length("value")).alias("most")).collect()}
    if not lengths:
        return haystack.select(*kept).join(sought.select(*named), F.lit(False))
    found = durable(anchors(values))  # for the bitmap and the join
    bits = haystack.sparkSession.sparkContext.broadcast(bitmap(found))
    rows = inside.select(*kept, F.xxhash64(body).alias("__text"), body)
    schema = rows.drop(body).schema.add("__gram", "long").add("__before", "long").add("__around", "binary")
    hits = rows.mapInArrow(prober(bits, {c: min(n, c) if c < GRAM else n for c, n in lengths.items()}, len(kept) + 1), schema)
    there = F.substring("__around", (F.col("__before") - F.col("off") + 1).cast("int"), F.octet_length("value")) == F.col("value")
    met = hits.join(found, hits["__gram"] == found["gram"]).where((F.col("__before") >= F.col("off")) & there)
    pairs = met.select(*kept, "__text", "id").distinct()
    return pairs.join(marked.select(*named, F.col("__id").alias("id")), "id").select(*kept, *named)
