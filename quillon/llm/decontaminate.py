"""Benchmark decontamination: pigeonhole pieces and Myers bit-parallel distance, over words.

Texts are compared as words of letters and digits, A-Z lower-cased, punctuation as white space.  An
item of n words may differ by k = n // piece - 1 word edits (insertions, deletions, replacements; at
least 0).  It is cut into k + 1 pieces, so that in any passage within k edits of it one piece
stands unchanged (pigeonhole).  Every exact hit of a piece's first words in a document is checked in
a window around it with Myers' bit-parallel distance.

Items of at most ITEM_BYTES in all are sent to the workers, and documents are only scanned.  More of them stay in
Spark: their pieces are rows, of which a bitmap of fixed size is sent; one scan of the documents lets those places
go whose words may begin a piece, with the words around them, and places and pieces are joined by their words' digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import PUNCT, Rolling, U, Words, mix, signed, slices, text_buffers
from quillon.llm.store import durable

PIECE = 5
#: Items of so many bytes are sent whole; the bitmap of the pieces of more has 2^BITS_LOG bits, 32 MB.
ITEM_BYTES = 8_000_000
BITS_LOG = 28
PIECE_ROWS = "row long, item_id long, codes array<long>, budget int, probe int, key long, offset int"
HITS = "doc_id long, item_id long, distance int, n_words int, start_word int, end_word int"


class Items:
    """Benchmark items, their word codes and the index of their pieces."""

    def __init__(self, items: list[tuple[int, str]], piece: int):
        buf, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        words = Words(buf, offsets, space=PUNCT, lower=True)
        hashes = words.hashes()
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        self.ids = [i for i, _ in items]
        self.codes = [codes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.budget = [max(0, len(c) // piece - 1) for c in self.codes]
        self.masks: list[dict[int, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, c in enumerate(self.codes):
            mask: dict[int, int] = {}
            for at, w in enumerate(c.tolist()):
                mask[w] = mask.get(w, 0) | 1 << at
            self.masks.append(mask)
            if not len(c):
                continue
            pieces = self.budget[i] + 1
            cuts = [len(c) * j // pieces for j in range(pieces + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                probe = min(piece, b - a)
                key = Rolling(c[a : a + probe].astype(U) + U(1)).runs(np.array([0]), np.array([probe]))[0]
                found.setdefault(probe, []).append((int(key), i, int(a)))
        self.index = {}
        for probe, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], dtype=U)
            self.index[probe] = np.unique(keys), keys, [r[1:] for r in rows]


def closest(mask: dict[int, int], n: int, text: list[int], budget: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any run of ``text``, and where the run ends (Myers 1999)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, best_end = budget + 1, -1
    for j, w in enumerate(text):
        eq = mask.get(w, 0)
        x = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = (down | ~(x | up)) & full
        minus = up & x
        if score < best:
            best, best_end = score, j + 1
    return (best, best_end) if best <= budget else None


def scan(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    vocabulary = items.vocabulary
    for batch in batches:
        buf, offsets = text_buffers(batch.column(1))
        rows: list[tuple] = []
        for lo, hi in slices(offsets):
            words = Words(buf, offsets[lo : hi + 1], space=PUNCT, lower=True)
            if not len(words) or not len(vocabulary):
                continue
            hashes = words.hashes()
            at = np.searchsorted(vocabulary, hashes).clip(max=len(vocabulary) - 1)
            code = np.where(vocabulary[at] == hashes, at, -1)
            roll = Rolling((code + 1).astype(U))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            done: set[tuple[int, int, int]] = set()
            for probe, (unique, keys, where) in items.index.items():
                grams = roll.grams(probe)
                if not len(grams):
                    continue
                slot = np.searchsorted(unique, grams).clip(max=len(unique) - 1)
                hits = np.flatnonzero(unique[slot] == grams)
                docs = np.searchsorted(words.first, hits, side="right") - 1
                hits = hits[hits + probe <= words.first[docs + 1]]
                docs = np.searchsorted(words.first, hits, side="right") - 1
                left = np.searchsorted(keys, grams[hits])
                right = np.searchsorted(keys, grams[hits], side="right")
                for pos, d, a, b in zip(hits.tolist(), docs.tolist(), left.tolist(), right.tolist(), strict=True):
                    for item, offset in where[a:b]:
                        if (d, item, pos - offset) in done:
                            continue
                        done.add((d, item, pos - offset))
                        n, k = len(items.codes[item]), items.budget[item]
                        first, last = int(words.first[d]), int(words.first[d + 1])
                        begin, stop = max(first, pos - offset - k), min(last, pos - offset + n + k)
                        got = closest(items.masks[item], n, code[begin:stop].tolist(), k)
                        if got is None:
                            continue
                        end = begin - first + got[1]
                        mark = (got[0], max(0, end - n), end)
                        if (d, item) not in best or mark < best[(d, item)]:
                            best[(d, item)] = mark
            ids = batch.column(0)
            for (d, item), (distance, start, end) in best.items():
                rows.append((ids[lo + d].as_py(), items.ids[item], distance, len(items.codes[item]), start, end))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "n_words", "start_word", "end_word"])


def spread(key: np.ndarray, probe: int) -> np.ndarray:
    """Bit numbers of pieces' digests."""
    return mix(key ^ U(probe * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - BITS_LOG)


def piece_rows(piece: int):
    """(row, item_id, codes, budget, probe, key, offset) of the pieces of items (row, item_id, text); codes are digests of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf, offsets = text_buffers(pa.array([text], pa.large_string()))
                codes = Words(buf, offsets, space=PUNCT, lower=True).hashes()
                n, k = len(codes), max(0, len(codes) // piece - 1)
                roll = Rolling(codes)
                cuts = [n * j // (k + 1) for j in range(k + 2)] if n else []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    probe = min(piece, hi - lo)
                    key = roll.runs(np.array([lo]), np.array([lo + probe]))[0]
                    rows.append((row, item, codes.view(np.int64), k, probe, key.astype(np.int64), lo))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECE_ROWS.split(", ")])

    return run


def place_rows(bits: Broadcast, reach: dict[int, int]):
    """(place columns) of documents (doc, doc_id, text): words that may begin a piece, and those around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, U)
        for batch in batches:
            buf, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                words = Words(buf, offsets[lo : hi + 1], space=PUNCT, lower=True)
                codes = words.hashes()
                roll, signed_codes = Rolling(codes), codes.view(np.int64)
                for probe, most in reach.items():
                    grams = roll.grams(probe)
                    bit = spread(grams, probe)
                    at = np.flatnonzero((held[bit >> U(6)] >> (bit & U(63))) & U(1))
                    own = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + probe <= words.first[own + 1]
                    at, own = at[inside], own[inside]
                    begin, stop = np.maximum(words.first[own], at - most), np.minimum(words.first[own + 1], at + most)
                    around = pa.array([signed_codes[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], pa.list_(pa.int64()))
                    first = pa.array(begin - words.first[own], pa.int64())
                    columns = [batch.column(0).take(pa.array(lo + own)), batch.column(1).take(pa.array(lo + own)), pa.array(np.full(len(at), probe), pa.int32()), pa.array(grams[at].view(np.int64)), pa.array(at - begin, pa.int64()), first, around]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "probe", "key", "at", "first", "around"])

    return run


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, row, item_id, distance, n_words, start_word, end_word) of joined places and pieces that are within the budget."""
    for batch in batches:
        rows = []
        for doc, doc_id, at, first, around, row, item, codes, k, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(codes)
            begin, stop = max(0, at - offset - k), min(len(around), at - offset + n + k)
            mask: dict[int, int] = {}
            for i, w in enumerate(codes):
                mask[w] = mask.get(w, 0) | 1 << i
            got = closest(mask, n, around[begin:stop], k)
            if got is not None:
                end = first + begin + got[1]
                rows.append((doc, doc_id, row, item, got[0], n, max(0, end - n), end))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.int32()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "doc_id", "row", "item_id", "distance", "n_words", "start_word", "end_word"])


def bitmap(pieces: DataFrame) -> bytes:
    """The bits of all pieces, put together by Spark; at most 2^BITS_LOG / 64 words of them reach the driver."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, probe = batch.column(1).to_numpy(zero_copy_only=False).view(U), batch.column(0).to_numpy(zero_copy_only=False)
            bit = np.concatenate([spread(key[probe == p], int(p)) for p in np.unique(probe)]) if len(key) else key
            yield pa.RecordBatch.from_arrays([signed(bit)], ["bit"])

    bit = pieces.select("probe", "key").distinct().mapInArrow(numbered, "bit long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    held = np.zeros(1 << (BITS_LOG - 6), np.int64)
    held[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return held.tobytes()


def joined(rows: DataFrame, items: DataFrame, piece: int) -> DataFrame:
    """As a scan with all items at hand, for any number of them."""
    numbered = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    pieces = durable(numbered.mapInArrow(piece_rows(piece), PIECE_ROWS))
    reach = {r["probe"]: r["n"] for r in pieces.groupBy("probe").agg(F.max(F.size("codes") + F.col("budget")).alias("n")).collect()}  # probes are ``piece`` at most
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(pieces))
    docs = rows.where("text is not null").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    places = docs.mapInArrow(place_rows(bits, reach), "doc long, doc_id long, probe int, key long, at long, first long, around array<long>")
    met = places.join(pieces, ["probe", "key"]).select("doc", "doc_id", "at", "first", "around", "row", "item_id", "codes", "budget", "offset")
    hits = met.mapInArrow(verified, "doc long, doc_id long, row long, item_id long, distance int, n_words int, start_word int, end_word int")
    best = hits.groupBy("doc", "row").agg(F.min(F.struct("distance", "start_word", "end_word", "n_words", "doc_id", "item_id")).alias("b"))
    return best.select("b.doc_id", "b.item_id", "b.distance", "b.n_words", "b.start_word", "b.end_word")


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, item_id, distance, n_words, start_word, end_word: documents that hold a passage within
    the item's edit budget, with the best place for each pair.

    Null or empty texts and items match nothing; ties go to the earliest place; repeated rows report
    each for itself, and so do repeated items; a null doc_id is reported as null; very long texts are scanned whole.  Items under ``piece`` words match only exactly,
    so an item of one word matches every document that holds it.  Empty tables: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > ITEM_BYTES:
        return joined(rows, items, piece)
    few = [tuple(r) for r in items.collect()]
    if not few:
        return docs.sparkSession.createDataFrame([], HITS)
    sent = docs.sparkSession.sparkContext.broadcast(Items(few, piece))
    return rows.mapInArrow(lambda batches: scan(batches, sent.value), HITS)
