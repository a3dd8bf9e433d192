"""Near-duplicate documents: HyperMinHash sketches, banding, corrected estimates, exact verification.

A document is the set of its distinct ``shingle``-word shingles, A-Z lower-cased; with fewer words
the whole sequence is its one shingle, without words the set is empty and links with nothing.

* One pass sketches every text.  Each of REGISTERS buckets keeps its least hash as a count of
  leading zeros and MANTISSA following bits; an empty bucket borrows from another, by a fixed rule.
* Documents with equal sets are one node from then on.
* BANDS bands of ROWS registers name candidates.  A pair at similarity 0.8 shares no band with
  probability (1 - 0.8**7)**56, below 2e-6.
* Round one tests each node against the least node that it shares a band with.
* Round two looks only at bands whose members are still in different components, so that no link
  that joins two components is lost and none inside a known one is tested.  Bands of up to SMALL
  members name their pairs.  The members of larger bands form families, and a family is compared
  whole, in blocks: each block pair is one task, which counts shared shingles by matrix products and
  lets out one edge for each member at most, never pairs.
* For named pairs the Jaccard estimate, corrected for chance register collisions, drops those six standard
  errors below the threshold; full shingle sets of the two texts decide the rest.

Null ids are never linked and are kept; rows that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import BASE, GRAM, Rolling, U, Words, mix, signed, slices, text_buffers
from quillon.llm.graph import components
from quillon.llm.store import durable, settled

ROWS, BANDS = 7, 56
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Registers that travel with a node for the estimate.
ESTIMATE = 128
#: Bands of more members are compared by families, in blocks of so many.
SMALL, BLOCK = 8, 384
#: Bits of the map of wanted ids.
BITMAP = 1 << 23
#: Two equally large unrelated sets agree in a register with about this probability.
CHANCE = 2.0**-MANTISSA / 3
#: Buckets that an empty one may borrow from before it takes the next filled one.
DONORS = 512
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, registers binary"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(buf, offsets, lower=True)
    hashes = words.hashes()
    grams = Rolling(hashes).grams(shingle)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(Rolling(hashes[a:b]).runs(np.array([0]), np.array([b - a])))
        else:
            out.append(hashes[:0])
    return out


def donors() -> np.ndarray:
    """For every bucket the buckets that it borrows from, in order."""
    n = REGISTERS * DONORS
    return (mix(np.arange(n, dtype=U)) % U(REGISTERS)).astype(np.int64).reshape(REGISTERS, DONORS)


DONOR = donors()


def bucket_minima(shingles: np.ndarray) -> np.ndarray:
    """Least hash of every bucket of a set that is not empty; empty buckets borrow."""
    least = np.full(REGISTERS, EMPTY, dtype=U)
    bucket = (((shingles >> U(32)) * U(REGISTERS)) >> U(32)).astype(np.int64)
    value = mix(shingles ^ GRAM)
    order = np.argsort(value)[::-1]
    least[bucket[order]] = value[order]
    filled = least != EMPTY
    empty = np.flatnonzero(~filled)
    tries = 24
    while len(empty):
        ok = filled[DONOR[empty, :tries]]
        step = ok.argmax(axis=1)
        hit = ok[np.arange(len(empty)), step]
        to, step = empty[hit], step[hit]
        least[to] = least[DONOR[to, step]] + step.astype(U) * BASE
        empty = empty[~hit]
        if tries == DONORS and len(empty):
            known = np.flatnonzero(filled)
            least[empty] = least[known[np.searchsorted(known, empty) % len(known)]] + BASE
            break
        tries = DONORS
    return least


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each hash, in 16 bits."""
    exponent = np.frexp(np.maximum(least, U(1)).astype(np.float64))[1]
    zeros = (64 - exponent).clip(0, 63).astype(U)
    mantissa = ((least << zeros) << U(1)) >> U(64 - MANTISSA)
    return ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key for each band of each row of registers."""
    key = np.broadcast_to((np.arange(BANDS, dtype=U) + U(1)) * GRAM, (len(registers), BANDS))
    for col in registers.reshape(-1, BANDS, ROWS).transpose(2, 0, 1):
        key = mix(key * GRAM + col.astype(U))
    return key


def sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            sets = shingle_sets(buf, offsets[lo : hi + 1], shingle)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            live = n > 0
            first, second = np.zeros((2, len(n)), dtype=U)
            regs = np.zeros((0, REGISTERS), dtype=np.uint16)
            if live.any():
                flat = np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum(n[live])[:-1]])
                first[live] = np.bitwise_xor.reduceat(mix(flat), at)
                second[live] = np.add.reduceat(mix(flat * GRAM), at)
                regs = compressed(np.stack([bucket_minima(s) for s in sets if len(s)]))
            offs = np.concatenate([[0], np.cumsum(live * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offs), signed(band_keys(regs).ravel()))
            sent = iter(regs)
            binary = [next(sent)[:ESTIMATE].tobytes() if x else None for x in live.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), signed(first), signed(second), bands, pa.array(binary, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "registers"],
            )


def estimates(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Jaccard from the shared registers, corrected for chance agreement."""
    a = np.frombuffer(b"".join(one.to_pylist()), dtype=np.uint16).reshape(-1, ESTIMATE)
    b = np.frombuffer(b"".join(two.to_pylist()), dtype=np.uint16).reshape(-1, ESTIMATE)
    return ((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE)


def likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs that the estimate does not rule out; six standard errors of slack."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.minimum(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        slack = 6 * np.sqrt(threshold * (1 - threshold) / np.minimum(size, ESTIMATE))
        keep = estimates(batch.column(4), batch.column(5)) >= threshold - slack
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets reach the threshold, in whole numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sides = [text_buffers(batch.column(i)) for i in (2, 3)]
        weight = np.diff(sides[0][1]) + np.diff(sides[1][1])
        keep = np.zeros(batch.num_rows, dtype=bool)
        for lo, hi in slices(np.concatenate([[0], np.cumsum(weight)])):
            one, two = (shingle_sets(b, o[lo : hi + 1], shingle) for b, o in sides)
            for i, (x, y) in enumerate(zip(one, two, strict=True)):
                both = len(x) + len(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[lo + i] = bool(both) and 100 * shared >= percent * (both - shared)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links.  Estimates first, then whole texts."""
    light = nodes.select(F.col("doc_id").alias("k"), "n_shingles", "registers")
    left = light.select(F.col("k").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = light.select(F.col("k").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    some = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lambda it: likely(it, percent / 100), "a long, b long")
    some = settled(some.distinct())
    full = (
        some.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    return settled(full.mapInArrow(lambda it: verify(it, shingle, percent), "a long, b long").distinct())


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``rows`` shares with each of ``cols``."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, spread = np.unique(flat, return_inverse=True, return_counts=True)
    often = spread > 1
    slot = np.cumsum(often) - 1
    keep = often[code]
    code, owner = slot[code[keep]], owner[keep]
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(slot[-1]) + 1 if len(slot) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        total += part[rows] @ part[cols].T
    return total


def block_links(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """Edges between components inside one pair of blocks of a family."""
    one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
    buf, offsets = text_buffers(pa.array(pdf["text"], pa.large_string()))
    sets = shingle_sets(buf, offsets, shingle)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    rows, cols = np.flatnonzero(pdf["block"] == one), np.flatnonzero(pdf["block"] == two)
    shared = shared_counts(sets, rows, cols).astype(np.int64)
    union = size[rows][:, None] + size[cols][None, :] - shared
    c = pdf["c"].to_numpy()
    linked = (100 * shared >= percent * union) & (c[rows][:, None] != c[cols][None, :])
    root = {x: x for x in c.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    ids = pdf["a"].to_numpy()
    for i, j in np.argwhere(linked):
        x, y = find(int(c[rows[i]])), find(int(c[cols[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[rows[i]]), int(ids[cols[j]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def family_links(crowd: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components among members (band, a, c) of large bands.

    A component that fills a block has blocks of its own, which are not compared with each other: so a large
    group of copies only meets the texts that are not yet in it.  Small components share blocks.
    """
    hubs = crowd.groupBy("band").agg(F.min("a").alias("b"))
    family = components(crowd.join(hubs, "band").select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("family"))
    member = settled(family.join(crowd.select("a", "c").distinct(), "a"))
    sizes = member.groupBy("family", "c").agg(F.count("*").alias("n"))
    full = sizes.where(F.col("n") >= BLOCK).select("family", "c", F.col("c").alias("own"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rest = sizes.where(F.col("n") < BLOCK).groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("shared"))
    placed = member.join(full, ["family", "c"], "left").join(rest, "family", "left")
    at = F.pmod(F.xxhash64("a"), F.coalesce("blocks", "shared"))
    placed = placed.select("a", "c", "family", "own", F.xxhash64(F.coalesce("own", F.lit(-1)), F.col("own").isNull(), at).alias("block"))
    # one entry for each block of a family
    listed = placed.select("family", "own", "block").distinct().groupBy("family").agg(F.collect_list(F.struct("own", "block")).alias("blocks"))
    met = F.filter("blocks", lambda x: F.coalesce(x["own"] != F.col("own"), F.lit(True)))
    dealt = placed.join(listed, "family").withColumn("with", F.explode(F.transform(met, lambda x: x["block"])))
    dealt = dealt.select("family", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "a", "c")
    dealt = dealt.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    return settled(dealt.groupBy("family", "one", "two").applyInPandas(lambda pdf: block_links(pdf, shingle, percent), "a long, b long").distinct())


def among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Drops most texts whose id is not wanted before they are shuffled.

    What is sent is a bitmap of BITMAP hashed ids, never more; where it is too full to tell ids apart
    it only lets more texts through.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    word = wanted.select((at / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {BITMAP}), 32) as int))").alias("b"))
    filled = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITMAP // 32, dtype=np.uint32)
    bits[filled.column(0).to_numpy()] = filled.column(1).to_numpy().astype(np.uint32)
    sent = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((sent.value[h >> 3] >> (h & 7) & 1).astype(bool))).select(["doc_id", "text"])

    return texts.where("doc_id is not null").select(at.alias("at"), "doc_id", "text").mapInArrow(run, "doc_id long, text string")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the least id reachable by links, kept is component_id = doc_id.  Empty table: no
    rows.  Null or empty text: no shingles, linked with nothing.  Very long texts are compared whole.  Rows that
    share an id are one node; of equal sets the least id stands for all.  A null id is kept and has no component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = durable(texts.mapInArrow(lambda it: sketch(it, shingle), SKETCH))
    live = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("head"))
    nodes = live.join(classes.select(F.col("head").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    nodes = nodes.dropDuplicates(["doc_id", "set_a"])
    banded = nodes.select(F.col("doc_id").alias("a"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("a").alias("hub"), F.max("a").alias("last")).where("hub < last").select("band", "hub")
    member = durable(banded.join(shared, "band").select("band", "a", "hub"))
    first = settled(member.where("a > hub").groupBy("a").agg(F.min("hub").alias("b")))
    light = durable(nodes.select("doc_id", "n_shingles", "registers"))
    wanted = settled(member.select(F.col("a").alias("doc_id")).distinct())
    texts = durable(among(texts, wanted).join(wanted, "doc_id", "left_semi"))
    links = confirmed(first, light, texts, shingle, percent)

    known = components(links)
    placed = member.select("band", "a").join(known.withColumnRenamed("node", "a"), "a", "left").select("band", "a", F.coalesce("component", "a").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
    open_ = settled(placed.join(mixed, "band"))
    few = open_.where(F.col("n") <= SMALL)
    other = few.select("band", F.col("a").alias("b"), F.col("c").alias("d"))
    rest = few.join(other, "band").where("c < d").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    rest = settled(rest.join(first, ["a", "b"], "left_anti").select("a", "b"))
    links = links.union(confirmed(rest, light, texts, shingle, percent))
    crowd = open_.where(F.col("n") > SMALL).select("band", "a", "c")
    if crowd.limit(1).count():
        links = links.union(family_links(crowd, texts, shingle, percent))

    same = live.join(classes, ["set_a", "set_b", "n_shingles"]).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    found = components(links.union(same))
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))
