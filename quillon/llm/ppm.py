"""Language-model scoring by partial matching, and a word base line.

The model is a byte-context trie of orders 0 to ORDER, pretrained on the training documents.  A byte is
coded in its longest known context; where that context has not seen it, an escape is paid and the
next shorter context codes it with the symbols already ruled out excluded (PPM with escape method C and
full exclusion; counts pruned from a node stay in its escape count).  The last resort is a uniform
choice among the symbols order 0 has not seen.  Byte 0xFF, which UTF-8 never holds, ends a text, and
0xFE pads the context before its start, so every document has a proper probability.

Counts come from one distributed aggregation over all texts and stay in distributed tables, all grams
of all orders whatever their number.  A position's probability depends on its context and symbol alone,
so it is worked out once for each distinct gram of any text, by joins with the tables of each order.
Grams that make at least 1 / SENT_GRAMS of all positions are at most SENT_GRAMS many and their
probabilities go to every worker; the probabilities of all other positions are joined.

Word counts of the base line are aggregated the same way.  Words with at least N / FREQUENT of all
tokens are at most FREQUENT many and go to every worker; counts of all other words are joined.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import LOWER, mix, slices, text_buffers
from quillon.llm.store import durable
from quillon.llm.toxicity import held_out

ORDER = 5
#: Probabilities sent to every worker are at most so many.
SENT_GRAMS = 1 << 22
FREQUENT = 1 << 18
#: Longer words are known by a digest, so that every key is short.
KEY_BYTES = 64
END, PAD = 0xFF, 0xFE
ALPHABET = 256
#: Grams of so many symbols are counted together before they leave a worker.
BATCH_SYMBOLS = 4_000_000
END_WORD = b"\n"
LOG2_10 = np.log2(10)


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ORDER pads before and one end after each text; where each text begins."""
    size = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
    out = np.full(starts[-1], PAD, dtype=np.uint8)
    raw = LOWER[buf[offsets[0] : offsets[-1]]]
    shift = np.repeat(starts[:-1] + ORDER - (offsets[:-1] - offsets[0]), size)
    out[np.arange(len(raw)) + shift] = raw
    out[starts[1:] - 1] = END
    return out, starts


def grams(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-ORDER context and symbol of every coded position, packed in 48 bits."""
    wide = out.astype(np.uint64)
    code = np.zeros(len(out) - ORDER, dtype=np.uint64)
    for i in range(ORDER + 1):
        code = (code << np.uint64(8)) | wide[i : len(wide) - ORDER + i]
    keep = out[ORDER:] != PAD
    return code[keep]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of (text, held_out) rows: how often in training texts, and how often in all."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        marked, n = every[first], np.diff(first, append=len(every))
        trained = np.where(marked & np.uint64(1), 0, n)
        gram = (marked >> np.uint64(1)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(trained.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n", "times"])

    for batch in batches:
        buf, offsets = text_buffers(batch.column(0))
        out_of_training = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        for lo, hi in slices(offsets, 1_000_000):
            code = grams(*symbols(buf, offsets[lo : hi + 1]))
            code <<= np.uint64(1)
            code |= np.repeat(out_of_training[lo:hi], np.diff(offsets[lo : hi + 1]) + 1)
            held.append(code)
            size += len(code)
            if size >= BATCH_SYMBOLS:
                yield flush()
                size = 0
    if held:
        yield flush()


def word_key(word: bytes) -> bytes:
    """The word itself, or if it is long a blank and its digest, which no word equals."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.blake2b(word, digest_size=16).digest()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts; one END_WORD, which no word equals, for each text."""
    count: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        buf, offsets = text_buffers(batch.column(0))
        for lo, hi in slices(offsets):
            low = LOWER[buf[offsets[lo] : offsets[hi]]]
            at = offsets[lo : hi + 1] - offsets[lo]
            # a text boundary may touch: set texts apart
            apart = np.insert(low, at[1:-1], 0x20) if hi - lo > 1 else low
            count.update(map(word_key, apart.tobytes().split()))
            count[END_WORD] += hi - lo
            if len(count) > 300_000:
                yield flush()
                count.clear()
    if count:
        yield flush()


class Sent:
    """log10 probabilities of frequent grams."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.logp = gram[order].astype(np.uint64), logp[order].astype(float)
        self.index: tuple[np.ndarray, np.ndarray, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each packed position, 0 where it is not sent; and where that is."""
        if self.index is None:
            self.index = table(self.gram)
        if not len(self.gram):
            return np.zeros(len(code)), np.arange(len(code))
        slot = look(self.index, code)
        return np.where(slot >= 0, self.logp[slot], 0.0), np.flatnonzero(slot < 0)


def table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open-addressing index of sorted distinct keys."""
    bits = max(4, int(2 * len(keys) + 1).bit_length())
    mask = (1 << bits) - 1
    where = np.full(mask + 1, -1, dtype=np.int32)
    slot = (mix(keys) & np.uint64(mask)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        free = where[slot[todo]] < 0
        where[slot[todo[free]]] = todo[free]
        lost = where[slot[todo]] != todo
        todo = todo[lost]
        slot[todo] = (slot[todo] + 1) & mask
    return keys, where, mask


def look(index: tuple[np.ndarray, np.ndarray, int], wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key, or -1."""
    keys, where, mask = index
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    slot = (mix(wanted) & np.uint64(mask)).astype(np.int64)
    out = where[slot].astype(np.int64)
    bad = np.flatnonzero((out >= 0) & (keys[out] != wanted))
    while len(bad):
        slot[bad] = (slot[bad] + 1) & mask
        out[bad] = where[slot[bad]]
        bad = bad[(out[bad] >= 0) & (keys[out[bad]] != wanted[bad])]
    return out


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach; from a histogram of counts."""
    histogram = counts.groupBy("n").agg(F.count("*").alias("rows"))
    total = counts.agg(F.count("*"), F.max("n")).first()
    if total[0] <= most:
        return 1
    lo, hi = 1, int(total[1]) + 1
    histogram = durable(histogram)
    while hi - lo > 1:  # rows with count >= hi fit, those with count >= lo do not
        mid = (lo + hi) // 2
        fits = (histogram.where(F.col("n") >= mid).agg(F.sum("rows")).first()[0] or 0) <= most
        lo, hi = (lo, mid) if fits else (mid, hi)
    return hi


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, as arrays."""
    t = df.toArrow()
    return [t.column(i).to_numpy() for i in range(t.num_columns)]


def low_bytes(c: str, n: int) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def probabilities(counted: DataFrame, nodes: int | None = None) -> DataFrame:
    """gram, times, logp: the log10 probability of every distinct gram in ``counted`` (gram, n, times).

    All counts of all orders are kept; a caller may bound the nodes of an order by ``nodes``, and then the least
    count that fits every order holds for all.
    """
    orders, cut = [], 1
    for j in range(ORDER, -1, -1):
        own = counted.where("n > 0").select("gram", "n") if j == ORDER else orders[0].groupBy(low_bytes("gram", j + 1).alias("gram")).agg(F.sum("n").alias("n"))
        orders.insert(0, own if j == ORDER else durable(own))
        if nodes is not None:
            cut = max(cut, least_count(own, nodes))
    kept = [own.where(F.col("n") >= cut) for own in orders]
    fits = F.col("n") >= cut
    live = counted.select("gram", "times", F.lit(0.0).alias("logp"), F.lit(0.0).alias("less"))
    done = []
    for j in range(ORDER, -1, -1):
        context = F.shiftrightunsigned("gram", 8).alias("context")
        node = orders[j].groupBy(context).agg(F.sum("n").alias("all"), F.sum(F.when(fits, F.col("n"))).alias("kept"), F.count(F.when(fits, 1)).alias("kinds")).where("kinds > 0")
        node = node.select("context", (F.col("kinds") + F.col("all") - F.col("kept")).alias("escape"), (F.col("kinds") + F.col("all")).alias("width"))
        if j:
            # what the shorter context loses when this node's symbols are excluded
            shorter = kept[j - 1].select(F.col("gram").alias("shorter"), F.col("n").alias("m"))
            lost = kept[j].join(shorter, low_bytes("gram", j) == F.col("shorter")).groupBy(context).agg(F.sum("m").alias("lost"))
            node = node.join(lost, "context")
        else:
            node = node.withColumn("lost", F.lit(0))
        seen = kept[j].select(F.col("gram").alias("own"), "n")
        asked = live.withColumn("context", F.shiftrightunsigned(low_bytes("gram", j + 1), 8)).join(node, "context", "left")
        asked = durable(asked.join(seen, low_bytes("gram", j + 1) == F.col("own"), "left"))
        width = F.col("width") - F.col("less")
        done.append(asked.where("n is not null").select("gram", "times", (F.col("logp") + F.log10(F.col("n") / width)).alias("logp")))
        escaped = F.coalesce(F.log10(F.col("escape") / width), F.lit(0.0))
        live = asked.where("n is null").select("gram", "times", (F.col("logp") + escaped).alias("logp"), F.coalesce(F.col("lost").cast("double"), F.lit(0.0)).alias("less"))
    # the symbols that order 0 has not seen share the rest evenly
    unseen = max(1, ALPHABET - kept[0].count())
    out = live.select("gram", "times", (F.col("logp") - float(np.log10(unseen))).alias("logp"))
    for some in done:
        out = out.union(some)
    return out


CODED = "doc_id long, variant long, gram long, value double"


def coder(sent):
    """Two kinds of rows: one for each text, with the sum of its positions that were sent; and one for each
    other position, whose probability must be joined.

    A text's own row carries a negative gram, which equals no gram, and that spreads evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets, 1_000_000):
                code = grams(*symbols(buf, offsets[lo : hi + 1]))
                size = np.diff(offsets[lo : hi + 1]) + 1
                bounds = np.concatenate([[0], np.cumsum(size)[:-1]])
                logp, rest = sent.value.find(code)
                text = np.repeat(np.arange(lo, hi), size)[rest]
                own = (mix(code[bounds] + np.arange(lo, hi).astype(np.uint64)) | np.uint64(1 << 63)).view(np.int64)
                take = pa.array(np.concatenate([np.arange(lo, hi), text]))
                gram = np.concatenate([own, code[rest].view(np.int64)])
                value = np.concatenate([np.add.reduceat(logp, bounds), np.ones(len(rest))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(gram), pa.array(value)], names=["doc_id", "variant", "gram", "value"])

    return run


SCORED = "doc_id long, variant long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, rows long"


def scorer(frequent, n_all: int, n_kinds: int):
    """Two kinds of rows: one for each text, and one for each of its words whose count must be joined.

    A text's own row carries a blank and digits, which is no word's key, and that spreads evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        floor = np.log10(n_all + n_kinds + 1)
        get = common.get
        for batch in batches:
            buf, offsets = text_buffers(batch.column(3))
            for lo, hi in slices(offsets, 2_000_000):
                raw = LOWER[buf[offsets[lo] : offsets[hi]]].tobytes()
                doc, word, times, tokens, known, base = [], [], [], [], [], []
                for i in range(hi - lo):
                    a, b = offsets[lo + i] - offsets[lo], offsets[lo + i + 1] - offsets[lo]
                    count = Counter(map(word_key, raw[a:b].split()))
                    n = sum(count.values()) + 1
                    end = common.get(END_WORD, 0)
                    total, seen = np.log10(end + 1) - n * floor, int(end > 0)
                    for w, k in count.items():
                        c = get(w)
                        if c is None:
                            doc.append(lo + i)
                            word.append(w)
                            times.append(k)
                            tokens.append(0)
                            known.append(0)
                            base.append(0.0)
                        else:
                            total += k * c[1]
                            seen += k
                    doc.append(lo + i)
                    word.append(b" %d" % (zlib.crc32(raw[a:b]) ^ (lo + i)))
                    times.append(0)
                    tokens.append(n)
                    known.append(seen)
                    base.append(float(total))
                take = pa.array(doc)
                rows = pa.array([int(t > 0) for t in tokens])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(take) for k in (0, 1, 2)), pa.array(word, pa.binary()), pa.array(times, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), rows],
                    names=["doc_id", "variant", "held_out", "word", "times", "n_tokens", "n_known", "base", "rows"],
                )

    return run


class Frequent:
    """Counts of frequent words with their logarithms; get() gives (count, log10(count + 1)) or None."""

    def __init__(self, counts: dict[bytes, int]):
        self.value = {w: (c, float(np.log10(c + 1))) for w, c in counts.items()}

    def get(self, word: bytes, default=None):
        if default is not None:
            got = self.value.get(word)
            return got[0] if got else default
        return self.value.get(word)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, nodes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are the words of the text, A-Z lower-cased, and one end.  base_score is the sum of
    log10((c + 1) / (N + V + 1)); score the model's log10 probability of the text's bytes and end.  Null
    text counts as empty: one token; very long texts are read whole, a text at a time.  A null id counts as empty text in the split.  Rows with equal
    id and text are scored once and repeated, by an array of their number, eight bytes for each, in one task.  Without training rows all counts are 0 and the model
    is uniform.  Empty table: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("variant"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    words = durable(training.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("n") * FREQUENT >= n_all)
    # at most FREQUENT words hold 1/FREQUENT of all tokens each
    counts = {bytes(w): int(n) for w, n in often.union(words.where(F.col("word") == END_WORD)).distinct().collect()}
    send = spark.sparkContext.broadcast
    counted = durable(rows.select("text", "held_out").mapInArrow(count_grams, "gram long, n long, times long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times")))
    known = durable(probabilities(counted, nodes))
    positions = known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = F.col("times") * SENT_GRAMS >= positions
    coded = rows.select("doc_id", "variant", "text").mapInArrow(coder(send(Sent(*columns(known.where(common).select("gram", "logp"))))), CODED)
    model = coded.join(known.where(~common).select("gram", "logp"), "gram", "left")
    scored = rows.mapInArrow(scorer(send(Frequent(counts)), n_all, n_kinds), SCORED)
    joined = scored.join(words.withColumnRenamed("n", "c"), "word", "left")
    asked = F.col("rows") == 0
    found = F.coalesce("c", F.lit(0))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    by_words = joined.select(
        "doc_id",
        "variant",
        "held_out",
        "rows",
        "n_tokens",
        F.when(asked & (found > 0), F.col("times")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(asked, F.col("times") * F.log10(found + 1)).otherwise(F.col("base")).alias("base"),
        none("model", "double"),
    )
    own_sum = F.sum(F.when(F.col("gram") < 0, F.col("value")).otherwise(F.col("logp")))
    by_grams = model.groupBy("doc_id", "variant").agg(own_sum.alias("model")).select(
        "doc_id",
        "variant",
        none("held_out", "boolean"),
        *[none(c, "long") for c in ("rows", "n_tokens", "n_known")],
        none("base", "double"),
        "model",
    )
    summed = by_words.union(by_grams).groupBy("doc_id", "variant").agg(F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "model")])
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    share = lambda c: F.col(c) / F.col("rows")  # noqa: E731  rows with equal id and text were added up
    return each.select(
        "doc_id",
        "held_out",
        share("n_tokens").cast("long").alias("n_tokens"),
        share("n_known").cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        share("base").alias("base_score"),
        share("model").alias("score"),
    )
