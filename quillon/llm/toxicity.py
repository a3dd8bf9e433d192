"""Toxicity by compression distance: two zstandard dictionaries, one for each class.

A text is read in windows, each one run of letters between blanks.  Its frame is that of the window
between a fixed head and tail that both dictionaries hold; without them zstandard would store so
short an input raw and look for no match near its end.  A window is toxic-like if its frame is a
margin shorter under the toxic dictionary than under the ordinary one.  Texts score by a logistic fit on how many windows are toxic-like.

Training, on at most SAMPLE labelled rows of each class (a documented bound; the rows with the
least hash of their id), each distinct text once:

* each dictionary gets the most widespread windows of its own class's texts and nothing else: the ordinary one up to
  ORDINARY_BYTES, the toxic one so many as are calibrated, up to TOXIC_BYTES.  Toxic texts hold mostly ordinary words,
  and so does their dictionary; the much larger ordinary one holds these as well, and their frames are as short there;
* the number of toxic windows, the margin and the logistic weights are calibrated on other texts than those which
  filled the dictionaries (FOLDS parts that take turns).

A window that the ordinary dictionary holds whole is ordinary, and so is one that shares no run of RUN bytes with the
toxic dictionary: shorter matches are chance.  Neither is coded.  Scoring is one pass over whole texts; a worker keeps
verdicts of windows seen, within a bound.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.store import durable

SAMPLE = 4000
#: Bounds of any sample that reaches the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 40_000, 128 << 20
BINS_LOG = 12
ORDINARY_BYTES, TOXIC_BYTES = 262_144, 32_768
HEAD, TAIL = b"~0123456789~abcdefghijklmnopqrstuvwxyz~", b"~ZYXWVUTSRQPO~"
WINDOW = re.compile(r"[^\W\d_]+")
#: Windows of the toxic dictionary, by how many toxic texts hold them.
LENGTHS = (250, 1000, 2000, 4000)
#: Parts of the training texts; each is judged by dictionaries of the others.
FOLDS = 5
MARGINS = (3, 4)
RUN = 5
MEMO = 400_000
#: Optimal parsing over a binary tree: faster searches miss short matches in a long dictionary.
STRATEGY = zstandard.STRATEGY_BTULTRA
PREDICTED = 0.7
#: A class prior for texts without windows, and the weight of the penalty on the logistic weights.
RIDGE = 0.5


def windows(text: str) -> list[bytes]:
    return [b" " + w.encode() + b" " for w in WINDOW.findall(text.lower())]


def dictionary(ranked: list[bytes], most: int = ORDINARY_BYTES) -> bytes:
    """Windows joined, the first ranked nearest to the end, where references are cheapest."""
    kept, size = [], 0
    for w in ranked:
        if size + len(w) > most:
            break
        kept.append(w[:-1])
        size += len(w) - 1
    return b"".join(reversed(kept)) + b" "


def whole(content: bytes) -> frozenset[bytes]:
    """The windows that a dictionary holds."""
    return frozenset(b" " + w + b" " for w in content.split(b" ") if w)


def runs(content: bytes) -> frozenset[bytes]:
    return frozenset(content[i : i + RUN] for i in range(len(content) - RUN + 1))


def touches(window: bytes, known: frozenset[bytes]) -> bool:
    return any(window[i : i + RUN] in known for i in range(len(window) - RUN + 1))


class Coder:
    """Frame lengths under one raw-content dictionary."""

    def __init__(self, content: bytes):
        self.content = content
        parameters = zstandard.ZstdCompressionParameters.from_level(
            19, min_match=3, strategy=STRATEGY, window_log=19, hash_log=17, chain_log=18, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        held = zstandard.ZstdCompressionDict(content + TAIL + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)

    def cost(self, window: bytes) -> int:
        return len(self.coder.compress(HEAD + window + TAIL))


class Pair:
    """Ordinary against toxic dictionary, with the calibrated margin and weights."""

    def __init__(self, ordinary: bytes, toxic: bytes, margin: int, weights: tuple[float, float, float]):
        self.ordinary, self.toxic, self.margin, self.weights = ordinary, toxic, margin, weights
        self._coders = None
        self._memo: dict[bytes, bool] = {}
        self._runs, self._held = runs(toxic), whole(ordinary)

    def __getstate__(self):
        return self.ordinary, self.toxic, self.margin, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def like(self, window: bytes) -> bool:
        if window in self._held:
            return False
        known = self._memo.get(window)
        if known is None:
            if self._coders is None:
                self._coders = Coder(self.ordinary), Coder(self.toxic)
            if len(self._memo) >= MEMO:
                self._memo.clear()
            a, b = self._coders
            known = self._memo[window] = touches(window, self._runs) and a.cost(window) - b.cost(window) >= self.margin
        return known

    def features(self, text: str) -> tuple[int, int]:
        own = windows(text)
        like = self.like
        return sum(map(like, own)), len(own)

    def score(self, text: str) -> float:
        return float(probability(np.array([self.features(text)]), self.weights)[0])


def design(features: np.ndarray) -> np.ndarray:
    hits, n = features[:, 0].astype(float), features[:, 1].astype(float)
    return np.stack([np.ones(len(hits)), np.minimum(hits, 4), (hits > 0) * np.log1p(n) / 5], axis=1)


def probability(features: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    z = design(features) @ np.array(weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(features: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Penalised logistic weights by Newton steps."""
    x, w = design(features), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - RIDGE * w * (0, 1, 1)
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag((1e-9, RIDGE, RIDGE))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def spread(texts: list[list[bytes]]) -> Counter:
    count: Counter = Counter()
    for own in texts:
        count.update(set(own))
    return count


def by_spread(count: Counter, least: int = 2) -> list[bytes]:
    return [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= least]


def dictionaries(own: list[list[bytes]], label: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary of some texts and their toxic windows, the most widespread first."""
    toxic, plain = ([o for o, y in zip(own, label, strict=True) if y == v] for v in (1, 0))
    return dictionary(by_spread(spread(plain))), by_spread(spread(toxic))


def train(rows: list[tuple[str, int]]) -> Pair:
    """A pair of dictionaries from (text, label) rows; neutral if a class is missing."""
    rows = sorted(set(rows))
    # equal windows are one object, as most occur very often
    pool: dict[bytes, bytes] = {}
    own = [[pool.setdefault(w, w) for w in windows(t)] for t, _ in rows]
    label = np.array([y for _, y in rows])
    rows = range(len(rows))
    if not len(rows) or label.min() == label.max():
        prior = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return Pair(b" ", b" ", min(MARGINS), (float(np.log(prior / (1 - prior))), 0.0, 0.0))
    fold = np.arange(len(rows)) % FOLDS
    sizes = np.array([len(o) for o in own])
    hits: dict[tuple[int, int], np.ndarray] = {}
    for f in range(FOLDS):
        known, asked = fold != f, np.flatnonzero(fold == f)
        ordinary, ranked = dictionaries([o for o, k in zip(own, known, strict=True) if k], label[known])
        base, held = Coder(ordinary), whole(ordinary)
        distinct = {w for i in asked for w in own[i]} - held
        widest = runs(dictionary(ranked[: max(LENGTHS)], TOXIC_BYTES))
        plain = {w: base.cost(w) for w in sorted(distinct) if touches(w, widest)}
        for length in LENGTHS:
            special = dictionary(ranked[:length], TOXIC_BYTES)
            coder, known_runs = Coder(special), runs(special)
            saved = {w: c - coder.cost(w) for w, c in plain.items() if touches(w, known_runs)}
            for margin in MARGINS:
                count = hits.setdefault((margin, length), np.zeros(len(rows), dtype=int))
                count[asked] = [sum(saved.get(w, 0) >= margin for w in own[i]) for i in asked]
    best = None
    for (margin, length), count in hits.items():
        features = np.stack([count, sizes], axis=1)
        weights = logistic(features, label)
        p = probability(features, weights).clip(1e-6, 1 - 1e-6)
        loss = -float(np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))
        if best is None or loss < best[0] - 1e-9:
            best = loss, margin, length, weights
    _, margin, length, weights = best
    ordinary, ranked = dictionaries(own, label)
    return Pair(ordinary, dictionary(ranked[:length], TOXIC_BYTES), margin, weights)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether the crc32 of the id as text falls in the given remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text, label) of at most ``per_class`` rows of each label outside the held-out part.

    ``label`` is a column of ``labels`` and is read as a double; rows beyond SAMPLE_ROWS are left out, every label
    giving in turn, and so is each text that does not fit into what is left of SAMPLE_BYTES: a very long text is
    left out by itself, and those after it are not.  A document labelled twice has its largest label;
    labels and texts that are null or not a number are left out; of several texts of an id the least counts.
    """
    rank = Window.partitionBy("__label").orderBy(F.xxhash64("__key"), "__key")
    named = labels.select(F.col("doc_id").cast("long").alias("__key"), label.cast("double").alias("__label"), held_out("doc_id").alias("__out"))
    known = named.where(F.col("__key").isNotNull() & F.col("__label").isNotNull() & ~F.isnan("__label") & ~F.col("__out")).groupBy("__key").agg(F.max("__label").alias("__label"))
    # the least hashes of each label: a histogram of their first bits finds about where they end, so that the
    # ranking sees few rows more than it keeps, however many a label has
    known = known.withColumn("__bin", F.shiftrightunsigned(F.xxhash64("__key").bitwiseXOR(F.lit(-1 << 63)), 64 - BINS_LOG))
    upto = F.sum("__n").over(Window.partitionBy("__label").orderBy("__bin"))
    bins = known.groupBy("__label", "__bin").agg(F.count("*").alias("__n")).withColumn("__upto", upto)
    ends = bins.groupBy("__label").agg(F.coalesce(F.min(F.when(F.col("__upto") >= per_class, F.col("__bin"))), F.max("__bin")).alias("__last"))
    near = known.join(ends, "__label").where(F.col("__bin") <= F.col("__last")).select("__key", "__label")
    keys = near.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= per_class).orderBy("__rank", "__label", "__key").limit(SAMPLE_ROWS)
    text = docs.select(F.col(id_col).cast("long").alias("__key"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    got = durable(text.join(F.broadcast(keys), "__key").groupBy("__key", "__label", "__rank").agg(F.min("__text").alias("__text")))
    # at most SAMPLE_ROWS rows without their texts
    kept = got.select("__rank", "__label", "__key", F.octet_length("__text").alias("__bytes")).coalesce(1).mapInPandas(fitting(SAMPLE_BYTES), "__key long")
    return got.join(F.broadcast(kept), "__key").select(F.col("__text").alias("text"), F.col("__label").alias("label"))


def fitting(most: int):
    """The keys of rows (rank, label, key, bytes), in that order, of which each fits into what those before it left."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, keys = most, []
        for _, _, key, size in sorted(tuple(r) for pdf in frames for r in pdf.itertuples(index=False)):
            if size <= left:
                left -= size
                keys.append(key)
        yield pd.DataFrame({"__key": pd.Series(keys, dtype="int64")})

    return run


def fitted(sample: DataFrame, fit):
    """``fit`` of all (text, label) rows of a bounded sample, run by one worker; the driver sees the model only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(t, float(y)) for pdf in frames for t, y in zip(pdf["text"], pdf["label"], strict=True)]
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    found = sample.coalesce(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])


def scorer(pair: Pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            features = np.array([pair.features(texts[i].as_py() or "") for i in range(len(texts))]).reshape(-1, 2)
            score = probability(features, pair.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def score_of(pair: Pair):
    """The score as a function of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            features = np.array([pair.features(t or "") for t in texts]).reshape(-1, 2)
            yield pd.Series(probability(features, pair.weights))

    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = SAMPLE) -> Pair:
    return fitted(labelled_sample(docs, labels, (F.col(label_col) > 0).cast("int"), per_class), lambda rows: train([(t, int(y)) for t, y in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Only the text is read for a score: rows with equal texts score alike.  Null and empty texts get the
    score of a text without windows.  Without labels of both classes every text gets the prior.
    Empty table: no rows.
    """
    pair = fit(docs, labels, per_class=per_class)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(scorer(pair), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICTED, 1).otherwise(0))
