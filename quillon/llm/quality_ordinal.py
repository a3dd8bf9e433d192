"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w . x): all grades share the weights w over hashed text
features, and thresholds are kept in order by construction (the first plus exponentials).  Features of a
text are its words and word endings, hashed into DIMENSION slots and scaled to length one, and a few
shape measures.  The fit is full-batch gradient ascent with momentum on at most SAMPLE rated
rows of each grade (a documented bound; the rows with the least hash of their id), outside the
held-out part.  The weights have a fixed size, so scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import U, Words, mix, slices, text_buffers
from quillon.llm.toxicity import fitted, held_out, labelled_sample

DIMENSION = 1 << 17
SHAPES = 8
SAMPLE = 3000
STEPS = 150
RIDGE = 3e-3


def hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features, their texts, their values, and the shape measures of each text."""
    words = Words(buf, offsets, lower=False)
    n = words.counts
    doc = np.repeat(np.arange(len(n)), n)
    h = words.hashes()
    last = words.buf[words.end - 1].astype(U)
    before = words.buf[np.maximum(words.end - 2, words.start)].astype(U)
    ending = mix((last << U(8) | before) + U(1 << 40))
    slot = np.concatenate([h % U(DIMENSION), ending % U(DIMENSION)]).astype(np.int64)
    owner = np.concatenate([doc, doc])
    value = 1 / np.sqrt(np.maximum(1, 2 * n))[owner]
    size = np.maximum(1, np.diff(words.offsets)).astype(float)
    many = np.maximum(1, n).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[words.offsets[1:]] - total[words.offsets[:-1]]) / size

    b = words.buf
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    upper = (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    mark = ~letter & ~digit & (b > 32)
    pair = np.unique(np.stack([doc, h.view(np.int64)]), axis=1)[0] if len(h) else doc
    kinds = np.bincount(pair, minlength=len(n)) / many
    lines = share(b == 10) * size
    shape = np.stack([np.ones(len(n)) * 0, share(letter), share(upper), share(digit), share(mark) * 3, kinds, np.log1p(n) / 8, np.log1p(lines) / 4], axis=1)
    return slot, owner, value, shape


class Ordinal:
    def __init__(self, grades: list[float], weights: np.ndarray, shape: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.shape, self.thresholds = grades, weights, shape, thresholds

    def above(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        slot, owner, value, shape = hashed(buf, offsets)
        z = np.bincount(owner, weights=self.weights[slot] * value, minlength=len(shape)) + shape @ self.shape
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))


def compact(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hashed, a few texts at a time, with equal features of a text added up and in half the memory."""
    buf, offsets = text_buffers(pa.array(texts, pa.large_string()))
    parts = []
    for lo, hi in slices(offsets):
        slot, owner, value, shape = hashed(buf, offsets[lo : hi + 1])
        key, at = np.unique(owner * DIMENSION + slot, return_inverse=True)
        parts.append(((key % DIMENSION).astype(np.int32), (key // DIMENSION + lo).astype(np.int32), np.bincount(at, weights=value, minlength=len(key)).astype(np.float32), shape))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(rows: list[tuple[str, float]], steps: int = STEPS) -> Ordinal:
    """Grades are the distinct ratings in order; a single grade gives a constant model."""
    rows = sorted(set(rows))
    grades = sorted({g for _, g in rows}) or [0]
    k = len(grades) - 1
    weights, shape_w = np.zeros(DIMENSION), np.zeros(SHAPES)
    if k < 1:
        return Ordinal(grades, weights, shape_w, np.zeros(0))
    y = np.searchsorted(grades, [g for _, g in rows])
    slot, owner, value, shape = compact([t for t, _ in rows])
    balance = 1 / np.bincount(y, minlength=k + 1)[y] / (k + 1)
    # thresholds = first + cumulated exponentials
    theta = np.concatenate([[0.0], np.zeros(k - 1)])
    speed = [np.zeros_like(weights), np.zeros_like(shape_w), np.zeros_like(theta)]
    second = [np.zeros_like(s) for s in speed]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        cut = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
        z = np.bincount(owner, weights=weights[slot] * value, minlength=len(y)) + shape @ shape_w
        high = np.concatenate([cut, [np.inf]])[y]
        low = np.concatenate([[-np.inf], cut])[y]
        f_high = np.where(np.isinf(high), 1.0, sig(np.where(np.isinf(high), 0, high) - z))
        f_low = np.where(np.isinf(low), 0.0, sig(np.where(np.isinf(low), 0, low) - z))
        d_high, d_low = f_high * (1 - f_high), f_low * (1 - f_low)
        p = np.maximum(f_high - f_low, 1e-9)
        gz = balance * (d_low - d_high) / p
        g_high, g_low = balance * d_high / p, -balance * d_low / p
        g_cut = np.zeros(k)
        np.add.at(g_cut, np.minimum(y, k - 1), np.where(y < k, g_high, 0))
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, g_low, 0))
        g_theta = np.cumsum(g_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(theta[1:])])
        grads = [
            np.bincount(slot, weights=gz[owner] * value, minlength=DIMENSION) - RIDGE * weights / len(weights) ** 0.5,
            shape.T @ gz - RIDGE * shape_w * 1e-2,
            g_theta,
        ]
        for i, (par, g) in enumerate(zip((weights, shape_w, theta), grads, strict=True)):
            speed[i] = 0.9 * speed[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            par += 0.08 * (speed[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6)
    cut = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    return Ordinal(grades, weights, shape_w, cut)


def scorer(model: Ordinal, tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = np.array(model.grades, dtype=float)
        j = next((i for i, g in enumerate(model.grades) if g >= tail), None)
        for batch in batches:
            buf, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                above = model.above(buf, offsets[lo : hi + 1])
                expected = grades[0] + above @ np.diff(grades)
                at_least = np.ones(hi - lo) if j == 0 else np.zeros(hi - lo) if j is None else above[:, j - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(expected), pa.array(at_least)],
                    names=["doc_id", "held_out", "expected_grade", "tail_probability"],
                )

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", tail: float = 1, least: float = 0.5, per_grade: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability = P(grade >= ``tail``), kept = it is ``least`` or more.

    One row for each row of ``docs``; equal texts score alike.  Null and empty texts have no words and
    score by the thresholds alone; very long texts are read whole.  Ratings are numbers, fractions included, and
    null ones are left out.  Without ratings, or with one grade only, the model is that grade (0
    without any).  Empty table: no rows.
    """
    model = fitted(labelled_sample(docs, labels, F.col(label_col), per_grade), fit)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(scorer(model, tail), "doc_id long, held_out boolean, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= least)
