"""Periodic run detection: maximal repetitions of words, by a suffix automaton with merged end positions.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2q) words that no neighbouring
word extends.  Each text is searched where it lies, so nothing is shuffled.  Two steps:

1. In a run of L >= 12 words with period q <= L / 2 each word but the last q stands in a six-word piece that comes
   again q words later, and each but the first q in one that came q words before, so pieces that come twice cover it.
   Hashes of these pieces, over whole Arrow batches, leave the stretches they cover; equal pieces hash alike, hence no
   run is lost, and a chance collision only leaves more.
2. The words of each such stretch, told apart by their bytes, go through a suffix automaton.  Sets of end positions are
   merged into the suffix link's, the smaller into the larger; where a new neighbour stands no farther than the state
   is long, two occurrences touch or overlap and their distance is a period.  It is extended to both sides as far as it holds.

That finds every run: at the state where two ends one smallest period apart meet, none lies between them, for it
would give a smaller period.

Defined results: null and blank texts have no words and no runs; repeated rows are judged alike; an empty table gives
no rows; further columns are not read, whatever their names.  A text is one row, so its length bounds a task's memory.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrays import U, Rolling, Words, mix, slices, text_buffers

LEAST = 12
PIECE = LEAST // 2
#: Most ends of one block of a set, so that an insertion moves few.
BLOCK = 2048
RUN = "struct<start:long,length:long,period:long>"
OUT = f"n_words long, runs array<{RUN}>, collapsed string"


class Ends:
    """An ordered set of end positions in blocks."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, end: int):
        self.blocks, self.heads, self.size = [[end]], [end], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, end: int) -> tuple[int, int]:
        """Takes one more end; its neighbours, -1 where there is none."""
        k = max(0, bisect_right(self.heads, end) - 1)
        block = self.blocks[k]
        j = bisect_left(block, end)
        before = block[j - 1] if j else self.blocks[k - 1][-1] if k else -1
        after = block[j] if j < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(j, end)
        self.size += 1
        if j == 0:
            self.heads[k] = end
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.heads.insert(k + 1, block[BLOCK // 2])
        return before, after


def automaton(x: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link) of each state of the suffix automaton, and the state of each prefix."""
    length, link, go, prefix = [0], [-1], [{}], []
    last = 0
    for c in x:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        go.append({})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                go.append(dict(go[q]))
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        prefix.append(cur)
        last = cur
    return length, link, prefix


def squares(x: list[int]) -> Iterator[tuple[int, int]]:
    """(end, distance): the words before ``end`` have that period over twice its length at least."""
    length, link, prefix = automaton(x)
    ends: list[Ends | None] = [None] * len(length)
    for i, state in enumerate(prefix):
        ends[state] = Ends(i)
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[state]
        if up == 0:
            ends[state] = None
            continue
        mine, other = ends[state], ends[up]
        ends[state] = None
        if other is None:
            ends[up] = mine
            continue
        small, large = (mine, other) if mine.size <= other.size else (other, mine)
        ends[up] = large
        most = length[up]
        for end in small:
            before, after = large.add(end)
            if before >= 0 and end - before <= most:
                yield end, end - before
            if after >= 0 and after - end <= most:
                yield after, after - end


def maximal_runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period."""
    n, seen, found = len(x), {}, {}
    for end, d in squares(x):
        starts, stops = seen.setdefault(d, ([], []))
        k = bisect_right(starts, end - 2 * d + 1) - 1
        if k >= 0 and stops[k] > end:
            continue
        lo, hi = end - d, end + 1
        while lo > 0 and x[lo - 1] == x[lo - 1 + d]:
            lo -= 1
        while hi < n and x[hi] == x[hi - d]:
            hi += 1
        at = bisect_right(starts, lo)
        starts.insert(at, lo)
        stops.insert(at, hi)
        if hi - lo >= max(least, 2 * d):
            found[lo, hi] = min(d, found.get((lo, hi), d))
    return sorted((lo, hi - lo, d) for (lo, hi), d in found.items())


def stretches(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges, each within one text, that may hold a run; ``first`` has the first word of each text, and the end."""
    grams = Rolling(hashes).grams(PIECE)
    text = np.searchsorted(first, np.arange(len(grams)), side="right")
    live = np.flatnonzero(np.arange(len(grams)) + PIECE <= first[text])
    group = text[live]
    while len(live):
        key = mix(grams[live] ^ mix(group.astype(U)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(live), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        live, group = live[again], group[again]
        if not len(live):
            break
        # pieces that touch or overlap in one text are a stretch, which is then judged by itself
        starts = np.flatnonzero(np.r_[True, (live[1:] > live[:-1] + PIECE) | (group[1:] != group[:-1])])
        sizes = live[np.r_[starts[1:] - 1, len(live) - 1]] - live[starts] + PIECE
        number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(live)]))
        keep = (sizes >= LEAST)[number]
        if again.all() and keep.all() and len(np.unique(group)) == len(starts):
            break
        live, group = live[keep], number[keep]
    if not len(live):
        return []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return [(int(live[a]), int(live[b - 1]) + PIECE) for a, b in zip(starts, [*starts[1:], len(live)], strict=True)]


def found_in(texts: pa.Array) -> pa.RecordBatch:
    """n_words, runs and the text without repetitions of each text of one Arrow batch."""
    buf, offsets = text_buffers(texts)
    counts, runs, kept = [], [], []
    for a, b in slices(offsets):
        words = Words(buf, offsets[a : b + 1])
        first = words.first
        own: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in stretches(words.hashes(), first):
            ids: dict[bytes, int] = {}
            text = int(np.searchsorted(first, lo, side="right")) - 1
            x = [ids.setdefault(words.word(i), len(ids)) for i in range(lo, hi)]
            own.setdefault(text, []).extend((lo - int(first[text]) + s, n, q) for s, n, q in maximal_runs(x))
        raw = words.buf
        for i in range(b - a):
            parts = raw[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
            counts.append(len(parts))
            here = sorted(own.get(i, ()), key=lambda r: (r[0], r[2]))
            runs.append(here)
            if here:
                stay = np.ones(len(parts), bool)
                for s, n, q in here:
                    stay[s + q : s + n] = False
                parts = [parts[k] for k in np.flatnonzero(stay)]
            kept.append(b" ".join(parts).decode())
    named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(named, kind), pa.array(kept, pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (by start and period) and the text whose words are joined by one space, of each run only the
    first period."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = found_in(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], [key, *found.schema.names])

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(search, f"`{key}` {rows.schema[0].dataType.simpleString()}, {OUT}")
