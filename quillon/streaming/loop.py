"""Keyed state of the agent loop: event streams cut anywhere, throttled steps, and the perception cache."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.streaming.agents import LATENESS, MOST_OUT, bucketed, keyed

#: Between steps; and after a failed one.
THROTTLE_MS, COOLDOWN_MS = 750, 18_000
CACHE = 6


def readable(data: str) -> bool:
    try:
        return bool(json.loads(data))
    except ValueError:
        return False


class Frames(StatefulProcessor):
    """Lines of an event stream whose chunks of bytes end anywhere, also within a character.

    The state is the unfinished line, the name of the event whose data is awaited, how many frames there were, and
    whether the stream is over: the first readable action ends it.  Data that is no JSON, or comes without a name, is skipped.
    """

    OUT = "run_id long, seq long, event string, data string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "line binary, event string, seq long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        line, event, seq, over = self.held.get() if self.held.exists() else (b"", "", 0, False)
        out = []
        chunks = sorted(((r.at, r.chunk) for b in rows for r in b.itertuples()), key=lambda r: r[0])
        lines = (bytes(line) + b"".join(bytes(c) for _, c in chunks if c is not None)).split(b"\n")
        line = lines.pop()
        for raw in lines:
            if over:
                break
            text = raw.removesuffix(b"\r").decode("utf-8", "replace")
            if text.startswith("event: "):
                event = text[7:].strip()
            elif text.startswith("data: ") and event:
                if readable(text[6:]):
                    out.append((key[0], seq, event, text[6:]))
                    seq += 1
                    over = event == "action"
                event = ""
        self.held.update((b"" if over else line, event, seq, over))
        yield pd.DataFrame(out, columns=["run_id", "seq", "event", "data"])

    def close(self) -> None:
        pass


def frames(chunks: DataFrame) -> DataFrame:
    """``chunks`` has run_id, at (their order) and chunk (bytes)."""
    return keyed(chunks, Frames(), Frames.OUT, "append", "none")


def packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


class StepClock(StatefulProcessor):
    """When each step of a run starts: not before the one before it has started and its gap has passed.

    The runs of one bucket share a state: when each is free again, and the steps that wait, packed as one Arrow table for
    each batch.  Steps are let go by the timer of the first one that waits, with all that may start by then.
    """

    OUT = "run_id long, step long, started long, waited long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows), ignore_index=True).sort_values(["run_id", "ms", "step"], kind="stable", ignore_index=True)
        old = unpacked(self.free.get()[0]) if self.free.exists() else pd.DataFrame({"run_id": steps["run_id"][:0], "free": steps["ms"][:0]})
        gap = pd.Series(np.where(steps["failed"].eq(True), COOLDOWN_MS, THROTTLE_MS))
        runs = steps["run_id"]
        before = gap.groupby(runs, dropna=False).cumsum() - gap
        # before a run's gaps so far, the latest of its times: of its steps, and of when it was free
        at = steps[["run_id"]].merge(old, "left", on="run_id")["free"].astype("float64")
        latest = (steps["ms"] - before).groupby(runs, dropna=False).cummax()
        started = before + np.fmax(latest, at).astype("int64")
        free = pd.DataFrame({"run_id": runs, "free": started + gap}).drop_duplicates("run_id", keep="last")
        self.free.update((packed(pd.concat([old, free]).drop_duplicates("run_id", keep="last")),))
        self.waiting.appendValue((packed(pd.DataFrame({"run_id": runs, "step": steps["step"], "started": started, "waited": started - steps["ms"]})),))
        self.handle.registerTimer(int(started.min()))
        yield pd.DataFrame([], columns=["run_id", "step", "started", "waited"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        due = rows["started"] <= timerValues.getCurrentWatermarkInMs()
        left, gone = rows[~due], rows[due]
        if len(left):
            self.waiting.put([(packed(left),)])
            self.handle.registerTimer(int(left["started"].min()))
        else:
            self.waiting.clear()
        for i in range(0, len(gone), MOST_OUT):
            yield gone[i : i + MOST_OUT]

    def close(self) -> None:
        pass


def clocked(steps: DataFrame, time: str = "ts") -> DataFrame:
    """``steps`` has run_id, step, failed and a time."""
    timed = steps.withWatermark(time, LATENESS).select("run_id", "step", "failed", F.unix_millis(F.col(time)).alias("ms"), time)
    # steps of no run, whose null would make floats of other numbers, have a bucket of their own
    own = F.when(F.col("run_id").isNull(), -1).otherwise(F.col("bucket"))
    return keyed(bucketed(timed, "run_id").withColumn("bucket", own), StepClock(), StepClock.OUT, "append", "eventTime", "bucket")


class Cache(StatefulProcessor):
    """Caches of the runs of one bucket, each with the last CACHE keys put in, in the order in which they were; a hit does
    not refresh.  A batch reads and writes the caches of a bucket at once."""

    OUT = "run_id long, step long, hit boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.caches = handle.getListState("caches", "run_id long, slots array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        caches = {r[0]: list(r[1]) for r in self.caches.get()} if self.caches.exists() else {}
        steps = pd.concat(list(rows), ignore_index=True).sort_values(["run_id", "step"], kind="stable")
        hits = []
        for run, name in zip(steps["run_id"], steps["key"]):
            held = caches.setdefault(run, [])
            hits.append(name in held)
            if not hits[-1]:
                held.append(name)
                if len(held) > CACHE:
                    del held[0]
        self.caches.put(list(caches.items()))
        yield steps[["run_id", "step"]].assign(hit=hits)

    def close(self) -> None:
        pass


def cached(steps: DataFrame) -> DataFrame:
    """``steps`` has run_id, step and key."""
    return keyed(bucketed(steps, "run_id"), Cache(), Cache.OUT, "append", "none", "bucket")
