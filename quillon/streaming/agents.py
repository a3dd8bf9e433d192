"""Structured Streaming forms: stable tokens, step counters, questions, sessions, micro-batches, correlation.

Watermarks bound state by time.  Keyed processors (transformWithState) keep a few numbers for each run; the
token map of a run grows with its distinct values and is one state entry for each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.gate import verdict

LATENESS = "10 minutes"
#: The lateness in microseconds: how long a message may be sent again.
AGAIN_US = 600_000_000
#: Groups of keys that share one entry of state.
BUCKETS = 512
#: Rows handed on at once.
MOST_OUT = 100_000
QUESTION_TIMEOUT_MS = 25_000
BUDGET, MOST_RECOVERIES, MOST_SAME = 50, 3, 4


def flush_tokens(deltas: DataFrame, time: str = "ts", every: str = "60 milliseconds", key: str = "run_id", seq: str = "seq", text: str = "delta") -> DataFrame:
    """Deltas joined in windows of 60 ms, in order of their sequence numbers."""
    w = deltas.withWatermark(time, LATENESS).groupBy(key, F.window(time, every))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "")
    return w.agg(joined.alias("text"), F.count("*").alias("n")).select(key, F.col("window.start").alias("flushed"), "text", "n")


def event_sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    w = events.withWatermark(time, LATENESS).groupBy(key, F.session_window(time, gap).alias("s"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "total")


def first_seen(messages: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Drops messages sent again within the lateness."""
    return messages.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(keys)


#: Seconds within which a reply of each kind must come: a capture's analysis, the work of a step, a cold start of the models.
TIMEOUTS = {"scan": 40, "step": 90, "warm": 150}


def correlate(requests: DataFrame, replies: DataFrame, timeout_s: int | dict[str, int], key: str = "request_id", time: str = "ts", kind: str = "kind") -> DataFrame:
    """Requests with their reply in time; without one the reply is null (left outer join).

    One timeout holds for all, or one for each ``kind`` of request and none longer than the longest of them.  In streams
    the watermark closes a request: its row without a reply leaves by that alone.
    """
    most = timeout_s if isinstance(timeout_s, int) else max(timeout_s.values())
    carried = [] if isinstance(timeout_s, int) else [kind]
    own = F.lit(most)
    for name, seconds in ({} if isinstance(timeout_s, int) else timeout_s).items():
        own = F.when(F.col(kind) == name, seconds).otherwise(own)
    out = answered(requests, replies, [key], own, carried, ["reply"], time)
    return out.select(key, *carried, "asked", "answered", "reply", F.col("answered").isNull().alias("timed_out"))


def degraded(scans: DataFrame, findings: DataFrame, timeout_s: int = 40, keys: tuple[str, ...] = ("run_id", "step"), time: str = "ts") -> DataFrame:
    """The verdict of each step from its page scan (regions, hits) and what the vision host found (error) in time.

    A scan that is sent again counts once; without findings in time, or with an error, the host counts as down and a
    step with regions is skipped, never passed.
    """
    told = [verdict(F.col("regions"), F.lit(up), F.col("hits")).alias(name) for name, up in (("if_up", True), ("if_down", False))]
    out = answered(scans.select(*keys, time, *told), findings.select(*keys, time, "error"), list(keys), F.lit(timeout_s), ["if_up", "if_down"], ["error"], time, once=True)
    up = F.col("answered").isNotNull() & F.col("error").isNull()
    return out.select(*keys, F.when(up, F.col("if_up")).otherwise(F.col("if_down")).alias("verdict"), up.alias("host_up"))


def answered(requests: DataFrame, replies: DataFrame, keys: list[str], own: Column, carried: list[str], told: list[str], time: str = "ts", once: bool = False) -> DataFrame:
    """(keys…, carried…, asked, answered, told…): requests left outer with the replies to their keys within ``own`` seconds.

    With ``once`` a request that is sent again counts once, in streams within the lateness.  Streams meet in buckets of keys,
    each one entry of state, so that a row costs no call to the state store of its own.
    """
    limit = own.cast("long") * 1_000_000
    if not requests.isStreaming:
        a = requests.dropDuplicates(keys) if once else requests
        a = a.select(*keys, *carried, F.col(time).alias("asked"), limit.alias("__own"))
        b = replies.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(time).alias("answered"), *told)
        after = F.unix_micros("answered") - F.unix_micros("asked")
        within = (after >= 0) & (after <= F.col("__own"))
        for k in keys:
            within = within & (F.col(k) == F.col(f"__{k}"))
        return a.join(b, within, "leftOuter").select(*keys, *carried, "asked", "answered", *told)
    kinds = dict(requests.dtypes) | {c: t for c, t in replies.dtypes if c in told}
    sides = []
    for df, asks, given in ((requests, True, carried), (replies, False, told)):
        row = [F.lit(asks).alias("asks"), F.unix_micros(time).alias("at"), (limit if asks else F.lit(0).cast("long")).alias("own")]
        row += [F.col(c) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in (*carried, *told)]
        sides.append(bucketed(df.where(F.col(time).isNotNull()).withWatermark(time, LATENESS), *keys).select("bucket", F.col(time).alias("ts"), *keys, *row))
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, *carried)], "asked long", "answered long", *[f"`{c}` {kinds[c]}" for c in told]])
    met = keyed(sides[0].union(sides[1]), Answers(keys, carried, told, once), out, "append", "eventTime", "bucket")
    return met.withColumns({c: F.timestamp_micros(c) for c in ("asked", "answered")})


def bucketed(rows: DataFrame, *keys: str) -> DataFrame:
    """With the bucket that the keys' state shares with that of others."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


class Answers(StatefulProcessor):
    """Requests and replies of one bucket of keys, joined by time.

    Held are requests that a reply may still reach and replies that a request may still precede, packed as one Arrow table;
    the watermark lets them go, through one timer a bucket.
    """

    def __init__(self, keys: list[str], carried: list[str], told: list[str], once: bool) -> None:
        self.keys, self.carried, self.told, self.once = keys, carried, told, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["asks", "at", "own", *self.keys, *self.carried, *self.told]]
        yield self.ticked(new.assign(met=False, fresh=True), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.ticked(None, timerValues.getCurrentWatermarkInMs() * 1000)

    def ticked(self, new: pd.DataFrame | None, passed: int) -> pd.DataFrame:
        old = pa.ipc.open_stream(self.held.get()[0]).read_pandas(integer_object_nulls=True) if self.held.exists() else None
        parts = [p for p in (old, new) if p is not None]
        out = [*self.keys, *self.carried, "asked", "answered", *self.told]
        if not parts:
            return pd.DataFrame([], columns=out)
        rows = pd.concat(parts, ignore_index=True)
        a, b = rows[rows["asks"]], rows[~rows["asks"]]
        if self.once:
            a = a.sort_values(["fresh", "at"], kind="stable").drop_duplicates(self.keys)
        left = a[[*self.keys, *self.carried, "at", "own", "fresh"]].dropna(subset=self.keys).rename(columns={"at": "asked"}).reset_index(names="row")
        right = b[[*self.keys, *self.told, "at", "fresh"]].dropna(subset=self.keys).rename(columns={"at": "answered", "fresh": "also"})
        pairs = left.merge(right, on=self.keys)
        after = pairs["answered"] - pairs["asked"]
        pairs = pairs[(pairs["fresh"] | pairs["also"]) & (after >= 0) & (after <= pairs["own"])]
        met = a["met"] | a.index.isin(pairs["row"])
        due = ~met & (a["at"] + a["own"] <= passed)
        lost = a.loc[due, [*self.keys, *self.carried, "at"]].rename(columns={"at": "asked"}).assign(answered=None, **dict.fromkeys(self.told))
        # a request that is told, or lost, is held on while it may be sent again
        a = a.assign(met=met | due, until=a["at"] + (a["own"].clip(lower=AGAIN_US) if self.once else a["own"]))
        kept = pd.concat([a, b.assign(until=b["at"])])
        kept = kept[kept["until"] > passed]
        if len(kept):
            open_until = (kept["at"] + kept["own"]).where(~kept["met"], kept["until"])
            self.handle.registerTimer(-(-int(open_until.min()) // 1000))
            batch = pa.RecordBatch.from_pandas(kept.drop(columns="until").assign(fresh=False), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            self.held.update((sink.getvalue().to_pybytes(),))
        elif self.held.exists():
            self.held.clear()
        both = [p[out].astype({"answered": "Int64"}) for p in (pairs, lost) if len(p)]
        return pd.concat(both, ignore_index=True) if both else pd.DataFrame([], columns=out)

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, processor: StatefulProcessor, out: str, mode: str, time: str, by: str = "run_id") -> DataFrame:
    """The processor over rows by one column.  It travels by value, for the planner's Python worker on the driver does not
    see files that were added to the session."""
    own = sys.modules[type(processor).__module__]
    cloudpickle.register_pickle_by_value(own)
    try:
        return rows.groupBy(by).transformWithStateInPandas(processor, out, mode, time)
    finally:
        cloudpickle.unregister_pickle_by_value(own)


class StepLoop(StatefulProcessor):
    """Running counters of one run, and why it stops: done, stuck for good, budget used up."""

    FIELDS = "last string, same int, blocked int, sigs array<string>, stuck int, most_same int, most_blocked int, recoveries int, n long, stop string"
    OUT = "run_id long, n_steps long, max_same int, max_blocked int, stuck_steps int, stop string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else (None, 0, 0, [], 0, 0, 0, 0, 0, None)
        last, same, blocked, sigs, stuck, most_same, most_blocked, recoveries, n, stop = old
        sigs = list(sigs or [])
        for r in sorted((r for b in rows for r in b.itertuples()), key=lambda r: (r.ts, r.step)):
            n += 1
            same = same + 1 if r.sig == last else 0
            last = r.sig
            blocked = blocked + 1 if r.blocked else 0
            sigs = [*sigs, r.sig][-3:]
            stuck += len(sigs) == 3 and len(set(sigs)) == 1
            most_same, most_blocked = max(most_same, same), max(most_blocked, blocked)
            recoveries += same == MOST_SAME
            if stop is None:
                stop = "done" if r.sig == "done" else "recovery" if recoveries > MOST_RECOVERIES else "budget" if n >= BUDGET else None
        self.held.update((last, same, blocked, sigs, stuck, most_same, most_blocked, recoveries, n, stop))
        yield pd.DataFrame({"run_id": [key[0]], "n_steps": [n], "max_same": [most_same], "max_blocked": [most_blocked], "stuck_steps": [stuck], "stop": [stop]})

    def close(self) -> None:
        pass


def step_counters(steps: DataFrame) -> DataFrame:
    """``steps`` has run_id, ts, step, sig, blocked; each batch updates the run's counters."""
    return keyed(steps, StepLoop(), StepLoop.OUT, "update", "none")


class TokenMap(StatefulProcessor):
    """Value to token of one run, by first appearance within each type."""

    OUT = "run_id long, ord long, type string, value string, token string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "type string, value string", "n int")
        self.top = handle.getMapState("top", "type string", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        codes: dict[tuple, int] = {}
        ords, own = [], []
        for b in rows:
            kinds, values = (pd.factorize(b[c], use_na_sentinel=False) for c in ("type", "value"))
            pairs, at = np.unique(kinds[0] * len(values[1]) + values[0], return_inverse=True)
            named = [(kinds[1][p // len(values[1])], values[1][p % len(values[1])]) for p in pairs]
            own.append(np.array([codes.setdefault((t, None if pd.isna(v) else v), len(codes)) for t, v in named])[at])
            ords.append(b["ord"].to_numpy())
        ords, own = np.concatenate(ords), np.concatenate(own)
        order = np.argsort(ords, kind="stable")
        ords, own = ords[order], own[order]
        names, tokens, top = list(codes), [""] * len(codes), {}
        seen, first = np.unique(own, return_index=True)
        # the store is asked once for each value of the batch, in the order of their first appearance
        for code in seen[np.argsort(first)]:
            kind, value = names[code]
            n = self.known.getValue((kind, value))
            if n is None:
                if kind not in top:
                    top[kind] = (self.top.getValue((kind,)) or (0,))[0]
                top[kind] += 1
                n = (top[kind],)
                self.known.updateValue((kind, value), n)
            tokens[code] = f"[{kind.upper()}_{n[0]}]"
        for kind, n in top.items():
            self.top.updateValue((kind,), (n,))
        kinds, values, tokens = np.array([t for t, _ in names], dtype=object), np.array([v for _, v in names], dtype=object), np.array(tokens, dtype=object)
        for i in range(0, len(own), MOST_OUT):
            at = own[i : i + MOST_OUT]
            yield pd.DataFrame({"run_id": key[0], "ord": ords[i : i + MOST_OUT], "type": kinds[at], "value": values[at], "token": tokens[at]})

    def close(self) -> None:
        pass


def stable_tokens(values: DataFrame) -> DataFrame:
    """``values`` has run_id, ord, type, value."""
    return keyed(values, TokenMap(), TokenMap.OUT, "append", "none")


class Questions(StatefulProcessor):
    """The open questions of one bucket of runs, one a run: answered in time, closed by a newer one, or skipped by the timer.

    A batch reads and writes them at once; the timer of a bucket is that of its first question to be skipped.
    """

    OUT = "run_id long, seq long, outcome string, answer string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "run_id long, seq long, until long")

    def held(self) -> dict:
        return {r[0]: (r[1], r[2]) for r in self.open.get()} if self.open.exists() else {}

    def keep(self, held: dict) -> None:
        if held:
            self.open.put([(run, seq, until) for run, (seq, until) in held.items()])
            self.handle.registerTimer(min(until for _, until in held.values()))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.held(), []
        told = pd.concat(list(rows), ignore_index=True)
        told = told.assign(later=told["kind"] != "question").sort_values(["run_id", "ms", "later", "seq"], kind="stable")
        for run, seq, kind, answer, ms in zip(*(told[c].tolist() for c in ("run_id", "seq", "kind", "answer", "ms"))):
            if run in held and (ms >= held[run][1] or (kind == "question" and seq > held[run][0])):
                out.append((run, held.pop(run)[0], "skipped", ""))
            if kind == "question":
                held[run] = (seq, ms + QUESTION_TIMEOUT_MS)
            elif run in held and held[run][0] == seq and answer:
                out.append((run, held.pop(run)[0], "answered", answer))
        self.keep(held)
        yield pd.DataFrame(out, columns=["run_id", "seq", "outcome", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, passed = self.held(), timerValues.getCurrentWatermarkInMs()
        rows = [(run, seq, "skipped", "") for run, (seq, until) in held.items() if until <= passed]
        if rows:
            self.keep({run: q for run, q in held.items() if q[1] > passed})
        yield pd.DataFrame(rows, columns=["run_id", "seq", "outcome", "answer"])

    def close(self) -> None:
        pass


def question_outcomes(events: DataFrame, time: str = "ts") -> DataFrame:
    """``events`` has run_id, seq, kind (question or answer), answer and a time; outcomes as they are known."""
    timed = events.withWatermark(time, LATENESS).withColumn("ms", F.unix_millis(F.col(time)))
    return keyed(bucketed(timed, "run_id"), Questions(), Questions.OUT, "append", "eventTime", "bucket")
