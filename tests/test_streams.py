"""Streams against straightforward forms: cut event streams, clocks, caches, degraded steps, sinks that fail and start again."""

import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillon.operators.sessions import retain, upsert_lessons
from quillon.plans import runs, streams  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES
from quillon.streaming import agents, loop, replay, sinks


def decoded(body: bytes):
    """A whole body at once."""
    out, event = [], ""
    for line in body.decode().split("\n")[:-1]:
        line = line.removesuffix("\r")
        if line.startswith("event: "):
            event = line[7:].strip()
        elif line.startswith("data: ") and event:
            try:
                ok = bool(json.loads(line[6:]))
            except ValueError:
                ok = False
            if ok:
                out.append((len(out), event, line[6:]))
                if event == "action":
                    break
            event = ""
    return out


def test_event_streams_cut_anywhere(spark):
    rng = random.Random(3)
    want, chunks = set(), []
    for run in range(12):
        body = b""
        for k in range(rng.randint(0, 40)):
            name = rng.choice(["thought", "thought", "error", "action"] if k > 25 else ["thought", "error"])
            data = rng.choice([json.dumps({"delta": f"é{k}字"}, ensure_ascii=False), '{"broken', "0", '"x"'])
            body += rng.choice([f"event: {name}\r\ndata: {data}\r\n\r\n", f"event: {name}\ndata: {data}\n\n", f"data: {data}\n", ": comment\n", f"event:{name}\n"]).encode()
        body += rng.choice([b"", b"event: thought\ndata: {\"cut", b"\n"])
        want |= {(run, *r) for r in decoded(body)}
        at = 0
        while body:
            n = rng.randint(1, 9)
            chunks.append((run, at, bytearray(body[:n])))
            body, at = body[n:], at + 1
    df = spark.createDataFrame(chunks, "run_id long, at long, chunk binary")
    for parts in (1, 4):
        got = replay.run([(df, "at")], loop.frames, parts=parts)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_step_clock_waits_in_order(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for run in range(4):
        free, ms = 0, 0
        for step in range(25):
            ms += rng.choice([0, 100, 800, 5000])
            failed = rng.random() < 0.2
            start = max(ms, free)
            free = start + (loop.COOLDOWN_MS if failed else loop.THROTTLE_MS)
            want.add((run, step, start, start - ms))
            rows.append((run, step, failed, ms))
        rows.append((run, -1, False, 10_000_000))
    df = spark.createDataFrame(rows, "run_id long, step long, failed boolean, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = replay.run([(df, "ms")], loop.clocked)
    assert {tuple(r) for r in got.where("step >= 0").collect()} == want and any(w[3] > 0 for w in want)


def test_step_clock_counts_milliseconds_as_its_sql(spark, tmp_path):
    times = ["2024-01-25 15:21:39.999696", "2024-01-25 15:21:39.9995", "2024-01-25 15:21:39.999499", "2024-01-26 15:21:39.999999", "1970-01-02 00:01:39.9995"]
    rows = spark.createDataFrame([(i, i % 2, "view", 1.0, "{}", t) for i, t in enumerate(times)], "event_id long, user_id long, event_type string, value double, props string, t string")
    rows.select("event_id", "user_id", "event_type", "value", "props", F.to_timestamp_ntz("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("step_clock_stream", "cooldown_attempts"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()), name


@pytest.mark.parametrize("times", [["2024-01-25 15:21:39"] * 6000, ["2024-01-25 15:21:39", "2024-02-25 15:21:39"]])
def test_step_clock_lets_go_of_long_runs(spark, tmp_path, times):
    rows = [(i, None if i % 7 == 5 else i % 2, "error" if i % 3 == 0 else None if i % 5 == 0 else "view", t) for i, t in enumerate(times)]
    rows = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t string")
    rows.select("event_id", "user_id", "event_type", F.to_timestamp_ntz("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["step_clock_stream"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES['step_clock_stream']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == len(times)


def test_steps_without_vision_are_skipped_by_the_watermark(spark):
    at = lambda rows, schema: spark.createDataFrame(rows, schema + ", sec long").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    scans = at([(1, 1, 2, 0, 0), (1, 2, 2, 0, 10), (1, 2, 2, 0, 10), (1, 3, 0, 0, 20), (1, 4, 2, 3, 30), (1, 5, 2, 0, 40), (1, 6, 2, None, 50), (9, 9, 0, 0, 99_999)], "run_id long, step long, regions long, hits long")
    found = at([(1, 1, None, 40), (1, 2, None, 51), (1, 4, None, 31), (1, 5, "lost", 41), (1, 6, None, 51), (9, 9, None, 99_999)], "run_id long, step long, error string")
    stream = replay.run([(scans, "sec"), (found, "sec")], agents.degraded, parts=2)
    got = {r["step"]: (r["verdict"], r["host_up"]) for r in stream.collect()}
    assert got == {1: ("pass", True), 2: ("skip", False), 3: ("pass", False), 4: ("block", True), 5: ("skip", False), 6: ("skip", True), 9: ("pass", True)}
    batch = {r["step"]: (r["verdict"], r["host_up"]) for r in agents.degraded(scans.distinct(), found).collect()}
    assert batch == got


def test_each_kind_of_request_has_its_timeout(spark):
    at = lambda rows, schema: spark.createDataFrame(rows, schema + ", sec long").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    kinds = list(agents.TIMEOUTS)
    asked = at([(i, kinds[i % 3], i) for i in range(30)] + [(99, "scan", 99_999)], "request_id long, kind string")
    delay = {i: agents.TIMEOUTS[kinds[i % 3]] + (i // 3) % 3 - 1 for i in range(27)}
    replied = at([(i, f"r{i}", i + d) for i, d in delay.items()] + [(99, "r", 99_999)], "request_id long, reply string")
    got = replay.run([(asked, "sec"), (replied, "sec")], lambda a, b: agents.correlate(a, b, agents.TIMEOUTS))
    want = {(i, i not in delay or delay[i] > agents.TIMEOUTS[kinds[i % 3]]) for i in range(30)} | {(99, False)}
    assert {(r["request_id"], r["timed_out"]) for r in got.collect()} == want


class Store:
    """State of one group in memory, with the number of calls that it took."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, [], None

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def put(self, held):
        self.update(held)

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, held):
        self.calls += 1
        self.held = held

    def clear(self):
        self.calls, self.held = self.calls + 1, None


@pytest.mark.parametrize("once", [False, True])
def test_a_bucket_of_requests_costs_few_calls_to_its_state(once):
    """Random requests and replies in either order, some sent again, against all pairs; a batch takes two calls however many rows it has."""
    rng = random.Random(7)
    asked = [(k, k * 1_000_000, rng.choice([5, 9]) * 1_000_000) for k in range(400)]
    told = [(k, at + rng.randrange(-1, 11) * 1_000_000, f"r{k}.{i}") for k, at, _ in asked for i in range(rng.choice([0, 1, 2]))]
    sent = [(True, at, own, k, None) for k, at, own in asked] + [(True, at, own, k, None) for k, at, own in asked if once and k % 6 == 0]
    rows = sent + [(False, at, 0, k, r) for k, at, r in told]
    want = {(k, r) for k, at, own in asked for j, t, r in told if j == k and 0 <= t - at <= own}
    want |= {(k, None) for k, _, _ in asked if k not in {w[0] for w in want}}
    bucket, store = agents.Answers(["key"], [], ["reply"], once), Store()
    bucket.init(store)
    got, passed, n = [], 0, 0
    for part in range(5):
        batch = [r for i, r in enumerate(rows) if (r[1] // 1_000_000 + i % 7) // 83 == part or (part == 4 and (r[1] // 1_000_000 + i % 7) // 83 > 4) or (part == 0 and r[1] < 0)]
        n += len(batch)
        rng.shuffle(batch)
        got.append(bucket.ticked(pd.DataFrame(batch, columns=["asks", "at", "own", "key", "reply"]).assign(met=False, fresh=True), passed))
        passed = max(passed, (part + 1) * 83_000_000 - 30_000_000)
    got.append(bucket.ticked(None, 10**10))
    told_of = [(r.key, None if pd.isna(r.reply) else r.reply) for b in got for r in b.itertuples()]
    assert n == len(rows) and sorted(map(str, told_of)) == sorted(map(str, want))
    assert store.calls <= 12 and store.held is None and len(store.timers) == 5


class Handle:
    """The states of one group in memory, with the number of calls that they took."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, [], {}

    def getValueState(self, name, _):
        handle = self

        class State:
            exists = lambda _: bool(handle.states.get(name))
            clear = lambda _: handle.states.pop(name)

            def get(self):
                handle.calls += 1
                return handle.states[name]

            def update(self, held):
                handle.calls += 1
                handle.states[name] = held

            put = update

            def appendValue(self, held):
                self.update([*handle.states.get(name, []), held])

        return State()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_a_bucket_of_clocks_costs_few_calls_a_batch():
    rng = random.Random(11)
    free, want, got = {}, set(), []
    bucket, handle = loop.StepClock(), Handle()
    bucket.init(handle)
    for part in range(3):
        rows = [(run, part * 9 + k, rng.choice([True, False, None]), part * 20_000 + rng.choice([0, 9, 900, 9_000])) for run in range(200) for k in range(9) if (run + part) % 5]
        for run, step, failed, ms in sorted(rows, key=lambda r: (r[3], r[1])):
            start = max(ms, free.get(run, 0))
            free[run] = start + (loop.COOLDOWN_MS if failed else loop.THROTTLE_MS)
            want.add((run, step, start, start - ms))
        rng.shuffle(rows)
        batch = pd.DataFrame(rows, columns=["run_id", "step", "failed", "ms"])
        assert not len(pd.concat(bucket.handleInputRows((0,), iter([batch[::2], batch[1::2]]), handle)))
        handle.passed = part * 20_000 + 5_000
        told = list(bucket.handleExpiredTimer((0,), handle, None))
        assert all((t["started"] <= handle.passed).all() for t in told) and handle.calls <= 8 * (part + 1)
        got += told
    handle.passed = 10**9
    got += [*bucket.handleExpiredTimer((0,), handle, None), *bucket.handleExpiredTimer((0,), handle, None)]
    got = pd.concat(got)
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want and len(handle.timers) == 6


def test_cache_over_batches_equals_one_pass(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for run in range(3):
        held = []
        for step in range(80):
            key = f"k{rng.randrange(9)}"
            want.add((run, step, key in held))
            if key not in held:
                held = [*held, key][-loop.CACHE :]
            rows.append((run, step, key))
    got = replay.run([(spark.createDataFrame(rows, "run_id long, step long, key string"), "step")], loop.cached, parts=4)
    assert {tuple(r) for r in got.collect()} == want


def test_a_bucket_of_caches_costs_two_calls_a_batch():
    bucket, store = loop.Cache(), Store()
    bucket.init(store)
    for part in range(3):
        rows = pd.DataFrame([(run, part * 9 + k, f"k{k % 8}") for run in range(200) for k in range(9)], columns=["run_id", "step", "key"])
        got = pd.concat(bucket.handleInputRows((0,), iter([rows[::2], rows[1::2]]), None))
        assert len(got) == 1800 and store.calls <= 2 * (part + 1) and {r for r, _ in store.held} == set(range(200))


def test_a_bucket_of_questions_costs_two_calls_a_batch():
    class Passed:
        def getCurrentWatermarkInMs(self):
            return 40_000

    bucket, store = agents.Questions(), Store()
    bucket.init(store)
    rows = [(run, 1, "question", None, run) for run in range(300)] + [(run, 1, "answer", "yes", 5_000) for run in range(0, 300, 3)] + [(1, 2, "question", None, 20_000)]
    got = pd.concat(bucket.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["run_id", "seq", "kind", "answer", "ms"])]), None))
    assert len(got) == 101 and store.calls == 1 and store.timers == [25_002] and len(store.held) == 200
    late = pd.concat(bucket.handleExpiredTimer((0,), Passed(), None))
    assert len(late) == 199 and store.calls == 3 and store.held == [(1, 2, 45_000)] and store.timers[-1] == 45_000


def test_a_batch_of_tokens_asks_the_store_once_for_each_value():
    class Map(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Handle:
        def getMapState(self, *_):
            return Map()

    run = agents.TokenMap()
    run.init(Handle())
    rows = pd.DataFrame([(o, "ab"[o % 2], None if o % 10 == 9 else f"v{o % 10}") for o in range(5_000)], columns=["ord", "type", "value"]).sample(frac=1, random_state=1)
    got = pd.concat(run.handleInputRows((4,), iter([rows[:2_000], rows[2_000:]]), None))
    assert len(got) == 5_000 and run.known.calls == 20 and run.top.calls == 4
    names = {(t, v): k // 2 + 1 for k, (t, v) in enumerate(("ab"[o % 2], None if o == 9 else f"v{o}") for o in range(10))}
    assert all(r.token == f"[{r.type.upper()}_{names[r.type, r.value]}]" and r.run_id == 4 for r in got.itertuples())


class Lost(Exception):
    pass


@pytest.mark.parametrize("after", [True, False])
def test_sinks_take_a_batch_once(spark, tmp_path, after):
    """A batch that fails before or after its sink has written is given again when the query is started anew."""
    rng = random.Random(1)
    lessons = [(f"h{rng.randrange(3)}", f"l{rng.randrange(14)}", i) for i in range(90)]
    sessions = [(f"s{i % 40}", "run", "t", i % 40 + i // 80, "done", [f"e{k}" for k in range(i % 50)], ["f"]) for i in range(120)]
    fields = "id string, kind string, task string, started long, status string, entries array<string>, frames array<string>"
    cases = {
        "lessons": (lessons, "host string, lesson string, at long", sinks.lessons_sink, "at"),
        "sessions": (sessions, fields, sinks.sessions_sink, None),
        "log": ([(i, "x" * i) for i in range(30)], "step long, screenshot_b64 string", sinks.capture_log, None),
    }
    for name, (rows, schema, sink, _) in cases.items():
        top, size = tmp_path / name, len(rows) // 3
        df = spark.createDataFrame(rows, schema)
        for k in range(3):
            spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(top / "in"))
        write, failed = sink(str(top / "out")), []

        def flaky(batch, batch_id, write=write, failed=failed):
            if batch_id == 1 and not failed and not after:
                failed.append(1)
                raise Lost
            write(batch, batch_id)
            if batch_id == 1 and not failed:
                failed.append(1)
                raise Lost

        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(top / "in"))
        start = lambda stream=stream, top=top, flaky=flaky: stream.writeStream.foreachBatch(flaky).option("checkpointLocation", str(top / "state")).trigger(availableNow=True).start()
        with pytest.raises(StreamingQueryException):
            start().awaitTermination()
        start().awaitTermination()
        if name == "log":
            got = sinks.batches_of(spark, str(top / "out"), spark.createDataFrame([], "step long, screenshotBytes long").schema)
            assert sorted((r[0], r[1]) for r in got.collect()) == [(i, i) for i in range(30)]
            continue
        got = sinks.newest_version(spark, str(top / "out"), df.schema)
        if name == "lessons":
            want = upsert_lessons(df, "host", "lesson", ["at"]).select("host", "lesson", F.col("at.at").alias("at"))
        else:
            last = {}
            for r in rows:
                if r[0] not in last or len(r[5]) >= len(last[r[0]][5]):
                    last[r[0]] = r
            want = retain(spark.createDataFrame(list(last.values()), fields))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
