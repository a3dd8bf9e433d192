"""Streams of the agent loop over the event tables: replies that time out, degraded steps, cut event streams, throttles,
the cache, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.checkpoint import durable, remove
from quillon.functions.text import rounded_millis
from quillon.plans.derived import steps
from quillon.plans.registry import query
from quillon.plans.runs import ST
from quillon.sources import io
from quillon.sources.io import capture_rows, table
from quillon.streaming import agents, loop, replay, sinks


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.unix_micros("ts"))


def later(rows: DataFrame, seconds: Column) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + seconds.cast("long") * 1_000_000))


def tick(rows: DataFrame, seconds: int = 7200) -> DataFrame:
    """One more row, hours after the last, with negative ids, so that the watermark passes all others."""
    blank = [F.lit(-1).cast(t).alias(c) if t in ("bigint", "int") else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "ts"]
    last = later(rows.agg(F.max("ts").alias("ts")), F.lit(seconds)).select(*blank, "ts").select(*rows.columns)
    return rows.union(last)


DELAY = "case event_id % 8 when 0 then 10 when 1 then 40 when 2 then 41 when 3 then 90 when 4 then 91 when 5 then 150 when 6 then 151 end"
KIND = "case event_id % 3 when 0 then 'scan' when 1 then 'step' else 'warm' end"
LIMIT = f"case {KIND} when 'scan' then 40 when 'step' then 90 else 150 end"


@query(f"select event_id as request_id, {KIND} as kind, case when {DELAY} <= {LIMIT} then concat('r', cast(event_id as varchar)) end as reply, coalesce({DELAY}, 999) > {LIMIT} as timed_out from events")
def correlate_stream(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    asked = tick(e.select(F.col("event_id").alias("request_id"), F.expr(KIND).alias("kind"), "ts"))
    replied = later(e.where("event_id % 8 < 7"), F.expr(DELAY)).select(F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reply"))
    out = replay.run([(timed(asked), "at"), (timed(tick(replied)), "at")], lambda a, b: agents.correlate(a, b, agents.TIMEOUTS))
    return out.where("request_id >= 0").select("request_id", "kind", "reply", "timed_out")


FOUND = "case when event_id % 4 = 0 then null when event_id % 5 = 0 then 10 when event_id % 5 = 1 then 39 when event_id % 5 = 2 then 40 when event_id % 5 = 3 then 41 else 100 end"
HITS = "case when event_id % 13 = 0 then null when event_id % 11 = 0 then 2 else 0 end"
UP = f"(coalesce({FOUND}, 999) <= 40 and event_id % 7 <> 0)"


@query(
    f"""select user_id as run_id, event_id as step, {UP} as host_up,
    case when coalesce({HITS}, 0) > 0 then 'block' when event_id % 3 = 0 then 'pass' when {UP} and {HITS} is not null then 'pass' else 'skip' end as verdict from events"""
)
def degraded_stream(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    keys = [F.col("user_id").alias("run_id"), F.col("event_id").alias("step")]
    scans = e.select(*keys, "ts", (F.col("event_id") % 3).alias("regions"), F.expr(HITS).alias("hits"))
    found = later(e.where("event_id % 4 <> 0"), F.expr(FOUND)).select(*keys, "ts", F.when(F.col("event_id") % 7 == 0, "lost").alias("error"))
    again = tick(scans).union(scans.where("step % 6 = 0"))
    return replay.run([(timed(again), "at"), (timed(tick(found)), "at")], agents.degraded).where("step >= 0").select("run_id", "step", "host_up", "verdict")


@query(
    """with f as (select conv_id, turn, role, min(turn) filter (where turn >= 4) over (partition by conv_id) as ends from conversations), k as (select * from f where ends is null or turn <= ends)
    select conv_id, count(*) filter (where turn % 5 <> 3) as n_thoughts, coalesce(string_agg(concat(role, 'é'), '' order by turn) filter (where turn % 5 <> 3), '') as text,
    '{"turn":' || cast(max(ends) as varchar) || '}' as action, '{"message":"m' || cast(max(turn) filter (where turn % 4 = 2) as varchar) || '"}' as error from k group by conv_id"""
)
def sse_stream(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    turn = F.col("turn").cast("string")
    line = lambda name, data: F.concat(F.lit(f"event: {name}\r\ndata: "), data, F.lit("\n\n"))
    thought = F.when(F.col("turn") % 5 == 3, F.lit('{"delta":')).otherwise(F.concat(F.lit('{"delta":"'), "role", F.lit('é"}')))
    told = F.concat(
        line("thought", thought),
        F.when(F.col("turn") % 4 == 2, line("error", F.concat(F.lit('{"message":"m'), turn, F.lit('"}')))).otherwise(""),
        F.when(F.col("turn") >= 4, line("action", F.concat(F.lit('{"turn":'), turn, F.lit("}")))).otherwise(""),
    )
    body = c.select("conv_id", "turn", told.alias("told")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "told"))), lambda x: x["told"]), "").cast("binary").alias("body"))
    cut = body.select(F.col("conv_id").alias("run_id"), "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - 1, F.lit(7))).alias("at"))
    chunks = cut.select("run_id", "at", F.substring("body", F.col("at") + 1, F.lit(7)).alias("chunk"))
    got = replay.run([(chunks, "at")], loop.frames)
    pieces = F.array_sort(F.collect_list(F.when(F.col("event") == "thought", F.struct("seq", F.get_json_object("data", "$.delta").alias("d")))))
    said = got.groupBy("run_id").agg(
        F.count_if(F.col("event") == "thought").alias("n_thoughts"),
        F.array_join(F.transform(pieces, lambda x: x["d"]), "").alias("text"),
        F.max(F.when(F.col("event") == "action", F.col("data"))).alias("action"),
        F.max_by("data", F.when(F.col("event") == "error", F.col("seq"))).alias("error"),
    )
    every = c.select(F.col("conv_id").alias("run_id")).distinct()
    return every.join(said, "run_id", "left").select(F.col("run_id").alias("conv_id"), F.coalesce("n_thoughts", F.lit(0)).alias("n_thoughts"), F.coalesce("text", F.lit("")).alias("text"), "action", "error")


ASKED = "epoch_ms(ts) // 100000"


@query(
    f"""with e as (select user_id as run_id, event_id as step, {ASKED} as ms, case when event_type = 'error' then 18000 else 750 end as gap from events),
    s as (select *, coalesce(sum(gap) over (partition by run_id order by ms, step rows between unbounded preceding and 1 preceding), 0) as before from e),
    k as (select run_id, step, ms, before + max(ms - before) over (partition by run_id order by ms, step rows unbounded preceding) as started from s)
    select run_id, step, cast(started as bigint) as started, cast(started - ms as bigint) as waited from k"""
)
def step_clock_stream(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.call_function("div", rounded_millis(F.col("ts")), F.lit(100_000).cast("long"))
    e = events(spark, folder).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), (F.col("event_type") == "error").alias("failed"), F.timestamp_millis(ms).alias("ts"))
    # a tick after the last step's time and all gaps of any run: by then every step may start, and the watermark lets it go
    gap = F.when(F.col("failed"), loop.COOLDOWN_MS).otherwise(loop.THROTTLE_MS)
    spent = e.groupBy("run_id").agg(F.sum(gap).alias("gaps")).agg(F.max("gaps")).first()[0] or 0
    return replay.run([(timed(tick(e, -(-spent // 1000) + 601)), "at")], loop.clocked).where("step >= 0").select("run_id", "step", "started", "waited")


@query(
    f"""with recursive s as (select run_id, step, concat(sig, '-', cast(event_id % 4 as varchar)) as key from {ST}),
    f(run_id, step, held, hit) as (select distinct run_id, 0, cast([] as varchar[]), false from s
      union all select s.run_id, s.step, case when list_contains(held, key) then held else list_append(held, key)[-6:] end, list_contains(held, key) from f join s on s.run_id = f.run_id and s.step = f.step + 1)
    select run_id, cast(step as bigint) as step, hit from f where step > 0"""
)
def fifo_cache_stream(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).select("run_id", F.col("step").cast("long").alias("step"), F.concat_ws("-", "sig", (F.col("event_id") % 4).cast("string")).alias("key"))
    return replay.run([(s, "step")], loop.cached)


@query("select event_type as host, concat('lesson ', cast(user_id % 40 as varchar)) as lesson, max(event_id) as at from events group by 1, 2 qualify row_number() over (partition by event_type order by max(event_id) desc, lesson) <= 8")
def lessons_stream(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("host"), F.concat(F.lit("lesson "), (F.col("user_id") % 40).cast("string")).alias("lesson"), F.col("event_id").alias("at"))
    return replay.merged_table(e, "at", sinks.lessons_sink)


@query("select conv_id, turn, role, cast(length(text) as bigint) as \"screenshotBytes\" from conversations")
def capture_stream(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("screenshot_b64"))
    return replay.run([(c, "conv_id")], capture_rows)


@query("select n_regionkey as region, string_agg(n_name, ',' order by n_name) as names, count(*) as n from nation group by n_regionkey")
def artifact_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document, written and read again; a path that is not there has no rows."""
    top = replay.folder(spark)
    n = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n"))
    io.write_json(n.agg(F.collect_list(F.struct("region", "names", "n")).alias("regions")).coalesce(1), f"{top}/regions")
    schema = "regions array<struct<region:int,names:string,n:bigint>>"
    read = io.json_artifact(spark, f"{top}/regions", schema).unionByName(io.json_artifact(spark, f"{top}/missing", schema))
    kept = durable(read.select(F.explode("regions").alias("r")).select("r.*"))
    remove(spark, top)
    return kept


@query("select user_id, cast(epoch_us(ts) // 60000 as bigint) as bucket, count(*) as n, string_agg(event_type, '' order by event_id) as text from events group by 1, 2")
def token_flush_stream(spark: SparkSession, folder: str) -> DataFrame:
    """As the batch form; a window leaves when the watermark has passed its end."""
    e = tick(events(spark, folder).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("delta"), "ts"))
    out = replay.run([(timed(e), "at")], agents.flush_tokens).where("run_id >= 0")
    return out.select(F.col("run_id").alias("user_id"), F.floor(F.unix_micros("flushed") / 60_000).cast("long").alias("bucket"), "n", "text")


@query(
    """with g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k"""
)
def event_sessions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions end after six hours without an event and leave by the watermark; one that two batches share is one."""
    e = tick(table(spark, folder, "events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts")), 100_000)
    out = replay.run([(timed(e), "at")], lambda s: agents.event_sessions(s, gap="6 hours")).where("user_id >= 0")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")
