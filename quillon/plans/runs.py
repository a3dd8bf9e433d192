"""Step sequences, sessions, receipts, evaluation and streams over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import metrics as M, sessions as S, steps as T
from quillon.plans.derived import STEPS_SQL, steps
from quillon.plans.registry import query
from quillon.sources import io
from quillon.sources.io import table
from quillon.streaming import agents

K, O = ["run_id"], ["step"]
ST = f"({STEPS_SQL})"


@query(f"select run_id, step, coalesce(sig = lag(sig) over w and sig = lag(sig, 2) over w, false) as stuck from {ST} window w as (partition by run_id order by step)")
def stuck_runs(spark: SparkSession, folder: str) -> DataFrame:
    return T.stuck(steps(spark, folder), K, O, "sig").select("run_id", "step", "stuck")


ISLANDS = "sum(case when {0} then 1 else 0 end) over (partition by run_id order by step rows unbounded preceding)"


@query(
    f"""with c as (select *, (lag(sig) over (partition by run_id order by step) is distinct from sig) as chg from {ST}), i as (select *, {ISLANDS.format('chg')} as g from c),
    r as (select run_id, step, cast(row_number() over (partition by run_id, g order by step) - 1 as int) as same_run from i) select run_id, step, same_run, same_run >= 4 as no_progress from r"""
)
def no_progress(spark: SparkSession, folder: str) -> DataFrame:
    return T.no_progress(steps(spark, folder), K, O, "sig").select("run_id", "step", F.col("same_run").cast("int").alias("same_run"), "no_progress")


@query(
    f"""with i as (select *, {ISLANDS.format('not blocked')} as g from {ST}) select run_id, step, cast(case when blocked then sum(case when blocked then 1 else 0 end) over (partition by run_id, g order by step rows unbounded preceding) else 0 end as bigint) as streak from i"""
)
def blocked_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return T.streak(steps(spark, folder), K, O, F.col("blocked"), "streak").select("run_id", "step", F.col("streak").cast("long").alias("streak"))


@query(
    f"""with i as (select *, {ISLANDS.format("not blocked and sig <> 'view'")} as g from {ST}) select run_id, step, cast(case when blocked then sum(case when blocked then 1 else 0 end) over (partition by run_id, g order by step rows unbounded preceding) else 0 end as bigint) as failures from i"""
)
def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return T.streak(steps(spark, folder), K, O, F.col("blocked"), "failures", keep=F.col("sig") == "view").select("run_id", "step", F.col("failures").cast("long").alias("failures"))


@query(f"select run_id, step, coalesce(sig = 'click' and lag(sig) over w = 'click' and lag(tgt) over w = tgt, false) as forgot from (select *, event_id % 3 as tgt from {ST}) window w as (partition by run_id order by step)")
def forgot_to_type(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).withColumn("tgt", F.col("event_id") % 3)
    return T.forgot_to_type(s, K, O, "sig", "tgt").select("run_id", "step", "forgot")


@query(f"select run_id, step, cast(coalesce(greatest(0, 60000000 - (t - lag(t) over w)), 0) as bigint) as delay_ms from (select *, epoch_us(ts) // 1000 as t from {ST}) window w as (partition by run_id order by step)")
def capture_throttle(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))
    return T.capture_delay(s, K, O, F.col("t"), 60000000).select("run_id", "step", "delay_ms")


#: One attempt after another: the next one a day or more after the last that was made.
@query(
    """with recursive t as (select user_id as run_id, epoch_ms(ts) as t from events), c as (select run_id, count(*) as n_asked from t group by run_id),
    f as (select run_id, min(t) as t, 1 as k from t group by run_id union all select f.run_id, (select min(t.t) from t where t.run_id = f.run_id and t.t >= f.t + 86400000), f.k + 1 from f where exists (select 1 from t where t.run_id = f.run_id and t.t >= f.t + 86400000))
    select c.run_id, n_asked, cast(max(k) as int) as n_made from c join f using (run_id) group by c.run_id, n_asked"""
)
def cooldown_attempts(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).withColumn("t", X.rounded_millis(F.col("ts").cast("timestamp")))
    a = s.groupBy("run_id").agg(T.cooldown(F.collect_list("t"), 86400000).alias("made"), F.count("*").alias("n_asked"))
    return a.select("run_id", "n_asked", F.size("made").alias("n_made"))


@query(
    f"""with recursive s as (select run_id, step, concat(sig, '-', cast(event_id % 4 as varchar)) as key from {ST}),
    f(run_id, step, held, hits) as (select distinct run_id, 0, cast([] as varchar[]), 0 from s
      union all select s.run_id, s.step, case when list_contains(held, key) then held else list_append(held, key)[-6:] end, hits + case when list_contains(held, key) then 1 else 0 end from f join s on s.run_id = f.run_id and s.step = f.step + 1)
    select run_id, cast(max(step) as int) as n, cast(max(hits) as int) as n_hits from f group by run_id"""
)
def fifo_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).withColumn("key", F.concat_ws("-", "sig", (F.col("event_id") % 4).cast("string")))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("step", "key"))), lambda x: x["key"])
    hits = s.groupBy("run_id").agg(T.fifo_hits(keys).alias("hits"))
    return hits.select("run_id", F.size("hits").alias("n"), F.size(F.filter("hits", lambda x: x)).alias("n_hits"))


@query(f"select run_id, count(*) filter (where ok) as n_durable from (select run_id, lead(sig) over (partition by run_id order by step) <> 'error' as ok, sig from {ST}) where sig = 'click' group by run_id")
def durable_lessons(spark: SparkSession, folder: str) -> DataFrame:
    s = steps(spark, folder).withColumn("lesson", F.when(F.col("sig") == "click", "clicked"))
    kept = T.durable_lessons(s, K, O, "lesson", F.col("sig") != "error").groupBy("run_id").agg(F.count("*").alias("n"))
    every = s.where("lesson is not null").select("run_id").distinct()
    return every.join(kept, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_durable"))


@query(f"select run_id, step, cast(n as bigint) as recoveries, n > 3 as stop from (select run_id, step, {ISLANDS.format('blocked')} as n from {ST})")
def recovery_limit(spark: SparkSession, folder: str) -> DataFrame:
    return T.recoveries(steps(spark, folder), K, O, F.col("blocked")).select("run_id", "step", "recoveries", "stop")


@query(f"select sig, case when step = 1 then 'first' else 'subsequent' end as part, count(*) as n, cast(sum(cast(ms as decimal(18, 4))) as double) as total from {ST} group by all")
def first_vs_subsequent(spark: SparkSession, folder: str) -> DataFrame:
    s = T.first_and_rest(steps(spark, folder), K, O)
    return s.groupBy("sig", "part").agg(F.count("*").alias("n"), F.sum(F.col("ms").cast("decimal(18,4)")).cast("double").alias("total"))


NEAREST = "list_sort(list(value))[cast(least(count(*) - 1, floor(count(*) * {0})) as bigint) + 1]"


@query(f"select event_type, {NEAREST.format(0.5)} as p50, {NEAREST.format(0.95)} as p95, min(value) as min, max(value) as max, count(*) as n from events where value is not null group by event_type")
def percentile_nearest_index(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return M.ranked_percentiles(e, ["event_type"], "value", (0.5, 0.95))


@query("select list_sort(list(value))[cast(least(count(*) - 1, floor(count(*) * 0.5)) as bigint) + 1] as p50, list_sort(list(value))[cast(least(count(*) - 1, floor(count(*) * 0.95)) as bigint) + 1] as p95, min(value) as min, max(value) as max, count(*) as n from events where value is not null")
def percentiles_overall(spark: SparkSession, folder: str) -> DataFrame:
    return M.ranked_percentiles(table(spark, folder, "events"), [], "value", (0.5, 0.95))


@query(
    """with l as (unpivot (select event_type, value as upload, value * 2 as vlm, value + 1 as execute from events where value is not null) on upload, vlm, execute into name phase value ms)
    select event_type, phase, round(avg(ms), 4) as mean, list_sort(list(ms))[cast(least(count(*) - 1, floor(count(*) * 0.5)) as bigint) + 1] as p50, list_sort(list(ms))[cast(least(count(*) - 1, floor(count(*) * 0.95)) as bigint) + 1] as p95, count(*) as n from l group by event_type, phase"""
)
def latency_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("value is not null").select("event_type", F.col("value").alias("upload"), (F.col("value") * 2).alias("vlm"), (F.col("value") + 1).alias("execute"))
    return M.waterfall(e, ["event_type"], ["upload", "vlm", "execute"]).select("event_type", "phase", F.round("mean", 4).alias("mean"), "p50", "p95", "n")


@query(
    """with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as session from conversations)
    select conv_id, cast(session as bigint) as session, count(*) as n_entries, coalesce(arg_max(role, turn) filter (where role <> 'user'), 'running') as status from s where session > 0 group by conv_id, session"""
)
def session_markers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return S.session_states(c, ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") != "user", F.col("role"))


@query(
    """with g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k"""
)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    # a batch form of the stream: sessions end after six hours without an event
    return agents.event_sessions(table(spark, folder, "events"), gap="6 hours").select("user_id", "start", "n")


@query(
    """with r as (select conv_id, turn, role as type, concat('[', upper(role), '_', cast(turn % 3 as varchar), ']') as token from conversations),
    t as (select conv_id, string_agg(token, ',' order by first_turn, token) as tokens from (select conv_id, token, min(turn) as first_turn from r group by all) group by conv_id),
    b as (select conv_id, string_agg(concat(type, '=', cast(n as varchar)), ',' order by concat(type, '=', cast(n as varchar))) as by_type from (select conv_id, type, count(*) as n from r group by all) group by conv_id)
    select r.conv_id, count(*) as protected, any_value(by_type) as by_type, any_value(tokens) as tokens, case when max(turn) > 4 then 'block' else 'pass' end as verdict from r join t using (conv_id) join b using (conv_id) group by r.conv_id"""
)
def receipt_by_conversation(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    r = c.select("conv_id", "turn", F.col("role").alias("type"), F.concat(F.lit("["), F.upper("role"), F.lit("_"), (F.col("turn") % 3).cast("string"), F.lit("]")).alias("token"))
    v = c.select("conv_id", F.when(F.col("turn") > 4, "block").otherwise("pass").alias("verdict"))
    return S.receipt(r, v, ["conv_id"], "turn")


@query("select conv_id, string_agg(role, '>' order by turn) as trail, count(*) as n from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 6 group by conv_id")
def last_k_history(spark: SparkSession, folder: str) -> DataFrame:
    c = S.newest(table(spark, folder, "conversations"), ["conv_id"], [F.col("turn").desc()], 6)
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return c.groupBy("conv_id").agg(trail.alias("trail"), F.count("*").alias("n"))


@query(
    """with l as (select event_type as host, concat('lesson ', cast(user_id % 40 as varchar)) as lesson, max(event_id) as last_event from events group by all) select host, lesson, last_event from l qualify row_number() over (partition by host order by last_event desc, lesson) <= 8"""
)
def lessons_top8(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("host"), F.concat(F.lit("lesson "), (F.col("user_id") % 40).cast("string")).alias("lesson"), "event_id")
    return S.upsert_lessons(e, "host", "lesson", ["event_id"]).select("host", "lesson", F.col("at.event_id").alias("last_event"))


@query(
    f"""with d as (select *, lead(sig) over w as nxt, lead(step) over w as ns from {ST} window w as (partition by run_id order by step)), k as (select * from d where nxt is null or nxt <> sig)
    select run_id, step, sig from k qualify row_number() over (partition by run_id order by step desc) <= 12"""
)
def film_frames(spark: SparkSession, folder: str) -> DataFrame:
    d = S.tail_distinct(steps(spark, folder), K, O, ["sig"])
    return S.newest(d, K, [F.col("step").desc()], 12).select("run_id", "step", "sig")


@query(f"select run_id, count(distinct sig) as n_left from {ST} s where not exists (select 1 from {ST} h where h.run_id = s.run_id and h.sig = s.sig and h.step <= 3) group by run_id")
def repeat_veto(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.operators.actions import veto_repeats

    s = steps(spark, folder)
    return veto_repeats(s, s.where("step <= 3"), K).groupBy("run_id").agg(F.countDistinct("sig").alias("n_left"))


@query(
    """with l as (select avg(quality) as q, avg(toxic) as t, count(*) as n from labels), o as (select count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end) / count(*) as f from orders)
    select round(least(q, 1.0), 6) as quality, round(1 - t, 6) as clean, round(f, 6) as finished, round(q * 0.25 + (1 - t) * 0.20 + f * 0.20 + case when l.n > 100 then 0.20 else 0 end + 0.15, 6) as score from l cross join o"""
)
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    la = table(spark, folder, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.count("*").alias("n"))
    o = table(spark, folder, "orders").agg((F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) / F.count("*")).alias("f"))
    j = la.crossJoin(F.broadcast(o))
    score = M.scorecard([F.col("q"), 1 - F.col("t"), F.col("f"), F.when(F.col("n") > 100, 1.0).otherwise(0.0), F.lit(1.0)])
    return j.select(F.round("q", 6).alias("quality"), F.round(1 - F.col("t"), 6).alias("clean"), F.round("f", 6).alias("finished"), F.round(score, 6).alias("score"))


@query("select cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) as int) as k, count(*) as n from events group by 1")
def props_json(spark: SparkSession, folder: str) -> DataFrame:
    e = io.from_json_rows(table(spark, folder, "events"), "props", "k int")
    return e.groupBy(F.col("parsed.k").alias("k")).agg(F.count("*").alias("n"))


@query(
    """select conv_id, count(*) as n_deltas, string_agg(role, '' order by turn) as joined from conversations group by conv_id"""
)
def sse_decode(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").withColumn("frame", io.sse_frame(F.lit("thought"), F.to_json(F.struct("role"))))
    body = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), "").alias("body"))
    e = io.sse_events(body, ["conv_id"], "body").withColumn("role", F.get_json_object("data", "$.role"))
    return e.groupBy("conv_id").agg(F.count("*").alias("n_deltas"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role"))), lambda x: x["role"]), "").alias("joined"))


@query("select user_id, cast(epoch_us(ts) // 60000 as bigint) as bucket, count(*) as n, string_agg(event_type, '' order by event_id) as text from events group by 1, 2")
def token_flush_60ms(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("delta"), F.col("ts").cast("timestamp").alias("ts"))
    bucket = F.floor(F.unix_micros("flushed") / 60_000).cast("long")
    return agents.flush_tokens(e).select(F.col("run_id").alias("user_id"), bucket.alias("bucket"), "n", "text")


CONTACT = "concat(text, case when conv_id % 3 = 0 then concat(' mail me at user', cast(conv_id as {0}), '@mail.example') else '' end)"


@query(
    f"""with c as (select role, conv_id, turn, len(regexp_extract_all({CONTACT.format('varchar')}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) as k from conversations)
    select role, count(*) as n, cast(sum(k) as bigint) as n_values, count(*) filter (where k = 0) as n_passed from c group by role"""
)
def conversation_guard(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.operators import gate

    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.expr(CONTACT.format("string")).alias("text"))
    hits = gate.violations(c, ["conv_id", "turn", "role"], ["text"])
    p = gate.passes(hits, ["conv_id", "turn", "role"], c)
    return p.groupBy("role").agg(F.count("*").alias("n"), F.sum("n_hits").alias("n_values"), F.count_if("passed").alias("n_passed"))
