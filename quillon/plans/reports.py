"""Reports over traces, labelled pages and redaction logs; question and retry behaviour; stream replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import metrics as M, perception as P, redactions as D, reports as R, sessions as S
from quillon.plans.derived import BOX_SQL, KYC_SQL, boxes, kyc, steps
from quillon.plans.registry import query
from quillon.sources import io
from quillon.sources.io import table
from quillon.streaming import agents, replay

TRACE = [
    "user_id as run_id",
    "event_id as step",
    "cast(event_id % 50 as int) as capture",
    "cast(event_id % 7 as int) as serialize",
    "cast(event_id * 3 % 40 as int) as sanitize",
    "case when event_id % 4 = 0 then null else cast(event_id * 7 % 300 as int) end as vision",
    "cast(event_id % 90 as int) as perception",
    "cast(event_id * 11 % 500 as int) as upload",
    "cast(event_id * 13 % 700 as int) as vlm",
    "cast(event_id % 30 as int) as execute",
    "case when event_id % 5 = 0 then 100 end as rethink",
    "event_type as sig",
]
TRACE_SQL = "select " + ", ".join(TRACE) + " from events"
INT_PHASES = ("capture", "serialize", "sanitize", "vision", "perception", "upload", "vlm", "execute", "rethink")
MEAN = "round(cast(sum(coalesce({0}, 0)) as double) / count(*), 1) as {0}"
E2E = "coalesce(capture, 0) + coalesce(serialize, 0) + coalesce(sanitize, 0) + coalesce(vision, 0) + coalesce(upload, 0) + coalesce(execute, 0) + coalesce(rethink, 0)"


def traces(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*TRACE)


@query(f"select run_id, count(*) as n_steps, cast(sum({E2E}) as bigint) as e2e_ms, {', '.join(MEAN.format(p) for p in INT_PHASES)} from ({TRACE_SQL}) group by run_id")
def run_latency(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_latency(traces(spark, folder), ["run_id"])


@query(
    f"""with r as (select run_id, run_id % 4 as suite, count(*) as n, bool_or(sig = 'purchase') as done from ({TRACE_SQL}) group by run_id)
    select suite, count(*) filter (where done) as passed, count(*) as total, round(count(*) filter (where done) / count(*), 2) as rate, round(sum(n) / count(*), 1) as mean_steps, min(n) as min_steps, max(n) as max_steps from r group by suite"""
)
def success_rates(spark: SparkSession, folder: str) -> DataFrame:
    runs = traces(spark, folder).groupBy("run_id").agg(F.count("*").alias("n_steps"), F.bool_or(F.col("sig") == "purchase").alias("done"))
    return R.success_rate(runs.withColumn("suite", F.col("run_id") % 4), ["suite"])


VISION = [
    "l_orderkey % 20 as suite",
    "l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber as ord",
    "cast(l_partkey % 90 as int) as face_ms",
    "cast(l_suppkey % 700 as int) as ocr_ms",
    "cast(l_linenumber % 3 as int) as faces",
    "cast(l_linenumber as int) as regions",
    "cast(l_partkey % 2 as int) as hits",
    "cast(l_suppkey % 3 as int) * 10 as models_mb",
    "case when l_partkey % 3 = 0 then 'no-canvas' when l_partkey % 3 = 1 then 'small' end as reason",
]
VISION_SQL = "select " + ", ".join(VISION) + " from lineitem"


@query(
    f"""with v as ({VISION_SQL}), s as (select suite, reason, min(ord) as first_ord from v where reason is not null group by all)
    select v.suite, round(sum(face_ms) / count(*), 1) as face_ms, round(sum(ocr_ms) / count(*), 1) as ocr_ms, cast(sum(faces) as bigint) as faces, cast(sum(regions) as bigint) as regions, cast(sum(hits) as bigint) as hits,
    coalesce(arg_max(models_mb, ord) filter (where models_mb <> 0), 0) as models_mb, (select string_agg(reason, ',' order by first_ord) from s where s.suite = v.suite) as skipped from v group by v.suite"""
)
def vision_totals(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "lineitem").selectExpr(*VISION).withColumn("skipped", F.array_compact(F.array("reason")))
    return R.vision_totals(v, ["suite"], "ord").withColumn("skipped", F.array_join("skipped", ","))


SEEN = ["o_custkey % 25 as suite", "o_orderkey % 5 <> 0 as enabled", "cast(o_orderkey % 400 as int) as ms", "cast(o_custkey % 4 as int) as photo", "cast(o_orderkey % 3 as int) as ui", "cast(o_orderkey % 7 as int) as escalate", "cast(o_custkey % 3 as int) as ocr_priority"]


@query(
    f"""select suite, count(*) filter (where enabled) as pages_enabled, round(sum(ms) filter (where enabled) / count(*) filter (where enabled), 1) as ms, cast(sum(photo) filter (where enabled) as bigint) as photo,
    cast(sum(ui) filter (where enabled) as bigint) as ui, cast(0 as bigint) as blank, cast(sum(escalate) filter (where enabled) as bigint) as escalate, cast(sum(ocr_priority) filter (where enabled) as bigint) as ocr_priority from (select {', '.join(SEEN)} from orders) group by suite"""
)
def perception_totals(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").selectExpr(*SEEN).withColumn("summary", F.create_map(F.lit("photo"), "photo", F.lit("ui"), "ui"))
    return R.perception_totals(o, ["suite"], P.TAG_ORDER).select("suite", "pages_enabled", "ms", "photo", "ui", "blank", "escalate", "ocr_priority")


@query(
    f"""with w as (select avg(vlm) as vlm, avg(execute) as execute from ({TRACE_SQL})), s as (select avg(capture) as capture, avg(vision) as vision from ({TRACE_SQL}) where step % 2 = 0)
    select round(vlm + execute + capture + vision, 6) as ms from w cross join s"""
)
def step_e2e(spark: SparkSession, folder: str) -> DataFrame:
    t = traces(spark, folder)
    one = t.agg(F.avg("vlm").alias("vlm"), F.avg("execute").alias("execute"))
    two = t.where("step % 2 = 0").agg(F.avg("capture").alias("capture"), F.avg("vision").alias("vision"), F.avg(F.lit(None).cast("double")).alias("gate"))
    # both are one row
    ms = R.step_time([F.col(c) for c in ("vlm", "execute", "capture", "vision", "gate")])
    return one.crossJoin(F.broadcast(two)).select(F.round(ms, 6).alias("ms"))


CATS = "case event_id % 6 when 0 then ' SSN' when 1 then 'dob' when 2 then 'email' when 3 then 'none' when 4 then null else 'mystery' end"


@query(
    f"""select event_type, count(*) filter (where event_id % 6 in (0, 1)) as out_of_scope, count(*) filter (where value > 50) as tagged, count(*) filter (where event_id % 6 = 2) as supported,
    count(*) filter (where event_id % 6 in (3, 4)) as benign, count(*) filter (where event_id % 6 = 5) as other from events group by event_type"""
)
def label_backlog(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", F.expr(CATS).alias("cat"), (F.col("value") > 50).alias("phase2"))
    kind = R.label_class(F.col("cat"))
    more = e.groupBy("event_type").agg(*[F.count_if(kind == k).alias(k) for k in ("supported", "benign", "other")])
    return R.backlog(e, ["event_type"]).join(more, "event_type")


@query("select event_type, count(*) filter (where value > 30) as passed, count(*) filter (where value <= 30 or value is null) as failed from events group by event_type")
def suite_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.suite_counts(table(spark, folder, "events").withColumn("ok", F.col("value") > 30), ["event_type"])


@query("select run, type, count(*) as n from (select user_id % 50 as run, case when event_id % 3 = 0 then 'image' else event_type end as type from events) group by run, type")
def redactions_by_type(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, "vision").otherwise("dom").alias("source"))
    return R.redactions_by_type(e, ["run"])


TASKS = "case conv_id % 3 when 0 then 'flight-booking' when 1 then 'bank-transfer' else 'pii-in-the-wild' end"
PATHS = "case turn % 4 when 0 then '/a/flight-payment.html' when 1 then 'bank-transfer-details.html' else '/index.html' end"
ANSWERS = "case turn % 5 when 0 then 'Mail SUPPORT@invoices.example, call 99887 76655' when 1 then 'support@invoices and zzzpm1234q, 3456 7890 1234' when 2 then 'only 99887' when 3 then '' end"


@query(
    """select conv_id, turn, case conv_id % 3 when 0 then case when turn % 4 = 0 then 'reached payment step' when turn % 2 = 1 then 'passenger form correctly filled' end
      when 1 then case when turn % 4 = 1 then 'reached transfer details step' end
      else case turn % 5 when 0 then 'reported public contact info and redacted IDs (hits=2)' when 1 then 'partial' when 2 then 'partial' end end as outcome from conversations"""
)
def task_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(TASKS).alias("task"), F.expr(PATHS).alias("path"), F.when(F.col("turn") % 2 == 1, "1").alias("complete"), F.expr(ANSWERS).alias("answer"))
    return c.select("conv_id", "turn", R.task_outcome(F.col("task"), F.col("path"), F.col("complete"), F.col("answer")).alias("outcome"))


@query(
    """with a as (select o_custkey, o_orderkey, o_orderkey % 3 = 0 as ok, row_number() over (partition by o_custkey order by o_orderkey) as attempt from orders), f as (select o_custkey, min(attempt) filter (where ok) as first_ok from a group by o_custkey)
    select o_custkey, o_orderkey, cast(attempt as int) as attempt, cast(case when ok then 0 else attempt * 600 end as int) as wait_ms from a join f using (o_custkey) where attempt <= 3 and attempt <= coalesce(first_ok, 3)"""
)
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("ok"))
    return R.retry_schedule(o, ["o_custkey"], "o_orderkey", "ok").select("o_custkey", "o_orderkey", "attempt", F.col("wait_ms").cast("int").alias("wait_ms"))


ASKED = "select conv_id as run_id, turn as seq, conv_id * 1000000 + turn * 20000 + (turn % 3) * 9000 as asked from conversations"
ANSWERED = "select conv_id as run_id, turn as seq, conv_id * 1000000 + turn * 20000 + (turn % 3) * 9000 + (turn * 7919 + conv_id * 31) % 40 * 1000 as answered, case when turn % 5 = 0 then '' else role end as answer from conversations where turn % 4 <> 3"
OUTCOMES = f"""with q as (select *, least(asked + 25000, coalesce(lead(asked) over (partition by run_id order by seq), asked + 25000)) as till from ({ASKED})),
  a as (select run_id, seq, arg_min(answer, answered) as answer from q join ({ANSWERED}) using (run_id, seq) where answered >= asked and answered < till and answer <> '' group by run_id, seq)
  select run_id, seq, case when answer is null then 'skipped' else 'answered' end as outcome, coalesce(answer, '') as answer from q left join a using (run_id, seq)"""


@query(OUTCOMES)
def question_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "conversations").createOrReplaceTempView("conversations")
    return R.question_outcomes(spark.sql(ASKED), spark.sql(ANSWERED), ["run_id"])


@query(OUTCOMES)
def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "conversations").createOrReplaceTempView("conversations")
    q = spark.sql(ASKED).select("run_id", "seq", F.lit("question").alias("kind"), F.lit(None).cast("string").alias("answer"), F.col("asked").alias("at"))
    a = spark.sql(ANSWERED).select("run_id", "seq", F.lit("answer"), "answer", "answered")
    # last of all a tick in each run, after every timer
    tick = q.groupBy("run_id").agg(F.lit(-1).cast("long"), F.lit("tick"), F.lit(None).cast("string"), (F.max("at") + 100_000).alias("at"))
    rows = q.union(a).union(tick)
    # whole runs lie in one batch each, as their clocks differ
    timed = rows.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("at") % 1_000_000))
    return replay.run([(timed, "run_id")], agents.question_outcomes)


STEPS_IN = "select user_id as run_id, epoch_us(ts) as t, event_id, event_type as sig, event_type = 'error' as blocked from events"


@query(
    f"""with s as (select *, row_number() over w as k, (lag(sig) over w is distinct from sig) as chg, coalesce(sig = lag(sig) over w and sig = lag(sig, 2) over w, false) as stuck from ({STEPS_IN}) window w as (partition by run_id order by t, event_id)),
    i as (select *, sum(chg::int) over (partition by run_id order by k rows unbounded preceding) as g, sum((not blocked)::int) over (partition by run_id order by k rows unbounded preceding) as b from s),
    r as (select *, row_number() over (partition by run_id, g order by k) - 1 as same, case when blocked then sum(blocked::int) over (partition by run_id, b order by k rows unbounded preceding) else 0 end as streak from i)
    select run_id, count(*) as n_steps, cast(max(same) as int) as max_same, cast(max(streak) as int) as max_blocked, cast(sum(stuck::int) as int) as stuck_steps from r group by run_id"""
)
def step_stream(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").cast("int").alias("step"), F.col("event_type").alias("sig"), (F.col("event_type") == "error").alias("blocked"))
    return replay.run([(e, "ts")], agents.step_counters, "update").select("run_id", "n_steps", "max_same", "max_blocked", "stuck_steps")


@query(
    """with v as (select user_id % 60 as run_id, event_id as ord, event_type as type, concat('v', cast(event_id * 7 % 13 as varchar)) as value from events), f as (select run_id, type, value, min(ord) as o from v group by all),
    n as (select *, row_number() over (partition by run_id, type order by o) as k from f) select run_id, ord, type, value, concat('[', upper(type), '_', cast(k as varchar), ']') as token from v join n using (run_id, type, value)"""
)
def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "events").select((F.col("user_id") % 60).alias("run_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("type"), F.concat(F.lit("v"), (F.col("event_id") * 7 % 13).cast("string")).alias("value"))
    return replay.run([(v, "ord")], agents.stable_tokens)


@query("select event_id, user_id from events")
def first_seen_stream(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = e.union(e.where("event_id % 3 = 0")).union(e.where("event_id % 5 = 0"))
    return replay.run([(twice, "event_id")], lambda s: agents.first_seen(s, ["event_id"]), parts=1).select("event_id", "user_id")


@query("select event_id as request_id, case when event_id % 4 in (1, 2) then concat('r', cast(event_id as varchar)) end as reply, event_id % 4 not in (1, 2) as timed_out from events")
def correlate_batch(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    late = F.when(F.col("request_id") % 4 == 1, 10).when(F.col("request_id") % 4 == 2, 40).when(F.col("request_id") % 4 == 3, 41)
    b = e.where("request_id % 4 <> 0").select("request_id", F.timestamp_micros(F.unix_micros("ts") + late * 1_000_000).alias("ts"), F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("reply"))
    return agents.correlate(e, b, 40).select("request_id", "reply", "timed_out")


LOGGED = f"select page, ord, side, cat, x, y, w, h from ({BOX_SQL})"


@query(
    f"""with b as ({LOGGED}), p as (select page, 0 as part, ord, cat as type, 'B' as tier, 'text' as source, x, y, w, h from b where ord % 5 = 0), f as (select page, 1, ord, 'face', 'C', 'vision', x, y, w, h from b where cat = 'face' and side = 1),
    o as (select page, 2, ord, cat, 'B', 'vision', case when ord % 2 = 0 then 0 else x end, case when ord % 2 = 0 then 0 else y end, case when ord % 2 = 0 then 600 else w end, case when ord % 2 = 0 then 600 else h end from b where cat = 'email' and side = 0),
    k as (select * from p union all select * from f union all select * from o),
    e as (select page, 3, ord, 'graphics', 'C', 'perception', x, y, w, h from b where cat <> 'card' and not exists (select 1 from k where k.page = b.page and abs(k.x - b.x) <= 4 and abs(k.y - b.y) <= 4 and abs(k.w - b.w) <= 4 and abs(k.h - b.h) <= 4)),
    d as (select page, 4, ord, cat, 'B', 'dom', x, y, w, h from b where cat = 'card')
    select page, cast(row_number() over (partition by page order by part, ord, type, x, y, w, h) - 1 as int) as seq, type, tier, source, x, y, w, h from (select * from k union all select * from e union all select * from d)"""
)
def redaction_union(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    box = ["page", "ord", "x", "y", "w", "h"]
    whole = [F.when(F.col("ord") % 2 == 0, F.lit(v)).alias(f"region_{c}") for c, v in (("x", 0), ("y", 0), ("w", 600), ("h", 600))]
    out = D.redaction_union(
        b.where("ord % 5 = 0").select(*box, F.col("cat").alias("type"), F.lit("B").alias("tier"), F.lit("text").alias("source")),
        b.where("cat = 'face' and side = 1").select(*box),
        b.where("cat = 'email' and side = 0").select(*box, F.col("cat").alias("type"), *whole),
        b.where("cat <> 'card'").select(*box),
        b.where("cat = 'card'").select(*box, F.col("cat").alias("type"), F.lit("B").alias("tier"), F.lit("dom").alias("source")),
        ["page"],
    )
    return out.select("page", F.col("seq").cast("int").alias("seq"), "type", "tier", "source", "x", "y", "w", "h")


WORDS = "case l_linenumber % 4 when 0 then '(mail' when 1 then concat('user', cast(l_orderkey % 90 as {0}), '@x.example,') when 2 then '...' else concat(cast(l_orderkey % 90 as {0}), '99') end"


@query(
    f"""with w as (select l_orderkey as line, {WORDS.format('varchar')} as t, l_partkey % 300 as x0, l_suppkey % 40 as y0, l_partkey % 300 + 20 as x1, l_suppkey % 40 + 9 as y1 from lineitem),
    c as (select *, regexp_replace(t, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') as k from w), v as (select distinct line, concat('user', cast(line % 90 as varchar), '@x.example ', cast(line % 90 as varchar), '99 77') as value from w),
    h as (select v.line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from v join c on c.line = v.line and k <> '' and len(list_filter(string_split(value, ' '), lambda p: contains(p, k) or contains(k, p))) > 0 group by v.line)
    select line, value, coalesce(x0, 1) as x0, coalesce(y0, 2) as y0, coalesce(x1, 3) as x1, coalesce(y1, 4) as y1 from v left join h using (line)"""
)
def ocr_word_boxes(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    w = li.select(F.col("l_orderkey").alias("line"), F.expr(WORDS.format("string")).alias("text"), (F.col("l_partkey") % 300).alias("x0"), (F.col("l_suppkey") % 40).alias("y0"), (F.col("l_partkey") % 300 + 20).alias("x1"), (F.col("l_suppkey") % 40 + 9).alias("y1"))
    n = (F.col("line") % 90).cast("string")
    v = w.select("line").distinct().withColumn("value", F.concat(F.lit("user"), n, F.lit("@x.example "), n, F.lit("99 77")))
    v = v.withColumns({f"line_{c}": F.lit(i).cast("long") for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)})
    return D.word_boxes(w, v, ["line"])


@query("select o_orderstatus as status, round(sum(cast(o_totalprice as decimal(18, 2)) * (o_custkey % 7)) / nullif(sum(o_custkey % 7), 0), 4) as mean, count(*) as n from orders group by o_orderstatus")
def weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    mean = M.weighted_mean(F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_custkey") % 7)
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(mean.cast("double"), 4).alias("mean"), F.count("*").alias("n"))


@query(
    """select p_brand as brand, cast(sum(case when p_size % 3 = 0 then p_partkey * 1000 else 0 end) as bigint) as bytes, round(cast(sum(case when p_size % 3 = 0 then p_partkey * 1000 else 0 end) as double) / 1048576, 2) as mib from part group by p_brand"""
)
def manifest_sizes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_brand", F.concat(F.when(F.col("p_size") % 3 == 0, "vit/").otherwise("ocr/"), F.col("p_partkey").cast("string")).alias("file"), (F.col("p_partkey") * 1000).alias("bytes"))
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "bytes"))))
    m = p.groupBy("p_brand").agg(F.to_json(F.struct(F.sum("bytes").alias("totalBytes"), files.alias("files"))).alias("json"))
    return M.megabytes(io.manifest_files(m, "json", ["p_brand"]), "vit/", keys=["p_brand"]).withColumnRenamed("p_brand", "brand")


@query(
    """with s as (select user_id % 30 as k, event_id as id, event_id as started, event_id % 60 as n from events), r as (select *, row_number() over (order by started desc, id) as r from s)
    select id, cast(least(n, 40) as int) as n_entries, case when n > 0 then cast(n as bigint) end as last_entry, r = 1 as has_frames from r where r <= 25"""
)
def retained_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("started"), F.when(F.col("event_id") % 60 > 0, F.sequence(F.lit(1).cast("long"), F.col("event_id") % 60)).otherwise(F.array().cast("array<bigint>")).alias("entries"), F.array(F.lit("f")).alias("frames"))
    kept = S.retain(e)
    return kept.select("id", F.size("entries").alias("n_entries"), F.try_element_at("entries", F.lit(-1)).alias("last_entry"), F.col("frames").isNotNull().alias("has_frames"))


@query(
    f"""with k as (select c_custkey, c_nationkey, email, pan from ({KYC_SQL})), t as (select c_nationkey, 'email' as type, min(c_custkey * 2) as first_at from k where c_custkey % 3 <> 0 group by c_nationkey union all select c_nationkey, 'pan', min(c_custkey * 2 + case when c_custkey % 3 <> 0 then 1 else 0 end) from k group by c_nationkey)
    select c_nationkey, string_agg(type, ',' order by first_at) as types from t group by c_nationkey"""
)
def sensitive_types_by_key(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.operators import detect

    k = kyc(spark, folder, spread=True).select("c_nationkey", "c_custkey", F.concat_ws(" ", F.when(F.col("c_custkey") % 3 != 0, F.col("email")), "pan").alias("text"))
    return detect.sensitive_types(k, ["c_nationkey"], "text", "c_custkey").withColumn("types", F.array_join("types", ","))


@query("select user_id as run_id, count(*) as n_rows, count(distinct event_type) as n_sigs from events group by user_id")
def trace_union(spark: SparkSession, folder: str) -> DataFrame:
    # per-run arrays of steps, as a report holds them, and back to rows
    t = steps(spark, folder).groupBy("run_id").agg(F.collect_list(F.struct("step", "sig")).alias("trace"))
    rows = io.trace_rows(t, ["run_id"], "trace")
    return rows.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.countDistinct("sig").alias("n_sigs"))


@query("select c_nationkey, string_agg(c_mktsegment, ',' order by c_mktsegment) as models from (select distinct c_nationkey, c_mktsegment from customer where c_mktsegment <> '') group by c_nationkey")
def model_lists(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(io.sorted_names(F.collect_set("c_mktsegment")).alias("models"))
    return c.withColumn("models", F.array_join("models", ","))
