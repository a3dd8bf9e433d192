"""Guards, elements, prompts and small functions over pages, derived identifiers and step tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import rules, text as X
from quillon.operators import actions as A, gate, geometry as G, html as H, perception as P, prompt as O, steps as T, tokens, urls as U
from quillon.plans.derived import BOX_SQL, KYC_SQL, boxes, kyc
from quillon.plans.registry import query
from quillon.sources import io
from quillon.sources.io import table

ADDRESSES = "case page_id % 7 when 0 then 'chrome://settings' when 1 then 'https://chrome.google.com/webstore/x' when 2 then 'https://chromewebstore.google.com/' when 3 then 'ABOUT:blank' when 4 then concat(url, '///') when 5 then ' view-source:x' else url end"


@query("select page_id, page_id % 7 in (0, 1, 2, 3) as restricted, case page_id % 7 when 0 then 'chrome://settings' when 1 then 'https://chrome.google.com/webstore/x' when 2 then 'https://chromewebstore.google.com' when 3 then 'ABOUT:blank' when 5 then 'view-source:x' else regexp_replace(url, '/+$', '') end as endpoint from pages")
def restricted_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages").select("page_id", F.expr(ADDRESSES).alias("at"))
    return p.select("page_id", U.restricted(F.col("at")).alias("restricted"), U.endpoint(F.col("at")).alias("endpoint"))


@query(
    """select page_id, case page_id % 5 when 0 then true when 1 then true when 2 then false when 3 then false else true end as confirm, page_id % 3 <> 1 as cancelled from pages"""
)
def confirm_gate(spark: SparkSession, folder: str) -> DataFrame:
    # done; another origin; the same with its default port; a click; an address that cannot be read
    scheme, host = F.regexp_extract("url", "^([a-z]+)://", 1), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    same = F.concat(F.upper(scheme), F.lit("://"), host, F.when(scheme == "http", ":80").otherwise(":443"), F.lit("/next"))
    p = table(spark, folder, "pages").withColumn("k", F.col("page_id") % 5)
    kind = F.when(F.col("k") == 0, "done").when(F.col("k") == 3, "click").otherwise("navigate")
    target = F.when(F.col("k") == 1, F.lit("https://elsewhere.invalid/")).when(F.col("k") == 2, same).when(F.col("k") == 4, F.lit("javascript:void(0)")).otherwise(F.col("url"))
    answer = F.element_at(F.array(F.lit("  CANCEL it"), F.lit("go on"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select("page_id", U.needs_confirmation(kind, F.col("url"), target).alias("confirm"), U.cancelled(answer).alias("cancelled"))


@query(
    f"""select c_custkey, case c_custkey % 5 when 0 then true when 1 then true when 2 then false when 3 then true else true end as allowed, c_custkey % 5 = 3 or c_custkey % 5 < 2 as allowed_by_length from ({KYC_SQL})"""
)
def rewrite_policy(spark: SparkSession, folder: str) -> DataFrame:
    # an empty field; the value again with other blanks; another value over an identifier; over a plain word; the same plain word
    k = kyc(spark, folder, spread=True).withColumn("k", F.col("c_custkey") % 5)
    current = F.when(F.col("k") == 0, F.lit("  ")).when(F.col("k").isin(1, 2), F.concat(F.lit("to "), F.col("email"))).when(F.col("k") == 3, F.lit("plain")).otherwise(F.lit("a longer plain text"))
    typed = F.when(F.col("k") == 1, F.concat(F.lit(" to  "), F.col("email"), F.lit("\n"))).otherwise(F.lit("other"))
    long = lambda c: F.length(c) > 8  # noqa: E731  a caller's own rule of what is protected
    return k.select("c_custkey", A.rewrite_allowed(current, typed).alias("allowed"), A.rewrite_allowed(current, typed, long).alias("allowed_by_length"))


@query("select page_id, page_id % 6 in (1, 2, 4) and page_id % 4 > 0 and page_id % 5 <> 0 as submits, page_id % 3 = 0 as takes_files from pages")
def form_guards(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.plans.agent import VARIANTS

    p = table(spark, folder, "pages").withColumn("target", F.expr(VARIANTS))
    kind = F.when(F.col("page_id") % 3 == 0, "FILE").when(F.col("page_id") % 3 == 1, "text")
    submits = A.may_submit(U.form_action_allowed(F.col("target")), (F.col("page_id") % 4).cast("int"), F.col("page_id") % 5 == 0)
    return p.select("page_id", submits.alias("submits"), A.is_file_input(F.lit("INPUT"), kind).alias("takes_files"))


TASK_TEXT = "case event_id % 6 when 0 then 'What is the price' when 1 then 'click it' when 2 then 'SUMMARIZE this' when 3 then 'open the door' when 4 then 'tell me more' else 'buy' end"
LINE_TEXT = "case event_id % 6 when 0 then 'DOM:3' when 1 then 'plain' when 2 then '[Step 2] go' when 3 then 'Waiting 750ms' when 4 then 'Receiving end does not exist.' else 'A message channel closed' end"


@query("select event_id, event_id % 6 in (0, 2, 4) as reads, event_id % 6 in (0, 2, 3) as technical, event_id % 6 in (4, 5) as transient from events")
def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", F.expr(TASK_TEXT).alias("task"), F.expr(LINE_TEXT).alias("line"))
    return e.select("event_id", A.is_read_task(F.col("task")).alias("reads"), X.technical(F.col("line")).alias("technical"), X.transient(F.col("line")).alias("transient"))


ACTIONS = "click type press scroll navigate wait extract done ask other".split()


@query(
    """select event_id, case event_id % 10 when 0 then concat('CLICK(#', n, ')') when 1 then concat('TYPE(#', n, ', "', event_type, '")') when 2 then concat('PRESS(', event_type, ')') when 3 then 'SCROLL(down)'
      when 4 then concat('NAVIGATE(http://x/', n, ')') when 5 then concat('WAIT(', n, 'ms)') when 6 then concat('EXTRACT("', event_type, '")') when 7 then case when event_id % 20 = 7 then concat('DONE: "', event_type, '"') else 'DONE' end
      when 8 then concat('ASK("', substr(concat('Which one of all of these, ', event_type), 1, 28), '")') else concat('{"type":"other","target":', n, '}') end as label
    from (select event_id, event_type, cast(event_id % 97 as varchar) as n from events)"""
)
def action_labels(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("event_id") % 10, (F.col("event_id") % 97).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ACTIONS)), (k + 1).cast("int"))
    of = lambda which, c: F.when(k.isin(which), c)
    act = F.struct(
        kind.alias("type"), of([0, 1, 9], n).alias("target"), of([1, 6], F.col("event_type")).alias("text"), of([2], F.col("event_type")).alias("key"), of([3], F.lit("down")).alias("direction"),
        of([4], F.concat(F.lit("http://x/"), n.cast("string"))).alias("url"), of([5], n).alias("ms"), F.when(F.col("event_id") % 20 == 7, F.col("event_type")).alias("answer"), of([8], F.concat(F.lit("Which one of all of these, "), "event_type")).alias("question"),
    )
    return table(spark, folder, "events").withColumn("act", act).select("event_id", X.action_label("act").alias("label"))


ELS = [
    "l_orderkey as page_id",
    "cast(l_linenumber as int) as id",
    "case l_linenumber % 3 when 0 then 'button' when 1 then 'input' else 'a' end as tag",
    "case l_partkey % 4 when 0 then '' when 1 then null else concat('label number ', cast(l_partkey as string), ' of many') end as label",
    "concat('text ', cast(l_suppkey as string), ' and so on and on') as text",
]
ELS_SQL = "select " + ", ".join(ELS) + " from lineitem"


def element_arrays(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "lineitem").selectExpr(*ELS)
    return e.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "tag", "label", "text"))).alias("els"))


@query(
    f"""select page_id, string_agg(concat(id, ':', tag, ':', coalesce(label, ''), ':', substr(text, 1, 12)), '|' order by id, tag, label nulls first, text) as fingerprint,
    string_agg(concat('#', id, ' ', substr(coalesce(nullif(label, ''), text), 1, 24)), '  ' order by id, tag, label nulls first, text) as preview from ({ELS_SQL}) group by page_id"""
)
def element_prints(spark: SparkSession, folder: str) -> DataFrame:
    e = element_arrays(spark, folder)
    return e.select("page_id", T.fingerprint(F.col("els")).alias("fingerprint"), T.preview(F.col("els")).alias("preview"))


@query(
    f"""with e as ({ELS_SQL}), s as (select o_orderkey as page_id, cast(o_custkey % 8 as int) as target from orders), n as (select page_id, count(*) as observed, count(*) filter (where id % 2 = 0) as protected from e group by page_id)
    select s.page_id, s.target, coalesce(observed, 0) as observed, coalesce(protected, 0) as protected, coalesce(nullif(e.label, ''), e.text) as target_desc from s left join n using (page_id) left join e on e.page_id = s.page_id and e.id = s.target"""
)
def decision_trace(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "lineitem").selectExpr(*ELS)
    s = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 8).cast("int").alias("target"))
    return T.decision_trace(s, e, e.where("id % 2 = 0"), ["page_id"]).select("page_id", "target", "observed", "protected", "target_desc")


@query(
    """with c as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as r, row_number() over (partition by conv_id order by turn desc) as d from conversations),
    w as (select conv_id, string_agg(concat('  • ', text), E'\n' order by turn) as t, count(*) as n from c where d <= 8 group by conv_id),
    l as (select conv_id, string_agg(concat('  • ', text), E'\n' order by turn) as t from c where r <= 8 group by conv_id),
    e as (select conv_id, max(r) as n, string_agg(concat('  [', turn, '] <a> role=link text="', substr(text, 1, 50), '" label="', substr(role, 1, 30), '"', case when turn % 2 = 1 then concat(' value="', role, '"') else '' end), E'\n' order by turn) filter (where r <= 40) as t from c group by conv_id)
    select conv_id, concat(E'Task: read\n\n⚠ DO-NOT-REPEAT list (you already tried these and they did NOT work):\n', w.t, E'\nNEVER repeat the exact actions above. Pick a different target, different element, or different strategy.\n\nLearned lessons from prior runs (these are CORRECT):\n', l.t,
      E'\n\nON-DEVICE PERCEPTION (from a MobileViT computed locally BEFORE upload — it saw this page itself):\nVisible screen: ', e.n, ' photo, 2 ui region(s).', E'\nLocally redacted ', e.n, ' non-DOM graphics region(s) (photo/screen/doc-like) — treat them as OPAQUE: never guess their content. Reason from the DOM + numbered tags instead.',
      case when conv_id % 2 = 0 then E'\nA possible human-verification graphic was detected — do NOT attempt to read it.' else '' end, E'\n\nDOM elements (', e.n, E' total):\n', e.t) as prompt, w.n as n_warnings from w join l using (conv_id) join e using (conv_id)"""
)
def prompt_full(spark: SparkSession, folder: str) -> DataFrame:
    line = F.struct("turn", "text", "role")
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("c"))
    said = F.transform("c", lambda x: x["text"])
    els = F.transform("c", lambda x: F.struct(x["turn"].alias("id"), F.lit("a").alias("tag"), F.lit("link").alias("role"), x["text"].alias("text"), x["role"].alias("label"), F.when(x["turn"] % 2 == 1, x["role"]).alias("value")))
    see = F.create_map(F.lit("photo"), F.size("c"), F.lit("ui"), F.lit(2))
    blocks = O.warnings(said), O.lessons(said), O.perception(see, F.size("c"), F.when(F.col("conv_id") % 2 == 0, 1).otherwise(0)), O.elements(els)
    return c.select("conv_id", O.act(F.lit("read"), *blocks).alias("prompt"), F.least(F.size("c"), F.lit(O.WARNINGS)).cast("long").alias("n_warnings"))


@query(
    """with c as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as r, row_number() over (partition by conv_id order by turn desc) as d from conversations),
    h as (select conv_id, string_agg(concat('  ', rr, '. ', role, ' → ', case when turn % 2 = 0 then 'ok' else '' end), E'\n' order by turn) as t from (select *, row_number() over (partition by conv_id order by turn) as rr from c where d <= 8) group by conv_id),
    g as (select conv_id, string_agg(concat('  target #', turn, ' = ', role, '  → if you act on this element, use exactly this integer id.'), E'\n' order by turn) as t from c where r <= 8 group by conv_id)
    select conv_id, concat('Task: t', conv_id, E'\n\nYou are STUCK. The actions you have tried so far did not complete the task.\n\nHistory:\n', h.t, E'\n\nDETECTED ELEMENTS (verified by the executor — use VERBATIM, do NOT re-guess):\n', g.t, E'\n\n(No DOM elements captured)') as prompt from h join g using (conv_id)"""
)
def rethink_prompt(spark: SparkSession, folder: str) -> DataFrame:
    step = F.struct("turn", F.col("role").alias("action"), F.when(F.col("turn") % 2 == 0, "ok").alias("result"))
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("h"))
    seen = F.transform("h", lambda x: F.struct(x["turn"].alias("id"), x["action"].alias("desc")))
    none = F.slice(F.transform("h", lambda x: F.struct(x["turn"].alias("id"), F.lit("").alias("tag"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("label"), F.lit("").alias("value"))), 1, 0)
    return c.select("conv_id", O.rethink(F.concat(F.lit("t"), F.col("conv_id").cast("string")), O.history(F.col("h"), O.RETHINK_HISTORY, "History:", notes=False), O.targets(seen), O.elements(none)).alias("prompt"))


@query("select page_id, cast(row_number() over (partition by page_id order by k) - 1 as int) as ord, a.address as text from (select page_id, unnest([1, 2]) as k from pages where page_id % 4 = 0) join (select 1 as kk, '12 High Street Town' as address union all select 2, 'Flat & House 3') a on kk = k")
def address_blocks(spark: SparkSession, folder: str) -> DataFrame:
    more = F.when(F.col("page_id") % 4 == 0, "<address>12 High  Street\n<b></b>Town</address><script>'<address>no</address>'</script><p>x</p><address>Flat &amp; House 3</address>").otherwise("<p>address</p>")
    p = table(spark, folder, "pages").select("page_id", F.concat(F.lit("<body>"), more, F.lit("</body>")).alias("html"))
    a = H.addresses(p)
    return H.numbered(a, ["page_id"], ["ord"]).select("page_id", F.col("id").cast("int").alias("ord"), "text")


@query(f"select page, ord, x, y, w, h, x - w * 0.15 as px, y - h * 0.15 as py, w * 1.3 as pw, h * 1.3 as ph from (select *, w - 30 as w2 from ({BOX_SQL})) where w - 20 >= 8 and h - 20 >= 8")
def media_regions(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).withColumns({"w0": F.col("w"), "h0": F.col("h"), "w": F.col("w") - 20, "h": F.col("h") - 20})
    kept = H.media_regions(b).select("page", "ord", "x", "y", F.col("w0").alias("w"), F.col("h0").alias("h"))
    wide = G.padded(kept.withColumns({f"o{c}": F.col(c) for c in "xywh"}))
    return wide.select("page", "ord", *[F.col(f"o{c}").alias(c) for c in "xywh"], *[F.round(c, 6).alias(f"p{c}") for c in "xywh"])


@query(
    """select c_custkey, case c_custkey % 4 when 0 then 'dom' else 'text' end as k, case c_custkey % 5 when 0 then 'DOM rule · labelled field / value scan' when 1 then 'text-node sweep · visible prose' when 2 then 'on-device vision · face / OCR' when 3 then 'local ViT · region escalation' else 'on-device sanitizer' end as detector,
    case c_custkey % 4 when 0 then 'Tier A · blackout' when 1 then 'Tier B · stable token' when 2 then 'Tier C · blur / taint' end as tier, case c_custkey % 3 when 0 then cast(c_custkey as varchar) when 1 then cast(c_custkey % 50 as varchar) end as lesson,
    concat(case when c_custkey >= 6000 then cast(c_custkey // 60 as varchar) else lpad(cast(c_custkey // 60 as varchar), 2, '0') end, ':', lpad(cast(c_custkey % 60 as varchar), 2, '0'), '.', lpad(cast(cast(floor((s - floor(s)) * 100) as int) as varchar), 2, '0')) as clock from (select c_custkey, cast(c_custkey * 1000 + c_custkey % 100 * 10 as double) / 1000 as s from customer)"""
)
def small_labels(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    n = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    error = F.when(n % 3 == 0, F.concat(F.lit("Element #"), n.cast("string"), F.lit(" not found on page"))).when(n % 3 == 1, F.concat(F.lit("bad TARGET "), (n % 50).cast("string"))).otherwise("other")
    return c.select(
        n,
        F.when(n % 4 == 0, "dom").otherwise("text").alias("k"),
        X.detector_label(pick("dom", "text", "vision", "perception", "x")).alias("detector"),
        X.tier_label(pick("A", "B", "C", "D")).alias("tier"),
        X.lesson_from(error).alias("lesson"),
        X.elapsed(n * 1000 + n % 100 * 10).alias("clock"),
    )


@query(
    """select page_id, case page_id % 5 when 0 then 'image/webp' when 1 then 'image/png' when 2 then 'image/gif' else 'image/jpeg' end as mime, cast(floor(length(html) * 3 / 4.0 / 1024 + 0.5) as bigint) as kb, length(html) as screenshot_chars,
    case page_id % 3 when 0 then 'Enter' when 1 then 'F5' else 'a' end as key, case page_id % 3 when 0 then 'Enter' when 1 then 'F5' else 'A' end as code from pages"""
)
def image_facts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("page_id")
    body = F.when(k % 5 == 0, "data:image/webp;base64,AAAA").when(k % 5 == 1, "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJ").when(k % 5 == 2, "R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7").when(k % 5 == 3, "/9j/4AAQSkZJRgABAQEAYABgAAD/2wBDAAgGBgcGBQgHBwcJCQgK").otherwise("AAAAAAAAAAAAAAAA")
    p = io.capture_rows(table(spark, folder, "pages").select("page_id", body.alias("body"), X.image_kb(F.col("html")).alias("kb"), F.col("html").alias("screenshot_b64")))
    name = X.normal_key(F.when(k % 3 == 0, " ENTER").when(k % 3 == 1, "f5").otherwise("a"))
    return p.select("page_id", X.mime_type(F.col("body")).alias("mime"), "kb", F.col("screenshotBytes").alias("screenshot_chars"), name["key"].alias("key"), name["code"].alias("code"))


LOGITS = "list_transform(embedding, lambda v: cast(v as double) * 20)"


@query(
    f"""with l as (select vec_id, {LOGITS} as l from embeddings), e as (select vec_id, list_transform(l, lambda v: exp(v - list_max(l))) as e from l)
    select vec_id, round(list_max(e) / list_sum(e), 6) as top, round(e[1] / list_sum(e), 9) as first, cast(len(e) as int) as n, round((vec_id % 256) / 127.5 - 1, 9) as pixel from e"""
)
def softmax_values(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").withColumn("p", P.softmax(F.transform("embedding", lambda v: v.cast("double") * 20)))
    return e.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.col("p")[0], 9).alias("first"), F.size("p").alias("n"), F.round(P.normalise_pixel((F.col("vec_id") % 256).cast("double")), 9).alias("pixel"))


@query(f"select page, string_agg(k, ';' order by k) as region_key, count(*) as n from (select page, concat(x, ',', y, ',', w, ',', h) as k from ({BOX_SQL})) group by page")
def region_keys(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).groupBy("page").agg(F.collect_list(F.concat_ws(",", "x", "y", "w", "h")).alias("k"), F.count("*").alias("n"))
    return b.select("page", P.region_key(F.col("k")).alias("region_key"), "n")


@query("select vec_id, label as cls, case when label % 3 = 0 then concat('class ', cast(label as varchar)) else cast(label as varchar) end as name from embeddings")
def class_labels(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("cls"))
    names = e.where("cls % 3 = 0").select("cls", F.concat(F.lit("class "), F.col("cls").cast("string")).alias("name")).distinct()
    return P.class_names(e, names).select("vec_id", "cls", F.col("label").alias("name"))


@query("select page_id, count(*) as n, count(*) filter (where cat = 'email') as emails, string_agg(value, '|' order by ord, k) as vals from (select page_id, 0 as ord, 0 as k, 'email' as cat, concat('a', page_id, '@b.co') as value from pages union all select page_id, 0, 1, 'none', '' from pages union all select page_id, 1, 0, 'time', '10:30' from pages where page_id % 2 = 0) group by page_id")
def truth_marks(spark: SparkSession, folder: str) -> DataFrame:
    extra = F.when(F.col("page_id") % 2 == 0, '<a href="#" data-gt=" time : 10:30 ">t</a>').otherwise("")
    html = F.concat(F.lit('<body><button data-gt="email: a'), F.col("page_id").cast("string"), F.lit('@b.co,none">b</button>'), extra, F.lit("</body>"))
    t = H.truth_labels(H.page_elements(table(spark, folder, "pages").select("page_id", html.alias("html"))))
    vals = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at", "value"))), lambda x: x["value"]), "|")
    return t.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("cat") == "email").alias("emails"), vals.alias("vals"))


@query(
    f"""with e as (select c_custkey, case c_custkey % 4 when 0 then 'Password' when 1 then 'Email-Address' when 2 then 'Full Name' else 'notes' end as label, case c_custkey % 4 when 0 then 'hunter2' when 1 then concat('me ', email) when 2 then concat('Person ', c_custkey) else 'see below' end as value,
      case c_custkey % 4 when 3 then concat('ask ', email, ' or ', pan) else 'shown' end as text, email, pan from ({KYC_SQL}))
    select c_custkey, case c_custkey % 4 when 0 then '[SECRET]' when 1 then 'me [EMAIL_1]' when 2 then '[NAME_1]' else value end as value, case c_custkey % 4 when 0 then '[SECRET]' when 2 then '[NAME_1]' when 3 then 'ask [EMAIL_1] or [PAN_1]' else 'shown' end as text,
      case c_custkey % 4 when 0 then 'A:password:dom' when 1 then 'B:email:dom' when 2 then 'B:name:dom' else 'B:email:text,B:pan:text' end as log from e"""
)
def sanitized_fields(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder, spread=True).withColumn("k", F.col("c_custkey") % 4)
    of = lambda *v: F.when(F.col("k") == 0, v[0]).when(F.col("k") == 1, v[1]).when(F.col("k") == 2, v[2]).otherwise(v[3])
    e = k.select(
        "c_custkey",
        F.lit(0).alias("ord"),
        of(*map(F.lit, ("Password", "Email-Address", "Full Name", "notes"))).alias("label"),
        of(F.lit("hunter2"), F.concat(F.lit("me "), "email"), F.concat(F.lit("Person "), F.col("c_custkey").cast("string")), F.lit("see below")).alias("value"),
        F.when(F.col("k") == 3, F.concat(F.lit("ask "), "email", F.lit(" or "), "pan")).otherwise("shown").alias("text"),
    )
    out, log = tokens.sanitize_elements(e, ["c_custkey"])
    lines = log.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tier", "type", "source"))), ",").alias("log"))
    return out.join(lines, "c_custkey", "left").select("c_custkey", "value", "text", "log")


@query("select event_id, coalesce(event_id % 3 = 1 and event_id % 7 <> 2 and event_type <> 'error', false) as passed from events")
def pixel_gate(spark: SparkSession, folder: str) -> DataFrame:
    # a check that said no, yes or nothing; an image that could not be read, or whose event is an error, tells nothing
    ok = F.when(F.col("event_id") % 3 == 0, F.lit(False)).when(F.col("event_id") % 3 == 1, F.lit(True))
    error = F.when(F.col("event_id") % 7 == 2, F.lit("not an image")).when(F.col("event_type") == "error", F.lit("lost"))
    return table(spark, folder, "events").select("event_id", gate.image_pass(ok, error).alias("passed"))


@query("select user_id, count(*) as n, string_agg(distinct cast(event_id % 9 as varchar), ',' order by cast(event_id % 9 as varchar)) as clicked from events where event_type = 'click' group by user_id")
def clicked_targets(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("type"), (F.col("event_id") % 9).cast("int").alias("target"))).alias("h"))
    out = e.select("user_id", A.clicked(F.col("h")).alias("c"), F.size(F.filter("h", lambda a: a["type"] == "click")).cast("long").alias("n")).where("n > 0")
    return out.select("user_id", "n", F.array_join(F.array_sort(F.transform("c", lambda x: x.cast("string"))), ",").alias("clicked"))


@query("select event_id, event_type as kind, cast(event_id % 10 as int) as target, case when event_id % 7 = 0 then null else concat('m', cast(event_id as varchar)) end as note from events")
def bus_messages(spark: SparkSession, folder: str) -> DataFrame:
    note = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    e = table(spark, folder, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), (F.col("event_id") % 10).cast("int").alias("target"), note.alias("note"))).alias("body"))
    return io.message_rows(e, "body", "target int, note string").drop("body")


@query("select user_id, cast(case when user_id % 3 = 0 then 0 else count(*) end as int) as n_sessions from events group by user_id")
def stored_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct(F.col("event_id").alias("id")))).alias("held"))
    e = e.withColumn("held", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("{"), "held")).otherwise(F.col("held")))
    return e.select("user_id", F.size(io.sessions_of(e, "held", "id bigint")).alias("n_sessions"))


@query("select l_orderkey as line, count(*) as n_words from lineitem where l_linenumber % 3 <> 0 group by l_orderkey")
def ocr_trees(spark: SparkSession, folder: str) -> DataFrame:
    # version 6 nests lines in blocks and paragraphs, version 5 has them on top; lines without words go
    word = F.collect_list(F.when(F.col("l_linenumber") % 3 != 0, F.struct(F.col("l_partkey").cast("string").alias("text"))))
    p = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(word.alias("words"))
    line = F.array(F.struct("words"))
    none = F.slice(line, 1, 0)
    deep = F.array(F.struct(F.array(F.struct(line.alias("lines"))).alias("paragraphs")))
    tree = F.struct(F.when(F.col("l_orderkey") % 2 == 0, deep).alias("blocks"), F.when(F.col("l_orderkey") % 2 == 0, none).otherwise(line).alias("lines"))
    lines = io.ocr_lines(p.select("l_orderkey", tree.alias("tree")), ["l_orderkey"], "tree")
    return lines.select(F.col("l_orderkey").alias("line"), F.size("line.words").cast("long").alias("n_words"))


@query(f"select c_custkey, concat(c_custkey, '-', upper(kind)) as raw_kept, kind as type from (select c_custkey, case c_custkey % 3 when 0 then 'click' when 1 then 'wait' else 'fly' end as kind from customer) where kind <> 'fly'")
def resolved_actions(spark: SparkSession, folder: str) -> DataFrame:
    k = F.element_at(F.array(F.lit("click"), F.lit("wait"), F.lit("fly")), (F.col("c_custkey") % 3 + 1).cast("int"))
    extra = F.when(k == "click", F.lit(',"target":1')).otherwise(',"ms":5')
    raw = F.concat(F.lit('{"note":"'), F.col("c_custkey").cast("string"), F.lit("-"), F.upper(k), F.lit('","action":{"type":"'), k, F.lit('"'), extra, F.lit("}}"))
    out = A.resolve_actions(table(spark, folder, "customer").select("c_custkey", raw.alias("raw")), ["c_custkey"]).where("source = 'model'")
    return out.select("c_custkey", F.get_json_object("raw", "$.note").alias("raw_kept"), F.get_json_object("raw", "$.action.type").alias("type"))


@query(r"select doc_id, cast(length(s) as int) as n_chars, md5(s) as digest from (select doc_id, trim(regexp_replace(text, '[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) as s from documents)")
def squash_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", X.squash(F.col("text")).alias("s"))
    return d.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


@query(f"select c_custkey, trim(c) as clean, length(c) as n from (select c_custkey, regexp_replace(lower(label), '[_\\-\\s]', '', 'g') as c from ({KYC_SQL}))")
def clean_labels(spark: SparkSession, folder: str) -> DataFrame:
    return kyc(spark, folder).select("c_custkey", rules.clean_label(F.col("label")).alias("clean")).withColumn("n", F.length("clean"))
