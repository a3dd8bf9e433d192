import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import actions, gate, geometry, html, metrics, perception, redactions, reports, sessions, steps, tokens
from quillon.sources import io
from quillon.streaming import agents, replay


def test_union_area_is_exact(spark):
    import random

    random.seed(3)
    rows = [(p, i, random.randint(-5, 30), random.randint(-5, 30), random.randint(0, 15), random.randint(0, 15)) for p in range(5) for i in range(8)]
    df = spark.createDataFrame(rows, "page int, ord int, x int, y int, w int, h int")
    got = {r["page"]: r["area"] for r in geometry.union_area(df, ["page"], 32, 28).collect()}
    for p in range(5):
        cells = {(a, b) for q, _, x, y, w, h in rows if q == p for a in range(max(0, x), min(32, x + w)) for b in range(max(0, y), min(28, y + h))}
        assert got.get(p, 0) == len(cells)


def test_nearest_index(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],), ([5.0],)], "v array<double>")
    assert [r[0] for r in df.select(metrics.nearest_index(F.col("v"), 0.5)).collect()] == [3.0, 0.0, 5.0]
    rows = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2, 2)], "k int, v double")
    got = metrics.ranked_percentiles(rows, ["k"], "v", (0.5, 0.95)).first()
    assert (got["p50"], got["p95"], got["n"]) == (2.0, 4.0, 5)


def test_routing(spark):
    cases = [({"ui": 4, "blank": 2}, False, False, None, True, "s"), ({"ui": 3, "photo": 1}, False, False, None, True, "b"), ({}, True, False, None, True, "b"), ({}, False, True, None, True, "b"), ({"photo": 1}, False, False, "x", True, None), ({"photo": 1}, False, False, None, False, None)]
    df = spark.createDataFrame(cases, "m map<string,int>, e boolean, c boolean, r string, on boolean, want string")
    got = df.select(perception.route(F.col("r"), F.lit(True), perception.complexity(F.lit(True), F.col("m"), F.col("e"), F.col("c")), F.lit("s"), F.lit("b"), F.col("on")))
    assert [r[0] for r in got.collect()] == [c[-1] for c in cases]


def test_targets(spark):
    cases = [("7", 7), ("[7]", 7), ("6.0", 6), ('"7"', 7), ('["7"]', 7), ("true", 1), ("search", None), ("7.5", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want int")
    assert [r[0] for r in df.select(actions.plain_target(F.col("t"))).collect()] == [c[1] for c in cases]


def test_action_errors(spark):
    cases = [
        ('{"action":{"type":"click","target":3}}', None),
        ('x {"action":{"type":"press","key":"Enter"}} y', None),
        ('{"action": {"type": "cli', "response was not valid JSON"),
        ('{"action":{"target":1}}', "'action' is missing or has no string 'type'"),
        ('{"action":{"type":"fly"}}', "invalid action type 'fly'"),
        ('{"action":{"type":"click","target":"nowhere"}}', "target 'nowhere' does not match any DOM element id"),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "raw string")
    assert [r["error"] for r in actions.validate(df).collect()] == [c[1] for c in cases]


def test_sequences(spark):
    rows = [(1, i, s) for i, s in enumerate("aaabbbbbbc")]
    df = spark.createDataFrame(rows, "run int, step int, sig string")
    got = steps.no_progress(steps.stuck(df, ["run"], ["step"], "sig"), ["run"], ["step"], "sig").orderBy("step").collect()
    assert [r["stuck"] for r in got] == [False, False, True, False, False, True, True, True, True, False]
    assert [r["same_run"] for r in got] == [0, 1, 2, 0, 1, 2, 3, 4, 5, 0]
    assert [r["no_progress"] for r in got][7:9] == [True, True]


def test_order_dependent_folds(spark):
    df = spark.createDataFrame([([0, 5, 18, 20, 40],)], "t array<bigint>")
    assert df.select(steps.cooldown(F.col("t"), 18)).first()[0] == [0, 18, 40]
    keys = spark.createDataFrame([(["a", "b", "a", "c", "a"],)], "k array<string>")
    assert keys.select(steps.fifo_hits(F.col("k"), 2)).first()[0] == [False, False, True, False, False]


def test_gate_blocks_and_releases(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "x"), (2, "fine", None), (3, None, "4111 1111 1111 1111")], "id int, text string, label string")
    bad = {(r["id"], r["field"], r["type"]) for r in gate.violations(df, ["id"]).collect()}
    assert bad == {(1, "text", "email"), (3, "label", "card")}
    assert [r["id"] for r in gate.release(df, ["id"], ["text", "label"]).collect()] == [2]
    states = spark.createDataFrame([(0, True, 1), (0, None, 0), (2, None, 0), (2, True, 0), (2, True, None)], "r int, up boolean, hits int")
    assert [r[0] for r in states.select(gate.verdict(F.col("r"), F.col("up"), F.col("hits"))).collect()] == ["block", "pass", "skip", "pass", "skip"]


def test_html_rows(spark):
    page = '<html><body><label for="a">Mail</label><input id="a" value="v"><label>Wrap <input name="n"></label><div style="display:none"><a href="x">hidden</a></div><script>var x="</p>"</script><button>Go &amp; stop</button><p data-gt="email:a@b.co,none" tabindex=0>t</p></body></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>unclosed <a href=q>x")], "page_id long, html string")
    rows = html.labels(html.page_elements(df)).orderBy("page_id", "ord").collect()
    assert [(r["page_id"], r["tag"], r["label"]) for r in rows if r["tag"] == "input"] == [(1, "input", "Mail"), (1, "input", "Wrap")]
    assert "hidden" not in [r["text"] for r in rows]
    assert [r["text"] for r in rows if r["tag"] == "button"] == ["Go & stop"]
    truth = html.truth_labels(html.page_elements(df)).collect()
    assert [(r["cat"], r["value"]) for r in truth] == [("email", "a@b.co"), ("none", "")]


def test_references_without_semicolon(spark):
    df = spark.createDataFrame([(1, "<h1>a&amp;&amp</h1><a href='/x'>&quot b &copy;&copy &ampx; &#65;&#65 R&D</a>")], "page_id long, html string")
    text = lambda guess: [r["text"] for r in html.page_elements(df, guess=guess).orderBy("ord").collect()]
    assert text(False) == ["a&&amp", "&quot b ©&copy &ampx; A&#65 R&D"]
    assert text(True) == ["a&&", '" b ©© &x; AA R&D']


def test_round_trip_of_tokens(spark):
    df = spark.createDataFrame([(1, "a@b.co or 4111 1111 1111 1111"), (2, "nothing"), (3, "😀 x@y.co")], "id int, t string")
    clean, names = tokens.tokenize(df, "t", ["id"], scope=["id"])
    pairs = names.groupBy("id").agg(F.collect_list(F.struct("token", "value")).alias("p"))
    got = clean.join(pairs, "id", "left").select("t", "clean", F.coalesce(tokens.restore(F.col("clean"), F.col("p")), F.col("clean")).alias("back")).collect()
    for r in got:
        assert r["back"].replace(" ", "") == r["t"].replace(" ", "")
        assert "@" not in r["clean"]


def test_event_stream_and_config(spark):
    body = "event: thought\ndata: \"a\"\n\nevent: action\ndata: {bad\n\nevent: action\ndata: {\"k\": 1}\n\nevent: error\ndata: \"e\"\n\n"
    e = io.sse_events(spark.createDataFrame([(1, body)], "id int, body string"), ["id"], "body")
    got = io.first_action(e, ["id"]).first()
    assert json.loads(got["action"]) == {"k": 1} and got["error"] == '"e"'
    df = spark.createDataFrame([("10",), ("0",), ("x",), (None,), ("201",)], "v string")
    assert [r[0] for r in df.select(io.configured(F.col("v"), "int", 50, 1, 200)).collect()] == [10, 50, 50, 50, 50]


def test_step_stream_stops(spark):
    rows = [(1, i, i, s, s == "e") for i, s in enumerate("aaaebbbbb")] + [(2, i, i, s, s == "e") for i, s in enumerate("eee")] + [(3, i, i, str(i), False) for i in range(60)] + [(4, 0, 0, "done", False)]
    df = spark.createDataFrame(rows, "run_id long, ts long, step int, sig string, blocked boolean")
    got = {r["run_id"]: r for r in replay.run([(df, "ts")], agents.step_counters, "update").collect()}
    assert got[1]["n_steps"] == 9 and got[2]["n_steps"] == 3
    assert got[2]["max_blocked"] == 3 and got[1]["max_same"] == 4
    assert [got[i]["stop"] for i in (1, 2, 3, 4)] == [None, None, "budget", "done"]


def test_questions_time_out(spark):
    at = lambda rows: spark.createDataFrame(rows, "run_id long, seq long, kind string, answer string, sec long").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    # answered; closed by a newer one, whose late answer reaches nothing; skipped by the timer
    rows = [(1, 1, "question", None, 0), (1, 1, "answer", "yes", 10), (1, 2, "question", None, 20), (1, 3, "question", None, 30), (1, 2, "answer", "stale", 31), (1, 3, "answer", "late", 60), (1, 4, "question", None, 100), (2, 1, "question", None, 5), (9, 9, "tick", None, 9000)]
    got = {(r["run_id"], r["seq"]): (r["outcome"], r["answer"]) for r in replay.run([(at(rows), "sec")], agents.question_outcomes, parts=2).collect()}
    assert got[1, 1] == ("answered", "yes") and got[1, 2] == got[1, 3] == ("skipped", "")
    q = spark.createDataFrame([(r[0], r[1], r[4] * 1000) for r in rows if r[2] == "question"], "run_id long, seq long, asked long")
    a = spark.createDataFrame([(r[0], r[1], r[4] * 1000, r[3]) for r in rows if r[2] == "answer"], "run_id long, seq long, answered long, answer string")
    batch = {(r["run_id"], r["seq"]): (r["outcome"], r["answer"]) for r in reports.question_outcomes(q, a, ["run_id"]).collect()}
    assert all(batch[k] == v for k, v in got.items())


def test_flush_and_correlation_streams_equal_batches(spark):
    ts = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms"))
    d = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 30, "b"), (1, 2, 61, "c"), (2, 0, 10, "x"), (9, 9, 10_000_000, "end")], "run_id long, seq long, ms long, delta string").withColumn("ts", ts)
    stream = replay.run([(d, "ms")], agents.flush_tokens, parts=2).where("run_id < 9").select("run_id", "text", "n")
    batch = agents.flush_tokens(d).where("run_id < 9").select("run_id", "text", "n")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect())) == [(1, "ab", 2), (1, "c", 1), (2, "x", 1)]
    ask = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 90_000_000)], "request_id long, ms long").withColumn("ts", ts).drop("ms")
    reply = spark.createDataFrame([(1, 5_000, "r1"), (2, 50_000, "r2"), (9, 90_000_001, "r9")], "request_id long, ms long, reply string").withColumn("ts", ts).drop("ms")
    got = replay.run([(ask, "request_id"), (reply, "request_id")], lambda a, b: agents.correlate(a, b, 40), parts=1).select("request_id", "reply", "timed_out")
    want = agents.correlate(ask, reply, 40).select("request_id", "reply", "timed_out")
    assert {tuple(r) for r in want.collect()} == {(1, "r1", False), (2, None, True), (3, None, True), (9, "r9", False)}
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_global_ranks_equal_a_window(spark):
    rows = [(f"t{i % 3}", i * 7919 % 1000, f"v{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "type string, k int, value string").repartition(7)
    got = {(r["type"], r["value"]): r["n"] for r in tokens.ranked(df, ["type"], ["k", "value"], "n").collect()}
    for t in ("t0", "t1", "t2"):
        own = sorted((k, v) for u, k, v in rows if u == t)
        assert [got[t, v] for _, v in own] == list(range(1, len(own) + 1))


def test_areas_of_one_sweep(spark):
    import random

    random.seed(5)
    rows = [(p, random.randint(-5, 40), random.randint(-5, 600), random.randint(0, 30), random.randint(0, 400), random.random() < 0.5) for p in range(4) for _ in range(12)]
    df = spark.createDataFrame(rows, "page int, x int, y int, w int, h int, t boolean")
    got = {r["page"]: r for r in geometry.pixel_areas(df.where("t"), df.where("not t"), ["page"], 50, 620).collect()}

    def cells(p, side):
        return {(a, b) for q, x, y, w, h, t in rows if q == p and t == side for a in range(max(0, x), min(50, x + w)) for b in range(max(0, y), min(620, y + h))}

    for p in range(4):
        g, f = cells(p, True), cells(p, False)
        assert (got[p]["gt"], got[p]["pred"], got[p]["inter"]) == (len(g), len(f), len(g & f))


def test_boxes_meet_as_all_against_all(spark):
    rng = random.Random(2)
    size = lambda: rng.choice([0, 1, 5, 40, 64, 65, 300, 1025, 40_000])
    make = lambda n: [(p, i, rng.randint(-700, 3000), rng.randint(-700, 3000), size(), size()) for p in range(3) for i in range(n)]
    left, right = make(60), make(50)
    schema = "page int, ord int, x int, y int, w int, h int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    shared = lambda p, q: max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2])) * max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
    got = sorted((r["page"], r["a_ord"], r["b_ord"], r["shared"]) for r in geometry.overlapping(a, b, ["page"], 0.25).collect())
    assert got == sorted((p[0], p[1], q[1], shared(p, q)) for p in left for q in right if p[0] == q[0] and shared(p, q) > 0 and shared(p, q) >= 0.25 * q[4] * q[5])
    touch = lambda p, q: p[0] == q[0] and max(p[2], q[2]) <= min(p[2] + p[4], q[2] + q[4]) and max(p[3], q[3]) <= min(p[3] + p[5], q[3] + q[5])
    met = geometry.meeting(geometry.prefixed(a, "a_", ["page"]), geometry.prefixed(b, "b_", ["page"]), ["page"])
    assert sorted((r["page"], r["a_ord"], r["b_ord"]) for r in met.collect()) == sorted((p[0], p[1], q[1]) for p in left for q in right if touch(p, q))
    far = {(r["page"], r["a_ord"]) for r in geometry.not_near(a, b, ["page"], 60).collect()}
    assert far == {p[:2] for p in left if not any(p[0] == q[0] and all(abs(p[k] - q[k]) <= 60 for k in (2, 3, 4, 5)) for q in right)}
    inside = lambda p, q: q[2] <= p[2] + p[4] / 2 <= q[2] + q[4] and q[3] <= p[3] + p[5] / 2 <= q[3] + q[5]
    first = {(r["page"], r["a_ord"]): r["region"] for r in geometry.first_containing(a, b, ["page"], "ord").collect()}
    assert first == {p[:2]: min((q[1] for q in right if p[0] == q[0] and inside(p, q)), default=None) for p in left}


def test_a_crowded_page_is_joined_by_cells(spark):
    """A hundred thousand boxes of one page, each of which overlaps two."""
    n = 100_000
    boxes = spark.range(n).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("ord"), (F.col("id") % 250 * 30).cast("int").alias("x"), (F.col("id") / 250).cast("int").alias("y")).withColumns({"y": F.col("y") * 40, "w": F.lit(40), "h": F.lit(30)})
    assert geometry.overlapping(boxes, boxes, ["page"], 0.1).where("a_ord < b_ord").count() == n - n // 250


def test_folds_over_a_long_run(spark):
    n = 1_000_000
    times = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>").alias("t"))
    assert times.select(F.size(steps.cooldown(F.col("t"), 7))).first()[0] == -(-n // 7)
    keys = times.select(F.transform("t", lambda x: (x % 5).cast("string")).alias("k"))
    assert keys.select(F.size(F.filter(steps.fifo_hits(F.col("k")), lambda h: h))).first()[0] == n - 5
    items = times.select(F.transform(F.slice("t", 1, 100_000), lambda x: F.struct(F.lit("t").alias("type"), (x % 1000 * 2).alias("x"), (x / 1000).cast("long").alias("y"))).alias("m"))
    kept = items.select(F.size(geometry.fuzzy_distinct(F.col("m"), items.schema["m"].dataType.simpleString())))
    assert kept.first()[0] == 500 * 34


def test_containment_ignores_blanks(spark):
    needles = spark.createDataFrame([(1, "foo bar baz"), (2, "Ab"), (3, "  "), (4, None), (5, "foo bar baz"), (6, "zz")], "item int, text string")
    docs = spark.createDataFrame([(1, "x foobar BAZ y"), (2, "foo\nbarbaz, a b"), (3, None), (4, "")], "doc int, body string")
    want = {(1, 1), (1, 5), (2, 1), (2, 5), (2, 2)}
    assert sorted((r["doc"], r["item"]) for r in gate.contained(needles, docs, "text", "body").collect()) == sorted(want)
    assert gate.contained(needles.limit(0), docs, "text", "body").count() == gate.contained(needles, docs.limit(0), "text", "body").count() == 0
    keyed = gate.contained(needles.withColumn("k", F.col("item") % 2), docs.withColumn("k", F.col("doc") % 2), "text", "body", on=["k"])
    assert {(r["doc"], r["item"]) for r in keyed.collect()} == {(1, 1), (1, 5), (2, 2)}


def test_containment_of_many_needles(spark, monkeypatch):
    """A hundred thousand values of all lengths, most of which share their ends, in one scan; none reaches the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(12)
    needles = [(i, f"user{i * 7919 % 1000003}@mail.example") for i in range(100_000)] + [(200_000 + i, "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))) for i in range(300)]
    long = ["".join(rng.choice("xyzß ") for _ in range(n)) for n in (63, 64, 65, 66, 1000, 1024, 1025, 5000)]
    needles += [(300_000 + i, t) for i, t in enumerate(long)] + [(400_000 + i, t[:-1] + "q") for i, t in enumerate(long)] + [(5, "user0@mail.example")]
    bodies = ["".join(rng.choice("abéc ") for _ in range(200)) for _ in range(20)] + ["pre " + t.upper().replace("SS", "ß") + " post" for t in long] + ["x" + "  ".join(n[1] for n in rng.sample(needles[:100_000], 30)) for _ in range(20)] + ["", None, "a"]
    docs = [(i, t) for i, t in enumerate(bodies)]
    squeeze = lambda t: "".join((t or "").lower().split())
    by_text = {}
    for i, t in needles:
        by_text.setdefault(squeeze(t), []).append(i)
    want = set()
    for d, t in docs:
        t = squeeze(t)
        sizes = {len(n) for n in by_text if n}
        for n in sizes:
            for k in range(len(t) - n + 1):
                want |= {(d, i) for i in by_text.get(t[k : k + n], ())}
    for name in ("toLocalIterator",):
        monkeypatch.setattr(DataFrame, name, None)
    got = gate.contained(spark.createDataFrame(needles, "item long, text string").repartition(8), spark.createDataFrame(docs, "doc long, body string"), "text", "body")
    assert {(r["doc"], r["item"]) for r in got.collect()} == want and len(want) > 1500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rewriting_of_known_texts(spark):
    cases = [("a@b.co and a@b.co", "[EMAIL_1] and [EMAIL_1]"), ("9876543210 9876543211", "[PHONE_1] [PHONE_2]"), ("9876543210@ybl", "[UPI_1]"), ("4242 4242 4242 4242", "[CARD_1]"), ("9876543210@gmail.com", "[EMAIL_1]"), ("u9876543210@x.com", "[EMAIL_1]"), ("ABC1234567@x.org", "[EMAIL_1]"), ("nothing", "nothing"), (None, None)]
    compat = {"9876543210@ybl": "[PHONE_1][UPI_1]", "4242 4242 4242 4242": "[CARD_1][AADHAAR_1]", "9876543210@gmail.com": "[EMAIL_1][PHONE_1][UPI_1].com", "u9876543210@x.com": "[EMAIL_1][PHONE_1]@x.com", "ABC1234567@x.org": "[EMAIL_1][VOTERID_1]@x.org"}
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, t string")
    strict, _ = tokens.tokenize(df, "t", ["id"], scope=["id"])
    assert [r["clean"] for r in strict.orderBy("id").collect()] == [c[1] for c in cases]
    loose, _ = tokens.tokenize(df, "t", ["id"], scope=["id"], strict=False)
    assert [r["clean"] for r in loose.orderBy("id").collect()] == [compat.get(c[0], c[1]) for c in cases]


def test_fields_are_sanitised(spark):
    rows = [(1, 0, "typed hunter2", "Password", "hunter2"), (1, 1, "4111 1111 1111 1111", "card number", "4111 1111 1111 1111"), (1, 2, "Asha", "Full Name", "Asha"), (1, 3, "mail a@b.co twice a@b.co", "", None), (1, 4, "plain", None, "free"), (2, 0, "x@y.co", "email", "")]
    df = spark.createDataFrame(rows, "page int, ord int, text string, label string, value string")
    out, log = tokens.sanitize_elements(df, ["page"])
    got = {(r["page"], r["ord"]): (r["value"], r["text"]) for r in out.collect()}
    assert got == {(1, 0): ("[SECRET]", "[SECRET]"), (1, 1): ("[CARD_1]", "[CARD_1]"), (1, 2): ("[NAME_1]", "[NAME_1]"), (1, 3): (None, "mail [EMAIL_1] twice [EMAIL_1]"), (1, 4): ("free", "plain"), (2, 0): ("", "[EMAIL_1]")}
    lines = {(r["page"], r["ord"], r["type"]): (r["tier"], r["token"], r["source"], r["masked"]) for r in log.collect()}
    assert lines[1, 0, "password"] == ("A", None, "dom", None) and lines[1, 1, "card"] == ("B", "[CARD_1]", "dom", "XXXX XXXX XXXX 1111")
    assert lines[1, 3, "email"][:3] == ("B", "[EMAIL_1]", "text") and len(lines) == 5


def test_redactions_of_all_sources(spark):
    box = "page int, ord int, x int, y int, w int, h int"
    prose = spark.createDataFrame([(1, 0, 0, 0, 9, 9, "email")], box + ", type string")
    faces = spark.createDataFrame([(1, 0, 50, 50, 10, 10)], box)
    ocr = spark.createDataFrame([(1, 0, 70, 70, 5, 5, "phone", "9876543210", 60, 60, 30, 30)], box + ", type string, value string, region_x int, region_y int, region_w int, region_h int")
    escalated = spark.createDataFrame([(1, 0, 52, 48, 12, 8), (1, 1, 62, 61, 33, 28), (1, 2, 200, 200, 9, 9), (2, 0, 50, 50, 10, 10)], box)
    dom = spark.createDataFrame([(1, 0, 1, 1, 1, 1, "pan")], box + ", type string")
    got = [(r["page"], r["seq"], r["type"], r["x"], r["masked"]) for r in redactions.redaction_union(prose, faces, ocr, escalated, dom, ["page"]).orderBy("page", "seq").collect()]
    assert got == [(1, 0, "email", 0, None), (1, 1, "face", 50, None), (1, 2, "phone", 60, "XXXXXX3210"), (1, 3, "graphics", 200, None), (1, 4, "pan", 1, None), (2, 0, "graphics", 50, None)]


def test_empty_means_and_unknown_tasks(spark):
    none = spark.createDataFrame([], "v double, w int")
    assert none.agg(metrics.weighted_mean(F.col("v"), F.col("w"))).first()[0] is None
    one = spark.range(1)
    assert one.select(reports.task_outcome(F.lit("other"), F.lit("x"), F.lit("1"), F.lit("y"))).first()[0] is None
    assert set(reports.SUCCESS) == {"flight-booking", "bank-transfer", "pii-in-the-wild"}


def test_actions_are_resolved_and_rethought(spark):
    rows = [(1, '{"action":{"type":"click","target":3}}'), (2, "junk"), (3, '{"action":{"type":"click","target":4}}')]
    df = spark.createDataFrame(rows, "k int, raw string")
    got = {r["k"]: (r["source"], r["raw"]) for r in actions.resolve_actions(df, ["k"]).collect()}
    assert got[1] == ("model", rows[0][1]) and got[2][0] == "error_fallback"
    tried = df.where("k = 3").select("k", actions.signature(actions.action_fields(actions.parse_json(F.col("raw")))).alias("sig"))
    assert {r["k"] for r in actions.rethink(df, tried, ["k"]).where("source = 'model'").collect()} == {1}


def test_address_elements_and_sources(spark, tmp_path):
    page = "<address>1 High\n Street <b>Town</b></address><div><address>2nd<script>x</script></address></div><p>none</p>"
    rows = html.addresses(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()
    assert [(r["page_id"], r["ord"], r["text"], r["type"]) for r in rows] == [(1, 0, "1 High Street Town", "address"), (1, 1, "2nd", "address")]
    assert io.json_artifact(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert [r["a"] for r in io.json_artifact(spark, str(tmp_path / "bad.json"), "a int").collect()] == [None]
    io.write_json(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["a"] == 1


def test_sessions(spark):
    df = spark.createDataFrame([(1, 1, "start"), (1, 2, "x"), (1, 3, "done"), (1, 4, "start"), (1, 5, "y")], "k int, t int, line string")
    got = sessions.session_states(df, ["k"], ["t"], F.col("line") == "start", F.col("line") == "done", F.col("line")).orderBy("session").collect()
    assert [(r["n_entries"], r["status"]) for r in got] == [(3, "done"), (2, "running")]
    kept = sessions.tail_distinct(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k int, t int, s string"), ["k"], ["t"], ["s"])
    assert [r["t"] for r in kept.orderBy("t").collect()] == [2, 3]


@pytest.mark.parametrize("line,want", [("Loop finished.", "Agent finished."), ("Redacted 3 PII region(s)", "🔒 Protected 3 sensitive regions"), ("→ Action: CLICK(#3)", "Agent selected CLICK(#3)"), ("USER CANCELED: step", "⛔ You canceled: step"), ("other", "other")])
def test_human_lines(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(X.humanize(F.col("l"))).first()[0] == want


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(X.duration(F.lit(125000))).first()[0] == "2m 5s"
    assert one.select(X.elapsed(F.lit(61250))).first()[0] == "01:01.25"
    assert one.select(X.base36(F.lit(35))).first()[0] == "z"
    assert one.select(X.fnv1a(F.array(F.lit(97)))).first()[0] == 0xE40C292C
    assert one.select(X.normal_key(F.lit("enter"))["key"], X.normal_key(F.lit("q"))["code"]).first()[:] == ("Enter", "Q")
    assert one.select(X.mime_type(F.lit("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJ"))).first()[0] == "image/png"


def test_rules_run_once_over_dealt_rows(spark, monkeypatch):
    from quillon.plans import text

    plans = []
    kept = tokens.durable
    monkeypatch.setattr(tokens, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    spark.range(12_000).selectExpr("id as c_custkey", "cast(0 as int) as c_nationkey").createOrReplaceTempView("many")
    monkeypatch.setattr("quillon.plans.derived.table", lambda session, folder, name: session.table("many").coalesce(1))
    got = text.tokenize_overlap_strict(spark, "")
    assert got.count() == 12_000
    # no filter runs them below the exchange that deals the rows, and a single split becomes as many tasks as its rows need
    searched, _, below = plans[0].partition("REPARTITION_BY_NUM")
    assert plans[0].count("ArrowEvalPython") == 1 and "ArrowEvalPython" in searched and "ArrowEvalPython" not in below
    assert "hashpartitioning(c_custkey" in searched and ", 3)" in searched


def test_places_take_little_memory_beside_their_batch():
    """A long text, and places close together: both are gone through in slices, and nothing is lost at their ends."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from quillon.operators import containment as C

    long = b"x" * 1_999_997 + b"needle" + b"y" * 4_000_000
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([b"needle" * 40_000, long, b"needl"], pa.binary())], ["doc", "body"])
    held = np.zeros(1 << (C.BITS_LOG - 6), np.uint64)
    bit = C.spread(C.grams(np.frombuffer(b"needle", np.uint8), 6, 7))[0]
    held[bit >> np.uint64(6)] |= np.uint64(1) << (bit & np.uint64(63))
    probe = C.prober(SimpleNamespace(value=held.tobytes()), {7: 1024}, 1)
    found, largest = [], 0
    tracemalloc.start()
    for out in probe(iter([batch])):
        largest = max(largest, out.nbytes)
        around = [(d, b, a[b : b + 6]) for d, b, a in zip(out["doc"].to_pylist(), out["__before"].to_pylist(), out["__around"].to_pylist(), strict=True)]
        found += [d for d, b, a in around if a == b"needle"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.count(7) == 40_000 and found.count(8) == 1 and 9 not in found
    assert largest < 8e6 and peak < 60e6, (largest, peak)


def test_a_sweep_has_tasks_by_its_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i % 40, rng.randint(0, 90), rng.randint(0, 500), rng.randint(0, 20), rng.randint(0, 300)) for i in range(600)] + [(0, 5, 5, 9, 9)] * 50
    monkeypatch.setattr(geometry, "PIECES", 100)
    got = geometry.union_area(spark.createDataFrame(rows, "page int, x int, y int, w int, h int"), ["page"], 100, 600)
    pixels = {p: len({(a, b) for q, x, y, w, h in rows if q == p for a in range(x, min(100, x + w)) for b in range(y, min(600, y + h))}) for p in range(40)}
    assert {r["page"]: r["area"] for r in got.collect()} == {p: n for p, n in pixels.items() if n}
    pieces = sum(-(-min(600, y + h) // 256) - y // 256 for _, x, y, w, h in rows if w and h)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # boxes are dealt once, by their number, and not again before the sum of each page
    assert "RepartitionByExpression [page#" in plan and f", {-(-pieces // 100)}" in plan
    first = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert first.count("ENSURE_REQUIREMENTS") <= 2 and "hashpartitioning(page" in first
