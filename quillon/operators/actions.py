"""Tolerant parsing, validation and veto of proposed actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rules import once
from quillon.functions.text import squash
from quillon.operators.detect import find_matches

TYPES = ("click", "type", "press", "scroll", "navigate", "wait", "extract", "done", "ask")
FIELDS = ("amount int", "answer string", "direction string", "key string", "ms int", "options array<string>", "question string", "target int", "text string", "type string", "url string")
NEEDS = {"click": ("target",), "type": ("target", "text"), "press": ("key",), "scroll": ("direction",), "navigate": ("url",), "wait": ("ms",), "extract": ("text",), "done": (), "ask": ("question",)}


def parse_json(raw: Column) -> Column:
    """VARIANT of the object that holds "action": the fenced text, else the widest object in it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    wide = F.regexp_extract(raw, r'(?s)\{.*"action".*\}', 0)
    good = lambda text: once(F.try_parse_json(text), lambda v: F.when(F.try_variant_get(v, "$.action", "variant").isNotNull(), v))
    return F.coalesce(good(bare), good(wide))


def action_of(parsed: Column) -> Column:
    """The action object; one nested under "type" is unwrapped.  Null without a string type."""
    kind = lambda v: F.try_variant_get(v, "$.type", "variant")
    outer = lambda action: once(kind(action), lambda nested: F.when(F.schema_of_variant(nested).startswith("OBJECT"), nested).otherwise(action))
    inner = once(F.try_variant_get(parsed, "$.action", "variant"), outer)
    return once(inner, lambda v: F.when(F.schema_of_variant(kind(v)) == "STRING", v))


def plain_target(raw: Column) -> Column:
    """Element id from 7, 7.0, [7], "7" or "[7]"; null for words."""
    one = F.regexp_replace(F.trim(raw), r"^\[\s*|\s*\]$", "")
    one = F.trim(F.regexp_replace(one, "^[\"'`]+|[\"'`]+$", ""))
    one = F.regexp_replace(one, r"^\[\s*|\s*\]$", "")
    whole = F.regexp_replace(one, r"\.0+$", "")
    return F.when(one == "true", 1).when(one == "false", 0).when(whole.rlike("^-?[0-9]+$"), whole.try_cast("int"))


def words_of(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(raw), "^[\\[\\]\"'`]+|[\\[\\]\"'`]+$", "")))


def match_rank(tag: Column, role: Column) -> Column:
    t, r = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    field = t.isin("input", "textarea", "select") | r.isin("textbox", "combobox", "searchbox")
    press = t.isin("button", "a") | r.isin("button", "link")
    return F.when(field, 0).when(press, 1).otherwise(2)


def resolve_targets(requests: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``resolved`` to (keys…, target): an id as given, else the best element whose words hold the target.

    Distinct words asked on a page meet that page's elements, which are at most as many as a snapshot holds
    (MOST_ELEMENTS of the element walk).
    """
    plain = requests.withColumn("plain", plain_target(F.col("target"))).withColumn("needle", words_of(F.col("target")))
    el = elements.select(*keys, "id", "ord", F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("tag", F.lit("")))).alias("hay"), match_rank(F.col("tag"), F.col("role")).alias("rank"))
    asked = plain.where("plain is null and needle <> ''").select(*keys, "needle").distinct()
    hit = asked.join(el, keys).where(F.col("hay").contains(F.col("needle"))).groupBy(*keys, "needle").agg(F.min_by("id", F.struct("rank", "ord")).alias("found"))
    return plain.join(hit, [*keys, "needle"], "left").withColumn("resolved", F.coalesce("plain", "found")).drop("plain", "found", "needle")


def validate(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds parsed, action_type, target, ok and error (the first check that fails)."""
    v = responses.withColumn("parsed", parse_json(F.col(raw))).withColumn("act", action_of(F.col("parsed")))
    get = lambda path: F.try_variant_get("act", path, "string")
    v = v.withColumn("action_type", get("$.type")).withColumn("target", get("$.target"))
    wanted = F.col("action_type").isin("click", "type") & F.col("target").isNotNull()
    missing = F.lit(False)
    for kind, names in NEEDS.items():
        for n in names:
            missing = missing | ((F.col("action_type") == kind) & get(f"$.{n}").isNull())
    error = (
        F.when(F.col("parsed").isNull(), "response was not valid JSON")
        .when(F.col("act").isNull(), "'action' is missing or has no string 'type'")
        .when(~F.col("action_type").isin(*TYPES), F.concat(F.lit("invalid action type '"), F.col("action_type"), F.lit("'")))
        .when(wanted & plain_target(F.col("target")).isNull() & (F.coalesce(F.col("resolved") if "resolved" in responses.columns else F.lit(None).cast("int"), F.lit(-1)) < 0), F.concat(F.lit("target '"), F.col("target"), F.lit("' does not match any DOM element id")))
        .when(missing, "a required field is missing")
    )
    return v.withColumn("error", error).withColumn("ok", error.isNull())


def signature(action: Column) -> Column:
    """Canonical JSON: fields in alphabetical order, nulls kept."""
    return F.to_json(action, {"ignoreNullFields": "false"})


def attempts(responses: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """First valid attempt of each request, else a wait; (keys…, source, raw)."""
    first = Window.partitionBy(*keys).orderBy(attempt)
    ranked = validate(responses).where("ok").withColumn("r", F.row_number().over(first)).where("r = 1")
    chosen = ranked.select(*keys, F.when(F.col(attempt) == 1, "model").otherwise("retry").alias("source"), "raw")
    everyone = responses.select(*keys).distinct()
    return everyone.join(chosen, keys, "left").select(*keys, F.coalesce("source", F.lit("error_fallback")).alias("source"), F.coalesce("raw", F.lit('{"action":{"type":"wait","ms":1000}}')).alias("raw"))


def resolve_actions(responses: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """The service's answer to each request: its first valid attempt, as it was sent, else a wait; (keys…, source, raw)."""
    rows = responses.withColumnRenamed(raw, "raw") if raw != "raw" else responses
    if "attempt" not in rows.columns:
        rows = rows.withColumn("attempt", F.lit(1))
    return attempts(rows, keys)


def rethink(responses: DataFrame, history: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """As resolve_actions for a stuck run, without answers whose action was tried before (keys…, sig)."""
    known = responses.withColumn("sig", signature(action_fields(parse_json(F.col(raw)))))
    return resolve_actions(veto_repeats(known, history, keys).drop("sig"), keys, raw)


def action_fields(parsed: Column) -> Column:
    """The action of a parsed answer with every field there is, in alphabetical order."""
    return F.from_json(F.to_json(action_of(parsed)), "struct<" + ",".join(f.replace(" ", ":") for f in FIELDS) + ">")


def clicked(history: Column) -> Column:
    """Distinct targets of the clicks in an array of actions, as first seen."""
    return F.array_distinct(F.transform(F.filter(history, lambda a: (a["type"] == "click") & a["target"].isNotNull()), lambda a: a["target"]))


def veto_repeats(proposed: DataFrame, history: DataFrame, keys: list[str], sig: str = "sig") -> DataFrame:
    return proposed.join(history.select(*keys, sig).distinct(), [*keys, sig], "left_anti")


def untried(elements: DataFrame, clicked: DataFrame, keys: list[str]) -> DataFrame:
    """Next element to try per key: the first labelled button or link not clicked yet, else the first not clicked, else Escape."""
    left = elements.join(clicked.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").where("id >= 0")
    labelled = F.lower("tag").isin("button", "a") & (F.trim(F.coalesce("label", F.lit(""))) != "")
    pick = left.groupBy(*keys).agg(F.min_by("id", F.struct(F.when(labelled, 0).otherwise(1).alias("p"), "ord")).alias("id"))
    everyone = elements.select(*keys).distinct()
    return everyone.join(pick, keys, "left").select(*keys, F.when(F.col("id").isNull(), "press").otherwise("click").alias("action"), F.col("id").alias("target"), F.when(F.col("id").isNull(), "escape").alias("key"))


def rewrite_allowed(current: Column, typed: Column, protected: Callable[[Column], Column] | None = None) -> Column:
    """Empty fields may be filled; a protected value may only be typed again as it is."""
    old = squash(F.coalesce(current, F.lit("")))
    same = squash(F.coalesce(typed, F.lit(""))) == old
    guarded = protected(current) if protected else F.size(find_matches(current)) > 0
    return (old == "") | same | ~F.coalesce(guarded, F.lit(False))


def may_submit(action_ok: Column, filled: Column, submitted: Column) -> Column:
    return F.coalesce(action_ok & (filled > 0) & ~submitted, F.lit(False))


def is_file_input(tag: Column, kind: Column) -> Column:
    return (F.lower(tag) == "input") & (F.lower(F.coalesce(kind, F.lit(""))) == "file")


def is_read_task(task: Column) -> Column:
    return task.rlike(r"(?i)(read|what|which|how much|how many|summar|tell me|find out|list)")
