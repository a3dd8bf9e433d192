"""Prompt text as Columns: ordered optional blocks with caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.perception import TAG_ORDER
from quillon.operators.sessions import last_of

HISTORY, RETHINK_HISTORY, WARNINGS, TARGETS, LESSONS, ELEMENTS = 6, 8, 8, 8, 8, 40
# ---- fixed values: prompt wording, which must equal the specification ----
DO_NOT_REPEAT = "⚠ DO-NOT-REPEAT list (you already tried these and they did NOT work):"
NEVER = "NEVER repeat the exact actions above. Pick a different target, different element, or different strategy."
DETECTED = "DETECTED ELEMENTS (verified by the executor — use VERBATIM, do NOT re-guess):"
USE_ID = "  → if you act on this element, use exactly this integer id."
LEARNED = "Learned lessons from prior runs (these are CORRECT):"
PERCEPTION = "ON-DEVICE PERCEPTION (from a MobileViT computed locally BEFORE upload — it saw this page itself):"
OPAQUE = " non-DOM graphics region(s) (photo/screen/doc-like) — treat them as OPAQUE: never guess their content. Reason from the DOM + numbered tags instead."
HUMAN = "A possible human-verification graphic was detected — do NOT attempt to read it."
STUCK = "You are STUCK. The actions you have tried so far did not complete the task."
NO_DOM = "(No DOM elements captured)"
VISIBLE, REGIONS, REDACTED = "Visible screen: ", " region(s).", "Locally redacted "
BLOCKED = " [BLOCKED — adapt!]"
# ---- end of fixed values ----


def block(title: str, lines: Column, after: Column | None = None) -> Column:
    """A titled list, or null if it is empty."""
    body = F.concat_ws("\n", F.lit("\n" + title), F.array_join(lines, "\n"), *([after] if after is not None else []))
    return F.when(F.size(lines) > 0, body)


def bullets(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("  • "), x))


def warnings(items: Column) -> Column:
    return block(DO_NOT_REPEAT, bullets(last_of(items, WARNINGS)), F.lit(NEVER))


def lessons(items: Column) -> Column:
    return block(LEARNED, bullets(F.slice(items, 1, LESSONS)))


def targets(items: Column) -> Column:
    line = lambda t: F.concat(F.lit("  target #"), t["id"].cast("string"), F.lit(" = "), F.coalesce(t["desc"], F.lit("")), F.lit(USE_ID))
    return block(DETECTED, F.transform(F.slice(items, 1, TARGETS), line))


def perception(summary: Column, escalated: Column, captcha: Column) -> Column:
    get = lambda k: F.coalesce(F.try_element_at(summary, F.lit(k)), F.lit(0))
    parts = F.array_compact(F.array(*[F.when(get(t) > 0, F.concat_ws(" ", get(t).cast("string"), F.lit(t))) for t in TAG_ORDER]))
    seen = F.concat(F.lit(VISIBLE), F.array_join(parts, ", "), F.lit(REGIONS))
    hidden = F.when(escalated > 0, F.concat(F.lit(REDACTED), escalated.cast("string"), F.lit(OPAQUE)))
    return F.when(F.size(parts) > 0, F.concat_ws("\n", F.lit("\n" + PERCEPTION), seen, hidden, F.when(captcha > 0, F.lit(HUMAN))))


def history(steps: Column, most: int = HISTORY, title: str = "Previous steps:", notes: bool = True) -> Column:
    def line(s, i):
        parts = [F.lit("  "), (i + 1).cast("string"), F.lit(". "), s["action"], F.lit(" → "), F.coalesce(s["result"], F.lit(""))]
        if notes:
            parts += [F.when(F.coalesce(s["subgoal"], F.lit("")) != "", F.concat(F.lit(" (subgoal: "), s["subgoal"], F.lit(")"))).otherwise(""), F.when(F.coalesce(s["blocked"], F.lit(False)), F.lit(BLOCKED)).otherwise("")]
        return F.concat(*parts)

    return block(title, F.transform(last_of(steps, most), line))


def elements(items: Column) -> Column:
    def line(e):
        value = F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(' value="'), e["value"], F.lit('"'))).otherwise("")
        cut = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
        return F.concat(F.lit("  ["), e["id"].cast("string"), F.lit("] <"), e["tag"], F.lit("> role="), e["role"], F.lit(' text="'), cut(e["text"], 50), F.lit('" label="'), cut(e["label"], 30), F.lit('"'), value)

    title = F.concat(F.lit("\nDOM elements ("), F.size(items).cast("string"), F.lit(" total):"))
    return F.when(F.size(items) > 0, F.concat_ws("\n", title, F.array_join(F.transform(F.slice(items, 1, ELEMENTS), line), "\n"))).otherwise("\n" + NO_DOM)


def act(task: Column, *blocks: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Task: "), task), *blocks)


def rethink(task: Column, *blocks: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Task: "), task), F.lit(""), F.lit(STUCK), *blocks)
