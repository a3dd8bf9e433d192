"""Text functions: truncation, whitespace, labels of actions, durations, log rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.rules import BLANK


def squash(text: Column) -> Column:
    """Runs of blanks become one space; trimmed."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def truncate(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def token_label(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("_"), n.cast("string"), F.lit("]"))


def trim_nonword(text: Column) -> Column:
    return F.regexp_replace(text, "^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


# ---- fixed values: how tasks name what to type, which must equal the specification ----
QUOTED = '"([^"]{1,50})"'
SEARCHED = r"(?i)search\s+(?:for\s+)?(.+)$"
PLACE = r"(?i)\s+(on|in|at|via|using|to|page|website|site)\s+\S+.*$"
POLITE = r"(?i)^(please|i need to|can you|go to)\s+"
REST = r"(?i)\s+(so that|and|please).*$"
LONGEST, LONGEST_BARE = 50, 40
# ---- end of fixed values ----

#: (pattern of the phrase or None for the whole task, what is cut from it, longest): the first that gives text wins.
PHRASES = ((QUOTED, (), None), (SEARCHED, (PLACE,), LONGEST), (None, (POLITE, REST), LONGEST_BARE))


def type_phrase(task: Column) -> Column:
    """What a task asks to type, by PHRASES."""
    t = F.trim(task)
    found = []
    for pattern, cuts, longest in PHRASES:
        phrase = F.regexp_extract(t, pattern, 1) if pattern else t
        phrase = reduce(lambda c, cut: F.regexp_replace(c, cut, ""), cuts, phrase)
        found.append(F.left(F.trim(phrase), F.lit(longest)) if longest else phrase)
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found[:-1]], found[-1])


def action_label(a: str) -> Column:
    """Short label of an action struct column."""
    c = lambda f: F.coalesce(F.col(f"{a}.{f}").cast("string"), F.lit(""))
    answer = F.when(F.col(f"{a}.answer") != "", F.concat(F.lit(': "'), c("answer"), F.lit('"'))).otherwise("")
    forms = {
        "click": ["CLICK(#", c("target"), ")"],
        "type": ["TYPE(#", c("target"), ', "', c("text"), '")'],
        "press": ["PRESS(", c("key"), ")"],
        "scroll": ["SCROLL(", c("direction"), ")"],
        "navigate": ["NAVIGATE(", c("url"), ")"],
        "wait": ["WAIT(", c("ms"), "ms)"],
        "extract": ['EXTRACT("', c("text"), '")'],
        "done": ["DONE", answer],
        "ask": ['ASK("', F.left(c("question"), F.lit(28)), '")'],
    }
    glue = lambda xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    kind = F.col(f"{a}.type")
    out = reduce(lambda w, kv: w.when(kind == kv[0], glue(kv[1])), list(forms.items())[1:], F.when(kind == "click", glue(forms["click"])))
    return out.otherwise(F.to_json(F.col(a)))


def duration(ms: Column) -> Column:
    s = F.greatest(F.lit(1), F.floor(ms / 1000.0 + 0.5)).cast("long")
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def rounded_millis(ts: Column) -> Column:
    """Milliseconds since 1970, halves away from zero; unix_millis() cuts."""
    us = F.unix_micros(ts)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000).cast("long"))


def elapsed(ms: Column) -> Column:
    """mm:ss.cc"""
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    s = ms / 1000.0
    minutes = F.floor(s / 60)
    wide = F.when(minutes >= 100, minutes.cast("string")).otherwise(two(minutes))
    return F.concat(wide, F.lit(":"), two(F.floor(s) % 60), F.lit("."), two(F.floor((s - F.floor(s)) * 100)))


# ---- fixed values: log wording, key names and colours, which must equal the specification ----
#: Messages that concern machinery rather than the run.
TECHNICAL = r"^\[Step|\bDOM:\b|Sending to VLM|Preloading|Warming|Vision host|Injecting content script|Waiting \d+ms|Fed failure back|Learned:|Executing \w+ \.|Sanitizing PII|On-device vision|zero-leak|Zero-leak|Running on-device"
TRANSIENT = "listener['’]s promise rejected|message channel closed|Receiving end does not exist|Could not establish connection"

#: (how, what, reply): the first that fits rewrites the line.  A reply of None leaves it; "$1" is the first group.
LOG_LINES = (
    ("prefix", "Adaptive loop started", "Agent started with auto-recovery"),
    ("prefix", "Running single step", "Running a single step"),
    ("equal", "Loop finished.", "Agent finished."),
    ("prefix", "Loop stopped by user", "Stopped by user"),
    ("prefix", "Task complete at step", None),
    ("inside", "Too many consecutive failures", None),
    ("inside", "Stuck: same action", "Agent got stuck — recovering…"),
    ("inside", "Recovery fired", "Recovery attempted"),
    ("prefix", "Blocked:", "⛔ $0"),
    ("prefix", "Failed:", None),
    ("inside", "Recovering", None),
    ("inside", "Capturing screenshot", "Captured the current page"),
    ("prefix", "Screenshot captured", "Captured the current page"),
    ("regex", r"^DOM serialized: (\d+) interactive elements", "Found $1 interactive elements"),
    ("regex", r"^Redacted (1) PII region", "🔒 Protected 1 sensitive region"),
    ("regex", r"^Redacted (\d+) PII region", "🔒 Protected $1 sensitive regions"),
    ("equal", "No PII detected", "✓ Nothing sensitive detected"),
    ("prefix", "Vision: ", "Scanned pixels for faces & hidden text"),
    ("prefix", "Zero-leak gate done", "Zero-leak verification passed"),
    ("prefix", "Zero-leak OCR gate skipped", "Zero-leak image gate skipped — DOM gate enforced"),
    ("prefix", "🧠 VLM thought:", None),
    ("rest", "→ Action: ", "Agent selected $1"),
    ("rest", "Done: ", "✓ $1"),
    ("rest", "❓ Asking you:", "🤔 The agent needs your input: $1"),
    ("rest", "👤 You answered:", "✓ Your answer: $1"),
    ("prefix", "⏭ Skipped question", "⏭ Question skipped — continuing."),
    ("rest", "USER CANCELED:", "⛔ You canceled: $1"),
    ("rest", "Confirmed by user:", "✓ You confirmed: $1"),
    ("prefix", "USER SKIPPED", "⏭ Question skipped — continuing."),
    ("prefix", "Server up at", "✓ Connected to the local VLM server"),
    ("prefix", "Server unreachable", "⚠ Server unreachable — start it with uvicorn"),
    ("prefix", "Preloading on-device vision models", "Warming up on-device vision (face + OCR)…"),
    ("prefix", "Vision models ready", "✓ On-device vision ready"),
    ("prefix", "Sensitive page", "⛔ $0"),
    ("prefix", "Vision host unavailable", "Vision host unavailable — DOM-only redaction"),
)

KEYS = {"enter": "Enter", "tab": "Tab", "escape": "Escape", "backspace": "Backspace", "delete": "Delete", "arrowup": "ArrowUp", "arrowdown": "ArrowDown", "arrowleft": "ArrowLeft", "arrowright": "ArrowRight", "space": " "}

ROLE_COLOURS = (
    ("link", "#3b82f6"), ("button", "#22c55e"), ("text", "#a855f7"), ("email", "#f97316"), ("phone", "#f97316"), ("password", "#ef4444"), ("submit", "#22c55e"),
    ("reset", "#ef4444"), ("combobox", "#06b6d4"), ("textbox", "#06b6d4"), ("checkbox", "#eab308"), ("radio", "#eab308"), ("image", "#ec4899"), ("heading", "#8b5cf6"),
)

DETECTORS = {
    "dom": "DOM rule · labelled field / value scan", "text": "text-node sweep · visible prose",
    "vision": "on-device vision · face / OCR", "perception": "local ViT · region escalation",
}
OTHER_DETECTOR = "on-device sanitizer"
TIERS = {"A": "Tier A · blackout", "B": "Tier B · stable token", "C": "Tier C · blur / taint"}

# ---- end of fixed values ----


def technical(line: Column) -> Column:
    """Whether a line concerns machinery."""
    return line.rlike(TECHNICAL)


def transient(error: Column) -> Column:
    """Whether an error passes by itself."""
    return F.coalesce(error.rlike(f"(?i){TRANSIENT}"), F.lit(False))


def humanize(line: Column) -> Column:
    """A log line in plain words: the first entry of LOG_LINES that fits."""
    out = None
    for how, what, reply in LOG_LINES:
        if how == "regex":
            fits, group = line.rlike(what), F.regexp_extract(line, what, 1)
        else:
            fits = {"prefix": line.startswith(what), "rest": line.startswith(what), "equal": line == what, "inside": line.contains(what)}[how]
            rest = F.substr(line, F.lit(len(what) + 1))
            group = F.when(rest.startswith(" "), F.substr(rest, F.lit(2))).otherwise(rest) if what.endswith(":") else rest
        if reply is None:
            value = line
        elif "$" in reply:
            before, after = reply.split("$0" if "$0" in reply else "$1")
            value = F.concat(F.lit(before), line if "$0" in reply else group, F.lit(after))
        else:
            value = F.lit(reply)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(line)


def normal_key(key: Column) -> Column:
    """struct(key, code) of a key name in any case."""
    low = F.lower(F.trim(key))
    table = F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv])
    capital = F.concat(F.upper(F.substring(key, 1, 1)), F.substr(key, F.lit(2)))
    name = F.coalesce(F.try_element_at(table, low), F.when(F.length(key) == 1, key).otherwise(capital))
    code = F.when(low == "space", "Space").otherwise(F.coalesce(F.try_element_at(table, low), F.when(F.length(key) == 1, F.upper(key)).otherwise(capital)))
    return F.struct(name.alias("key"), code.alias("code"))


def role_colour(role: Column) -> Column:
    low = F.lower(role)
    equal = [F.when(low == k, F.lit(v)) for k, v in ROLE_COLOURS]
    inside = [F.when(low.contains(k), F.lit(v)) for k, v in ROLE_COLOURS]
    return F.coalesce(*equal, *inside, F.lit("#64748b"))


def detector_label(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in DETECTORS.items()], F.lit(OTHER_DETECTOR))


def tier_label(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in TIERS.items()])


def image_kb(encoded: Column) -> Column:
    """Size in KB of a base64 body."""
    return F.floor(F.length(encoded) * 3 / 4 / 1024 + 0.5).cast("long")


def mime_type(encoded: Column) -> Column:
    """From a data URL's header, else from the first bytes, else JPEG."""
    header = F.regexp_extract(encoded, r"^data:([^;,]+)", 1)
    start = F.hex(F.try_to_binary(F.left(F.regexp_replace(encoded, r"^data:[^,]*,", ""), F.lit(40)), F.lit("base64")))
    magic = F.when(start.startswith("89504E47"), "image/png").when(start.startswith("FFD8FF"), "image/jpeg").when(start.startswith("47494638"), "image/gif").when(start.startswith("52494646"), "image/webp")
    return F.coalesce(F.nullif(header, F.lit("")), magic, F.lit("image/jpeg"))


def lesson_from(error: Column) -> Column:
    """The element or host that an error is about."""
    return F.coalesce(
        F.nullif(F.regexp_extract(error, r"(?i)element\s+#?(\d+)\s+not found", 1), F.lit("")),
        F.nullif(F.regexp_extract(error, r"(?i)target\s+#?(\d+)", 1), F.lit("")),
    )


def js_round(x: Column, places: int = 0) -> Column:
    """floor(x + 0.5) at so many places."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def fnv1a(codes: Column) -> Column:
    """32-bit FNV-1a of an array of small integers, as a bigint."""
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
