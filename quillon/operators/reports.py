"""Report aggregates over labelled pages, step traces and task runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: label classes and phases, which must equal the specification ----
SUPPORTED = ("name", "email", "phone", "aadhaar", "pan", "card", "address", "password", "face", "account", "ifsc", "upi", "voterid", "dl", "passport")
OUT_OF_SCOPE = ("ssn", "dob")
PHASES = ("capture", "serialize", "sanitize", "vision", "perception", "upload", "vlm", "execute", "rethink")
#: Inside another phase, hence not part of an end-to-end time.
INSIDE = ("perception", "vlm")
# ---- end of fixed values ----

TRANSIENT_BACKOFF_MS, MOST_ATTEMPTS = 600, 3


def label_class(cat: Column) -> Column:
    """supported, phase2, benign or other."""
    c = F.lower(F.trim(F.coalesce(cat, F.lit(""))))
    return F.when(c.isin("", "none"), "benign").when(c.isin(*SUPPORTED), "supported").when(c.isin(*OUT_OF_SCOPE), "phase2").otherwise("other")


def tenth(value: Column, places: int = 1) -> Column:
    return F.round(value.cast("decimal(24,8)"), places).cast("double")


def share_of(total: Column, n: Column, places: int = 1) -> Column:
    """A mean over n rows, or over one where there are none."""
    return tenth(total / F.greatest(n, F.lit(1)), places)


def vision_totals(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sums of face and OCR findings, mean times, the last known model size, and reasons of skips as first seen.

    ``pages`` has face_ms, ocr_ms, faces, regions, hits, models_mb and skipped (array).
    """
    n = F.count("*")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    known = F.when(F.coalesce(F.col("models_mb"), F.lit(0)) != 0, F.col(order))
    out = pages.groupBy(*keys).agg(
        share_of(zero("face_ms"), n).alias("face_ms"),
        share_of(zero("ocr_ms"), n).alias("ocr_ms"),
        *[zero(c).alias(c) for c in ("faces", "regions", "hits")],
        F.coalesce(F.max_by("models_mb", known), F.lit(0)).alias("models_mb"),
    )
    first = pages.select(*keys, order, F.posexplode("skipped").alias("at", "reason")).groupBy(*keys, "reason").agg(F.min(F.struct(order, "at")).alias("first"))
    reasons = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "reason"))), lambda x: x["reason"]).alias("skipped"))
    return out.join(reasons, keys, "left").withColumn("skipped", F.coalesce("skipped", F.array().cast("array<string>")))


def perception_totals(pages: DataFrame, keys: list[str], tags: tuple[str, ...]) -> DataFrame:
    """Over pages with ``enabled``: their number, mean ms, tiles of each tag, escalations and OCR priorities.

    ``pages`` has enabled, ms, summary (map), escalate and ocr_priority (numbers).
    """
    on = F.coalesce(F.col("enabled"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    of_tag = [total(F.coalesce(F.try_element_at("summary", F.lit(t)), F.lit(0))).cast("long").alias(t) for t in tags]
    n = F.count_if(on)
    ms = F.when(n > 0, share_of(total(F.col("ms")), n)).otherwise(0.0)
    return pages.groupBy(*keys).agg(n.alias("pages_enabled"), ms.alias("ms"), *of_tag, total(F.col("escalate")).alias("escalate"), total(F.col("ocr_priority")).alias("ocr_priority"))


def run_latency(steps: DataFrame, keys: list[str], phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Of each run its steps, the mean of each phase (a missing one is 0) and its end-to-end time."""
    ms = lambda p: F.coalesce(F.col(p), F.lit(0))
    whole = sum((ms(p) for p in phases if p not in INSIDE), F.lit(0))
    means = [share_of(F.sum(ms(p)), F.count("*")).alias(p) for p in phases]
    return steps.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.sum(whole).alias("e2e_ms"), *means)


def success_rate(runs: DataFrame, keys: list[str], done: str = "done", steps: str = "n_steps") -> DataFrame:
    n = F.count("*")
    passed = F.count_if(F.coalesce(F.col(done), F.lit(False)))
    at_least_one = F.greatest(F.coalesce(F.col(steps), F.lit(0)), F.lit(1))
    return runs.groupBy(*keys).agg(
        passed.alias("passed"),
        n.alias("total"),
        tenth(passed / n, 2).alias("rate"),
        share_of(F.coalesce(F.sum(steps), F.lit(0)), n).alias("mean_steps"),
        F.min(at_least_one).alias("min_steps"),
        F.max(at_least_one).alias("max_steps"),
    )


def step_time(means: list[Column]) -> Column:
    """A step's time as the sum of independent means; unknown ones are 0."""
    return sum((F.coalesce(m, F.lit(0.0)) for m in means), F.lit(0.0))


def backlog(truth: DataFrame, keys: list[str], cat: str = "cat", phase2: str = "phase2") -> DataFrame:
    """How many labels are of a class that is not scored, and how many are tagged for later."""
    return truth.groupBy(*keys).agg(F.count_if(label_class(F.col(cat)) == "phase2").alias("out_of_scope"), F.count_if(F.coalesce(F.col(phase2), F.lit(False))).alias("tagged"))


def suite_counts(checks: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Passed and failed checks; an unknown outcome failed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return checks.groupBy(*keys).agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"))


def redactions_by_type(log: DataFrame, keys: list[str], source: str = "source", kind: str = "type") -> DataFrame:
    """Redactions of each type; those that were seen in pixels count as images."""
    return log.groupBy(*keys, F.when(F.col(source) == "vision", "image").otherwise(F.col(kind)).alias("type")).agg(F.count("*").alias("n"))


#: Whether a task's goal is met, from its last state (path, complete, answer): predicates by task.
Success = Callable[[Column, Column, Column], Column]
SUCCESS: dict[str, Success] = {}


def success(task: str) -> Callable[[Success], Success]:
    def add(f: Success) -> Success:
        SUCCESS[task] = f
        return f

    return add


# ---- fixed values: goals of the tasks, which must equal the specification ----
BOOKING_PAGE, TRANSFER_PAGE = "flight-payment.html", "bank-transfer-details.html"
PUBLIC = ("support@invoices", "99887", "zzzpm")
LEAK = "345.?6.?7.?8.?9.?0.?1.?2.?3.?4"
# ---- end of fixed values ----


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


@success("flight-booking")
def booked(path: Column, complete: Column, answer: Column) -> Column:
    return F.when(file_name(path) == BOOKING_PAGE, "reached payment step").when(complete == "1", "passenger form correctly filled")


@success("bank-transfer")
def transferred(path: Column, complete: Column, answer: Column) -> Column:
    return F.when(file_name(path) == TRANSFER_PAGE, "reached transfer details step")


@success("pii-in-the-wild")
def reported(path: Column, complete: Column, answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    hits = sum((low.contains(p).cast("int") for p in PUBLIC), F.lit(0))
    leaks = F.regexp_count(low, F.lit(LEAK))
    whole = F.concat(F.lit("reported public contact info and redacted IDs (hits="), hits.cast("string"), F.lit(")"))
    return F.when(low == "", F.lit(None)).when((hits >= 2) & (leaks == 0), whole).when(hits + leaks > 0, "partial")


def task_outcome(task: Column, path: Column, complete: Column, answer: Column) -> Column:
    """What was achieved, or null; unknown tasks never succeed."""
    return F.coalesce(*[F.when(task == name, f(path, complete, answer)) for name, f in SUCCESS.items()])


def retry_schedule(attempts: DataFrame, keys: list[str], order: str, ok: str) -> DataFrame:
    """Attempts until the first success, at most MOST_ATTEMPTS; ``wait_ms`` is the pause after a failure."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    earlier = F.coalesce(F.max(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = attempts.withColumns({"attempt": n, "__done": earlier}).where((F.col("attempt") <= MOST_ATTEMPTS) & (F.col("__done") == 0)).drop("__done")
    return made.withColumn("wait_ms", F.when(F.col(ok), 0).otherwise(F.col("attempt") * TRANSIENT_BACKOFF_MS))


def question_outcomes(questions: DataFrame, answers: DataFrame, keys: list[str], timeout_ms: int = 25_000) -> DataFrame:
    """Questions (keys…, seq, asked) with the first answer (keys…, seq, answered, answer) in time, else skipped.

    A newer question closes an older one, so that a late answer or timer of the old one reaches nothing.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    q = questions.withColumn("until", F.least(F.col("asked") + timeout_ms, F.coalesce(F.lead("asked").over(w), F.col("asked") + timeout_ms)))
    hit = q.join(answers, [*keys, "seq"]).where((F.col("answered") >= F.col("asked")) & (F.col("answered") < F.col("until")) & (F.col("answer") != ""))
    first = hit.groupBy(*keys, "seq").agg(F.min_by("answer", "answered").alias("answer"))
    return q.join(first, [*keys, "seq"], "left").select(*keys, "seq", F.when(F.col("answer").isNull(), "skipped").otherwise("answered").alias("outcome"), F.coalesce("answer", F.lit("")).alias("answer"))
