"""Readers and writers: JSON artifacts, manifests, OCR trees, event streams, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.deploy import ship

#: Rows of a table that one task takes where each is searched by Python's rules.
ROWS_EACH = 5_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, rows: int | None = None, each: int = ROWS_EACH) -> DataFrame:
    """The rows dealt by keys over as many tasks as they need, ``each`` a task, for work that is heavy for every row.

    A small file is one split whatever the cluster's size, and Spark joins small partitions of a shuffle whose number
    is not given.  ``rows`` says how many there are where counting the input would not tell.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(1, -(-rows // each)), *keys)


def json_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One multi-line JSON document; corrupt ones give null fields, a missing path no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def manifest_files(df: DataFrame, json: str, keys: list[str] | None = None) -> DataFrame:
    """(keys…, file, bytes) of manifest texts {"files": {name: bytes}}; unreadable ones give no rows."""
    files = F.from_json(F.col(json), "totalBytes bigint, files map<string,bigint>")
    return df.select(*(keys or []), F.explode(files["files"]).alias("file", "bytes"))


def trace_rows(runs: DataFrame, keys: list[str], trace: str) -> DataFrame:
    """The steps of all runs' traces as rows; a run without steps gives none."""
    return runs.select(*keys, F.explode(trace).alias("__s")).select(*keys, "__s.*")


def sorted_names(names: Column) -> Column:
    """Names in ascending order without empty ones."""
    return F.array_sort(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def sessions_of(df: DataFrame, text: str, schema: str) -> Column:
    """Stored sessions of a text; an unreadable one holds none."""
    held = F.from_json(F.col(text), f"array<struct<{schema}>>")
    return F.coalesce(held, F.array().cast(f"array<struct<{schema}>>"))


def message_rows(df: DataFrame, body: str, schema: str) -> DataFrame:
    """Messages of a bus as typed rows: ``kind`` and the fields that its kind has; unreadable bodies keep their text."""
    parsed = F.from_json(F.col(body), f"type string, {schema}")
    return df.select("*", parsed.alias("__m")).select(*df.columns, F.col("__m.type").alias("kind"), *[F.col(f"__m.{f.split()[0]}") for f in schema.split(", ")])


def from_json_rows(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Parsed fields next to the raw row; unreadable text gives nulls."""
    return df.withColumn("parsed", F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def configured(value: Column, kind: str, default, low=None, high=None) -> Column:
    """A typed setting, its default where it is missing, unreadable or out of range."""
    v = value.try_cast(kind)
    ok = v.isNotNull()
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.when(ok, v).otherwise(F.lit(default).cast(kind))


def ocr_lines(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """Lines with words of an OCR tree: blocks → paragraphs → lines, or lines at the top."""
    nested = df.select(*keys, F.explode(f"{tree}.blocks").alias("b")).select(*keys, F.explode("b.paragraphs").alias("p")).select(*keys, F.explode("p.lines").alias("line"))
    flat = df.where(F.coalesce(F.size(f"{tree}.blocks"), F.lit(-1)) <= 0).select(*keys, F.explode(f"{tree}.lines").alias("line"))
    return nested.union(flat).where(F.size("line.words") > 0)


def scripted(df: DataFrame, script: Column, seq: Column, repeat_last: bool = True) -> DataFrame:
    """The reply at a position; past the end the last one, or null when exhausted."""
    at = F.least(seq, F.size(script)) if repeat_last else seq
    return df.withColumn("reply", F.try_element_at(script, at.cast("int")))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_events(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys…, seq, event, data) of event-stream texts: data lines take the event line before them."""
    line = df.select(*keys, F.posexplode(F.split(body, "\r?\n")).alias("at", "line"))
    w = Window.partitionBy(*keys).orderBy("at")
    name = F.when(F.col("line").startswith("event:"), F.trim(F.substr("line", F.lit(7))))
    named = line.withColumn("event", F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("line").startswith("data:"))
    return named.select(*keys, (F.row_number().over(w) - 1).alias("seq"), F.coalesce("event", F.lit("message")).alias("event"), F.trim(F.substr("line", F.lit(6))).alias("data"))


def first_action(events: DataFrame, keys: list[str]) -> DataFrame:
    """First readable action of each stream and the last error."""
    good = F.try_parse_json("data").isNotNull()
    return events.groupBy(*keys).agg(F.min_by("data", F.when((F.col("event") == "action") & good, F.col("seq"))).alias("action"), F.max_by("data", F.when(F.col("event") == "error", F.col("seq"))).alias("error"))


def capture_rows(requests: DataFrame, image: str = "screenshot_b64") -> DataFrame:
    """Requests for an append-only log: the image is replaced by its length."""
    keep = [c for c in requests.columns if c != image]
    return requests.select(*keep, F.length(image).cast("long").alias("screenshotBytes"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
