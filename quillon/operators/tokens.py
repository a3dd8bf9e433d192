"""Stable pseudonyms: numbering, rewriting and authorised restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.checkpoint import durable
from quillon.functions.rules import field_type, mask_value, tier_of
from quillon.functions.text import token_label
from quillon.operators.detect import find_matches, strict_matches


def ranked(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """As row_number() over (partition by ``within`` order by ``order``), however large a partition is.

    Rows are dealt over ranges; a range's rows are numbered on from those before it, so that only one row
    for each range and group meets in a window.
    """
    dealt = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    dealt = durable(dealt.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy(*within, "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    earlier = Window.partitionBy(*within).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    out = dealt.join(sizes, [*within, "__p"]).withColumn(name, (F.col("__before") + F.col("__i") - F.col("__first") + 1).cast("int"))
    return out.drop("__p", "__i", "__first", "__before")


def number_tokens(values: DataFrame, order: str | list[str], scope: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(scope…, type, value, n, token) from (scope…, type, value, order).

    Numbers follow first appearance within a scope and type.  Strict keys are (type, value without blanks
    and hyphens in numbers); compat keys are the value alone, which keeps the type it was first seen with.
    Appearances are combined before the shuffle, so a very frequent value is one row by then.
    """
    scope = scope or []
    order = [order] if isinstance(order, str) else order
    at = F.struct(*order)
    if strict:
        key = F.when(F.col("value").rlike("^[0-9+ -]+$"), F.regexp_replace("value", "[ -]", "")).otherwise(F.col("value"))
        first = values.withColumn("value", key).groupBy(*scope, "type", "value").agg(F.min(at).alias("first"))
    else:
        first = values.groupBy(*scope, "value").agg(F.min(at).alias("first"), F.min_by("type", at).alias("type"))
    if scope:
        numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(*scope, "type").orderBy("first")))
    else:
        numbered = ranked(first, ["type"], ["first"], "n")
    return numbered.select(*scope, "type", "value", "n", token_label(F.col("type"), F.col("n")).alias("token"))


def rewrite(text: Column, marks: Column, strict: bool = True) -> Column:
    """Replaces matches (start, end, token) in one left-to-right fold.

    Compat does what a cursor that may step backwards does on overlaps; strict marks never overlap.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cur"))

    def fold(acc, m):
        gap = F.when(m["start"] > acc["cur"], F.substr(text, acc["cur"] + 1, m["start"] - acc["cur"])).otherwise("")
        return F.struct(F.concat(acc["out"], gap, m["token"]).alias("out"), m["end"].alias("cur"))

    return F.aggregate(marks, start, fold, lambda acc: F.concat(acc["out"], F.substr(text, acc["cur"] + 1)))


def number_key(value: Column) -> Column:
    """Numbers without their blanks and hyphens; other values as they are."""
    return F.when(value.rlike("^[0-9+ -]+$"), F.regexp_replace(value, "[ -]", "")).otherwise(value)


def tokenize(df: DataFrame, text: str, keys: list[str], scope: list[str] | None = None, strict: bool = True, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``clean`` and ``n_redacted``, the token table); ``types`` may restrict the rules."""
    found = find_matches(F.col(text))
    if types:
        found = F.filter(found, lambda m: m["type"].isin(types))
    return tokenize_marked(df.withColumn("matches", strict_matches(found) if strict else found), text, keys, keys, scope, strict)


def tokenize_marked(rows: DataFrame, text: str, keys: list[str], order: list[str], scope: list[str] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """As tokenize, for rows that already have ``matches``; values are numbered by ``order`` and place."""
    # the rules run once: what they find is kept, texts are read again without them
    # outer, as else Spark tells empty rows apart below every shuffle, which runs the rules there and then once more
    seen = durable(rows.select(*keys, F.posexplode_outer("matches").alias("at", "m")).where("m is not null").select(*keys, "at", F.col("m.*")))
    table = number_tokens(seen, [*order, "at"], scope, strict)
    norm = number_key(F.col("value")) if strict else F.col("value")
    on = [*(scope or []), "type", "lookup"] if strict else [*(scope or []), "lookup"]
    known = table.withColumnRenamed("value", "lookup").select(*on, "token")
    named = seen.withColumn("lookup", norm).join(known, on, "left")
    marks = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "start", "end", "token", "type", "value"))).alias("marks"))
    out = rows.join(marks, keys, "left")
    clean = F.when(F.col("marks").isNull(), F.col(text)).otherwise(rewrite(F.col(text), F.col("marks"), strict))
    return out.withColumn("clean", clean).withColumn("n_redacted", F.coalesce(F.size("marks"), F.lit(0))).drop("matches"), table


def restore(text: Column, tokens: Column) -> Column:
    """Puts values back for an array of (token, value); longer tokens first, so [X_12] is never read as [X_1]."""
    by_length = F.array_sort(tokens, lambda a, b: F.length(b["token"]) - F.length(a["token"]))
    return F.aggregate(by_length, text, lambda t, m: F.replace(t, m["token"], m["value"]))


def stable_tokens(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First log row of each token that has one and a mask."""
    rank = F.row_number().over(Window.partitionBy(*keys, "token").orderBy(order))
    return log.where("token is not null and masked is not null").withColumn("__r", rank).where("__r = 1").drop("__r")


def masked_log(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("masked", mask_value(F.col(value)))


def sanitize_elements(elements: DataFrame, keys: list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Field-level rule for elements (keys…, ord, text, label, value): (elements, log).

    A secret field is wiped; another named field has the identifiers in its value tokenised, or else its
    whole value, which its text then mirrors; identifiers in the text are tokenised last.  The log has one
    row for each element and type, values before texts.  Strict takes the label only as a field's name,
    compat falls back to the visible text.
    """
    at = [*keys, "ord"]
    name = F.col("label") if strict else F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("text"))
    e = elements.withColumn("field_type", field_type(name)).withColumn("field_tier", tier_of(F.col("field_type")))
    wiped = F.coalesce(F.col("field_tier") == "A", F.lit(False))
    named = F.coalesce(F.col("field_tier") == "B", F.lit(False)) & (F.coalesce(F.col("value"), F.lit("")) != "")
    resolve = strict_matches if strict else (lambda m: m)
    inside = resolve(find_matches(F.when(named, F.col("value"))))
    none = F.slice(F.array(F.struct(*[F.lit("").alias(c) for c in ("type", "tier", "label")], F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))), 1, 0)
    whole = F.array(F.struct(F.col("field_type").alias("type"), F.lit("B").alias("tier"), F.col("field_type").alias("label"), F.lit(0).alias("start"), F.length("value").alias("end"), F.col("value").alias("value")))
    e = e.withColumn("__in", F.when(named, inside)).withColumn("__whole", named & (F.coalesce(F.size("__in"), F.lit(0)) <= 0))
    value_marks = F.when(F.col("__whole"), whole).when(named, F.col("__in")).otherwise(none)
    text_marks = F.when(wiped | F.col("__whole"), none).otherwise(F.coalesce(resolve(find_matches(F.col("text"))), none))
    cell = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("value").alias("body"), value_marks.alias("matches")), F.struct(F.lit(1).alias("part"), F.col("text").alias("body"), text_marks.alias("matches"))))
    cells = e.select(*at, cell.alias("c")).select(*at, "c.*")
    clean, _ = tokenize_marked(cells, "body", [*at, "part"], [*at, "part"], keys, strict)
    done = clean.groupBy(*at).agg(
        F.max(F.when(F.col("part") == 0, F.col("clean"))).alias("__v"),
        F.max(F.when(F.col("part") == 1, F.col("clean"))).alias("__t"),
        F.array_sort(F.flatten(F.collect_list(F.transform(F.coalesce("marks", F.array()), lambda m: F.struct(F.col("part"), m["at"], m["type"], m["token"], m["value"]))))).alias("__m"),
    )
    joined = e.join(done, at, "left")
    secret = F.lit("[SECRET]")
    out = joined.withColumns({"value": F.when(wiped, secret).otherwise(F.col("__v")), "text": F.when(wiped, secret).when(F.col("__whole"), F.col("__v")).otherwise(F.col("__t"))})
    marks = out.select(*at, "field_type", wiped.alias("__wiped"), F.explode_outer("__m").alias("m"))
    rows = marks.where(F.col("__wiped") | F.col("m").isNotNull()).select(*at, F.when(F.col("__wiped"), F.col("field_type")).otherwise(F.col("m.type")).alias("type"), F.when(F.col("__wiped"), "A").otherwise("B").alias("tier"), F.when(~F.col("__wiped"), F.col("m.token")).alias("token"), F.when(F.col("__wiped") | (F.col("m.part") == 0), "dom").otherwise("text").alias("source"), F.when(~F.col("__wiped"), mask_value(F.col("m.value"))).alias("masked"), F.struct("m.part", "m.at").alias("__at"))
    log = rows.groupBy(*at, "type").agg(F.min_by(F.struct("tier", "token", "source", "masked"), "__at").alias("r")).select(*at, "type", "r.*")
    return out.drop("__in", "__whole", "__v", "__t", "__m", "field_tier"), log
