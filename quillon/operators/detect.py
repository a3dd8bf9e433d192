"""Detection of sensitive values: counts in pure SQL, matches with offsets through one Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillon.functions.rules import BLANK, RULES, Rule, count_of, digits, field_type, may_match, tier_of

MATCHES = ArrayType(
    StructType([StructField("type", StringType()), StructField("tier", StringType()), StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())])
)


def python_pattern(rule: Rule) -> re.Pattern:
    """The same language in Python: ASCII classes, the blanks spelled out."""
    return re.compile(rule.pattern.replace(BLANK, BLANK.replace(r"\s", r" \t\n\r\f\v")), re.ASCII)


PYTHON_PATTERNS = [(n, r, python_pattern(r)) for n, r in enumerate(RULES)]
PYTHON_GUARD = re.compile(r"@|(?:[0-9][^0-9A-Za-z]?){4}")


def luhn_digits(value: str) -> bool:
    d = [int(c) for c in value if "0" <= c <= "9"]
    if not 13 <= len(d) <= 19:
        return False
    return sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def matches_in(text: str | None, ocr: bool = False) -> list[tuple]:
    """All matches of all rules, by start and then rule order; offsets in code points."""
    if not text or not PYTHON_GUARD.search(text):
        return []
    found = []
    for order, rule, pattern in PYTHON_PATTERNS:
        if rule.ocr_only and not ocr:
            continue
        for m in pattern.finditer(text):
            if rule.luhn and not luhn_digits(m.group()):
                continue
            found.append((m.start(), order, rule, m.end(), m.group()))
    found.sort(key=lambda x: x[:2])
    return [(r.name, r.tier, r.name, s, e, v) for s, _, r, e, v in found]


@F.pandas_udf(MATCHES)
def _find(texts: pd.Series) -> pd.Series:
    return texts.map(matches_in)


@F.pandas_udf(MATCHES)
def _find_ocr(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: matches_in(t, ocr=True))


def find_matches(text: Column, ocr: bool = False) -> Column:
    """Matches with offsets.  Texts that the guard rules out never reach Python's rules."""
    find = _find_ocr if ocr else _find
    return find(F.when(may_match(text), text))


def strict_matches(matches: Column) -> Column:
    """Leftmost longest: contained matches go, a partial overlap joins the earlier match's span."""
    ordered = F.array_sort(matches, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.slice(matches, 1, 0)

    def fold(kept, m):
        last = F.try_element_at(kept, F.lit(-1))
        clear = F.coalesce(last["end"] <= m["start"], F.lit(True))
        inside = m["end"] <= last["end"]
        widened = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(last.withField("end", m["end"])))
        return F.when(clear, F.concat(kept, F.array(m))).when(inside, kept).otherwise(widened)

    return F.aggregate(ordered, empty, fold)


def counts(df: DataFrame, text: str, rules: tuple[str, ...] = tuple(r.name for r in RULES if not r.ocr_only)) -> DataFrame:
    """Adds n_<rule> columns, all JVM-side."""
    return df.withColumns({f"n_{r}": count_of(r, F.col(text)) for r in rules})


def classify_fields(df: DataFrame, label: str) -> DataFrame:
    """Adds field_type and field_tier; rows that share labels are best grouped first."""
    return df.withColumn("field_type", field_type(F.col(label))).withColumn("field_tier", tier_of(F.col("field_type")))


def sensitive_types(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Per key the set of types seen, in order of first appearance."""
    seen = df.select(*keys, order, F.posexplode_outer(find_matches(F.col(text))).alias("at", "m")).where("m is not null")
    first = seen.groupBy(*keys, F.col("m.type").alias("type")).agg(F.min(F.struct(order, "at")).alias("first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "type"))), lambda x: x["type"]).alias("types"))


__all__ = ["find_matches", "strict_matches", "counts", "classify_fields", "sensitive_types", "digits"]
