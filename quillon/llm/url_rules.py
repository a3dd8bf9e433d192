"""URL filters: fixed host/path rules first, association rules for the rest.

A URL's items are its site (the last two labels of its host), the other labels, its path words
(numbers as one item), its query names and its scheme.  All URLs are transactions; those that a fixed
rule decides hold ``verdict=...`` as one more item.  Spark's FP-growth mines frequent item sets of all
of them, and the rules whose consequent is a verdict are counted again, exactly, over all URLs.

The fixed rules name only one verdict for some sites, and so a purity among decided URLs alone would
carry that verdict to whatever else such a site holds.  Therefore an undecided URL counts half for
either verdict:

    confidence(X -> v) = (decided as v with X + half of the undecided with X) / (all with X)

Rules are pruned by support, by a floor of LEAST URLs, and by the lower end of the confidence's 95 % interval
(Wilson), so that no rule rests on a few chance pairs; of two rules with the same verdict the more special is
dropped unless it is more confident.  What no fixed rule decides is matched through an inverted index: a
rule is filed under its rarest item, candidates are checked for all their items, and the strongest rule
(confidence, support, number of items, items in order, verdict) decides; without one the verdict is allow.

Where labels come with the data, ``labelled`` takes them instead of the fixed rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import durable

#: (host, path, verdict); the longest that fits wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Least share of all URLs, and least lower end of the confidence.
SUPPORT, CONFIDENCE = 0.005, 0.8
#: URLs that hold a rule's items, at least; and how many standard deviations its confidence is lowered by.
LEAST, SURE = 10, 1.96
#: Rules up to so many are sent to the workers; more are joined by item.
SENT_RULES = 20_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0)) if isinstance(url, str) else F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together) that fits, else nulls; of two equally long
    ones that with the longer host."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def items(url: Column, host: Column, path: Column) -> Column:
    """Distinct items of one URL."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("host:"), x))
    site = F.array(F.concat(F.lit("site:"), F.substring_index(host, ".", -2)))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(words, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "<n>")))
    query = F.regexp_extract_all(url, F.lit(r"[?&]([A-Za-z_]+)="), F.lit(1))
    names = F.transform(query, lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))
    return F.array_sort(F.array_distinct(F.concat(hosts, site, paths, names, scheme)))


def lower_end(share: Column, n: Column, z: float = SURE) -> Column:
    """Lower end of Wilson's interval of a share among n."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def filed(rules: DataFrame) -> DataFrame:
    """Rules with ``item``, the one of their antecedent that the fewest URLs hold; sent whole if they are few."""
    out = rules.withColumn("item", F.element_at(F.transform(F.array_sort(F.arrays_zip("freqs", "antecedent")), lambda x: x["antecedent"]), 1)).drop("freqs")
    return F.broadcast(out) if out.limit(SENT_RULES + 1).count() <= SENT_RULES else out


def fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of ``sets`` (items, ...) with each rule whose items it holds, through the inverted index."""
    held = sets.withColumn("item", F.explode("items")).join(filed(rules), "item")
    return held.where(F.size(F.array_except("antecedent", "items")) == 0)


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Pruned rules (antecedent, verdict, confidence, support, freqs) from (items, verdict) rows.

    A null verdict is undecided.  ``support`` is a share of all rows, ``least`` a number of them; ``confidence`` bounds the lower end
    of a rule's, and is what the column holds; freqs counts the URLs that hold each
    item of the antecedent.  Without decided rows there are no rules.
    """
    bag = rows.select(F.when(F.col("verdict").isNull(), F.col("items")).otherwise(F.array_append("items", F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    # half of the undecided are against a rule, so that this much of all must be for it
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=max(0.0, 2 * confidence - 1)).fit(bag)
    one = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("one"), "freq")
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
    found = durable(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict")))
    single = found.select("antecedent").distinct().withColumn("one", F.explode("antecedent")).join(one, "one")
    freqs = single.groupBy("antecedent").agg(F.array_sort(F.collect_list(F.struct("one", "freq"))).alias("f")).select("antecedent", F.transform("f", lambda x: x["freq"]).alias("freqs"))
    named = durable(freqs)
    sets = rows.groupBy("items", F.col("verdict").alias("given")).agg(F.count("*").alias("times"))
    count = fitting(sets, named).groupBy("antecedent", "given").agg(F.sum("times").alias("times"))
    whole = count.groupBy("antecedent").agg(F.sum("times").alias("all"), F.sum(F.when(F.col("given").isNull(), F.col("times")).otherwise(0)).alias("open"))
    total = rows.count()
    sided = found.join(count.withColumnRenamed("given", "verdict"), ["antecedent", "verdict"]).join(whole, "antecedent").join(named, "antecedent")
    sure = lower_end((F.col("times") + F.col("open") / 2) / F.col("all"), F.col("all")).alias("confidence")
    rules = sided.where(F.col("all") >= least).select("antecedent", "verdict", sure, (F.col("times") / F.lit(max(1, total))).alias("support"), "freqs")
    rules = durable(rules.where(F.col("confidence") >= confidence))
    # the more special of two rules goes unless it adds confidence: every rule looks up its
    # one-item-shorter forms, so the work is rules times their length
    shorter = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("gone")).withColumn("base", F.filter("antecedent", lambda x: x != F.col("gone")))
    known = rules.select(F.col("antecedent").alias("base"), "verdict", F.col("confidence").alias("base_confidence"))
    weak = shorter.join(known, ["base", "verdict"]).where("base_confidence >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(weak, ["antecedent", "verdict"], "left_anti")


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with a column ``mined``: the strongest fitting rule's verdict or null.  Each item set is matched once."""
    rank = F.struct(F.round("confidence", 12), F.round("support", 12), F.size("antecedent"), "antecedent", "verdict")
    best = fitting(rows.select("items").distinct(), durable(rules)).groupBy("items").agg(F.max_by("verdict", rank).alias("mined"))
    return rows.join(best, "items", "left")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    Null URLs and URLs without ``://`` have empty host and path, fit no rule and are judged by their other
    items, if any.  Very long URLs are read whole.  Rows that repeat are judged alike and count each.
    ``labelled`` (items, verdict) may give other transactions, null verdicts being undecided.  Without
    decided URLs nothing is mined and the rest is allowed.  Empty table: no rows.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(url)
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("fixed"), items(F.coalesce(url, F.lit("")), F.col("host"), F.col("path")).alias("items"))
    transactions = durable(rows.select("items", F.col("fixed").alias("verdict")) if labelled is None else labelled.select("items", "verdict"))
    decided = rows.where("fixed is not null").select("page_id", "host", "path", "rule", F.col("fixed").alias("verdict"))
    undecided = rows.where("fixed is null")
    if not transactions.where("verdict is not null").limit(1).count():
        mined = undecided.withColumn("mined", F.lit(None).cast("string"))
    else:
        mined = matched(undecided, mine(transactions))
    return decided.union(mined.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit("allow")).alias("verdict")))
