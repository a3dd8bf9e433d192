"""HTML to rows: elements, text nodes and addresses from one walk, a table function; labels by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INTERACTIVE = frozenset("a button input select textarea label option h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style noscript template".split())
#: Elements that are one finding with all their text.
WHOLE = frozenset(("address",))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?![.\d])", re.I)
MOST_ELEMENTS, MOST_TEXT = 120, 80
WALK = "kind string, ord int, tag string, attrs map<string,string>, text string, start int, stop int"


class Walker(HTMLParser):
    """Document-order walk of static HTML; an invisible element hides all inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.elements: list[dict] = []
        self.nodes: list[tuple[str, str]] = []
        self.whole: list[tuple[int, str]] = []
        self.clock = 0

    def handle_starttag(self, tag, attrs):
        self.clock += 1
        values = {k: v or "" for k, v in attrs}
        hidden = (bool(self.open) and self.open[-1]["hidden"]) or "hidden" in values or bool(HIDDEN.search(values.get("style", ""))) or (tag == "input" and values.get("type", "").lower() == "hidden")
        e = {"tag": tag, "attrs": values, "text": [], "start": self.clock, "stop": self.clock, "hidden": hidden, "silent": tag in SILENT or (bool(self.open) and self.open[-1]["silent"])}
        wanted = tag in INTERACTIVE or "role" in values or "onclick" in values or "onmousedown" in values or "tabindex" in values or (tag == "img" and values.get("alt"))
        if wanted and not hidden and not e["silent"]:
            self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.clock += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                for e in self.open[i:]:
                    self.finish(e)
                del self.open[i:]
                return

    def finish(self, e):
        e["stop"] = self.clock
        if e["tag"] in WHOLE and e["text"]:
            self.whole.append((e["start"], " ".join(e["text"])))

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or (self.open and self.open[-1]["silent"]):
            return
        self.nodes.append((self.open[-1]["tag"] if self.open else "", text))
        for e in self.open:
            e["text"].append(text)

    def done(self):
        self.close()
        self.clock += 1
        for e in self.open:
            self.finish(e)
        return self


def whole_references(html: str) -> str:
    """Character references that are cut before their semicolon, which browsers guess, as plain text."""
    known = lambda name: name.endswith(";") and (name.startswith("#") or name in html5)
    return re.sub(r"&(#?\w*;?)", lambda m: m[0] if known(m[1]) else "&amp;" + m[1], html)


def walked(html: str | None, guess: bool = True) -> Walker:
    w = Walker()
    w.feed((html or "") if guess else whole_references(html or ""))
    return w.done()


class Walk:
    """The walk of one page as a table function: its elements, text nodes and address blocks, told by ``kind``."""

    def eval(self, html: str, guess: bool) -> Iterator[tuple]:
        w = walked(html, guess)
        for i, e in enumerate(w.elements):
            yield "element", i, e["tag"], e["attrs"], " ".join(e["text"]), e["start"], e["stop"]
        for i, (parent, text) in enumerate(w.nodes):
            yield "node", i, parent, None, text, None, None
        for i, (start, text) in enumerate(sorted(w.whole)):
            yield "address", i, "address", None, text, start, None


def walks(pages: DataFrame, key: str = "page_id", html: str = "html", guess: bool = True) -> DataFrame:
    """All that one walk of each page yields, by a lateral join; whoever needs elements and texts takes both from it.

    With ``guess`` a character reference without its semicolon is decoded, as browsers do; else it stays as it is."""
    walk = F.udtf(Walk, returnType=WALK)
    return pages.select(F.col(key).alias("__key"), F.col(html).alias("__html")).lateralJoin(walk(F.col("__html").outer(), F.lit(guess))).drop("__html").withColumnRenamed("__key", key)


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MOST_ELEMENTS, guess: bool = True) -> DataFrame:
    """One row per visible interactive element, at most ``most`` a page, with its interval in the walk."""
    return elements_of(walks(pages, key, html, guess), key, most)


def elements_of(found: DataFrame, key: str = "page_id", most: int = MOST_ELEMENTS) -> DataFrame:
    out = found.where((F.col("kind") == "element") & (F.col("ord") < most))
    a = lambda n: F.try_element_at("attrs", F.lit(n))
    text = F.when(F.length("text") > MOST_TEXT, F.concat(F.left("text", F.lit(MOST_TEXT)), F.lit("…"))).otherwise(F.col("text"))
    return out.select(key, "ord", F.col("ord").alias("id"), "tag", role(F.col("tag"), a("role"), a("type")).alias("role"), text.alias("text"), a("value").alias("value"), "attrs", "start", "stop")


def text_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", guess: bool = True) -> DataFrame:
    return nodes_of(walks(pages, key, html, guess), key)


def nodes_of(found: DataFrame, key: str = "page_id") -> DataFrame:
    return found.where("kind = 'node'").select(key, "ord", F.col("tag").alias("parent"), "text")


def role(tag: Column, explicit: Column, kind: Column) -> Column:
    typed = F.when(kind.isin("submit", "button", "reset", "image"), "button").when(kind.isin("checkbox", "radio"), kind).otherwise("textbox")
    implied = (
        F.when(tag == "a", "link").when(tag == "button", "button").when(tag == "input", typed).when(tag == "textarea", "textbox").when(tag == "select", "combobox").when(tag == "img", "image").when(tag.rlike("^h[1-6]$"), "heading")
    )
    return F.coalesce(F.nullif(explicit, F.lit("")), implied, tag)


def labels(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds ``label``: aria-label, a label that names the id, the nearest label around, then placeholder, title, alt, name.

    The label tags of a page, which are few, stand beside each of its elements, so the walk is read once and nothing is
    joined.  The first label that names an id counts; the one around is the latest that starts before and stops after.
    """
    a = lambda n: F.nullif(F.trim(F.try_element_at("attrs", F.lit(n))), F.lit(""))
    told = F.when(F.col("tag") == "label", F.struct(a("for").alias("for"), "ord", "text", "start", "stop"))
    out = elements.withColumns({"__all": F.collect_list(told).over(Window.partitionBy(key)), "__id": a("id")})
    naming = F.filter("__all", lambda t: t["for"] == F.col("__id"))
    around = F.filter("__all", lambda t: (F.col("tag") != "label") & (t["start"] < F.col("start")) & (F.col("stop") <= t["stop"]))
    for_text = F.array_min(F.transform(naming, lambda t: F.struct(t["ord"].alias("at"), t["text"].alias("text"))))["text"]
    wrap_text = F.array_max(F.transform(around, lambda t: F.struct(t["start"].alias("at"), t["text"].alias("text"))))["text"]
    return out.withColumn("label", F.coalesce(a("aria-label"), for_text, wrap_text, a("placeholder"), a("title"), a("alt"), a("name"))).drop("__all", "__id")


def truth_labels(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of data-gt marks: parts at commas, each split at its first colon."""
    mark = F.try_element_at("attrs", F.lit("data-gt"))
    part = elements.where(mark.isNotNull()).select(key, "ord", F.posexplode(F.split(mark, ",")).alias("at", "part"))
    return part.select(key, "ord", "at", F.trim(F.substring_index("part", ":", 1)).alias("cat"), F.trim(F.regexp_extract("part", "(?s)^[^:]*:(.*)$", 1)).alias("value"))


def addresses(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each address element, with all its text, in document order."""
    return walks(pages, key, html).where("kind = 'address'").select(key, "ord", "text", F.lit("address").alias("type"))


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def media_regions(regions: DataFrame, least: int = 8) -> DataFrame:
    return regions.where((F.col("w") >= least) & (F.col("h") >= least))
