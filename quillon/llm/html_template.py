"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: opening and closing tags, and whole text blocks, each in the role that
its path of containers gives it (containers of one kind without a class are told apart by their
order).  Over the distinct pages of one host every token has an occurrence vector, how often it stands
on each page; its hash is a sum over pages and so combines before any shuffle.

* Tokens with the same vector are an equivalence class, if enough pages hold them.
* A class is valid if it has several tokens, a tag among them, and they are ordered and nested: on a
  page the class is repeated whole, always in the same order, and each repeat lies within one slot (gap
  between neighbouring tokens) of any class that it does not enclose.  One order and one parent slot
  must hold on enough pages; pages of another order do not use the class.
* Valid classes nest by parent slot into the host's template.  Text outside them fills slots.

The containers of a host are then judged by what their slots hold.  The main container is the one whose
slots hold the most unlinked words; it and all inside are data and stay whole, also where a passage
repeats on many pages.  Of the others those are boilerplate that stand in the template and hold mostly
template text (mastheads, notices, imprints), mostly links (menus), or a line of a few words beside a
main text of many (adverts, copyright lines).  Template text anywhere else outside the main container
goes, too.

Elements decide first: menus, headers, footers, sidebars, forms, scripts, styles and what is hidden are
never read.  If a page marks an article, only that is its main text, unless a container beside it holds
more (then the mark is on a teaser).  Class and id words only break ties: a container whose name
consists of words for boilerplate and layout alone is no main container and goes if any other text stays.

Pages of a host with equal html count once, so that copies of an article do not make it a template.
Hosts with under MIN_PAGES distinct pages have no template; there the same judgement of links and marks
is made on the page alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import durable

MIN_PAGES, MIN_SUPPORT, MIN_TOKENS = 3, 0.5, 2
#: A container of up to so many words a page is a line, if the main one holds LARGER times as many.
LINE, LARGER = 16, 10
#: All templates are sent to the workers up to so many bytes; beyond, those of hosts with at least 1 / HEAVY
#: of all pages are, which are HEAVY at most, and the others are joined.
SENT_BYTES, HEAVY = 32 << 20, 1024
#: Digests of copied pages up to so many are sent; more are joined.
SENT_COPIES = 200_000
#: The token that every page holds once.
PAGE = 0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NUMBER = re.compile("[0-9]+")
NAMES = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never part of an article, with all inside.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object svg canvas select button dialog menu textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside body center div dl footer form header html main nav ol section table td ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that name boilerplate, if only words for layout stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus replies respond pagination pager skip toolbar widget paywall".split()
)
LAYOUT = frozenset(
    "a an area article articles banner bar block body bottom box button buttons center col column container content contents entry first footer form global group header holder id inner items last left link links list main media module one outer page panel post posts primary reader right row secondary section site slot small strip the thread top unit user users wrap wrapper".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main".split())


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(text)} if text.strip(" /\n\t") else {}


def hidden(tag: str, attr: dict[str, str], in_article: bool) -> bool:
    """Whether the element's kind says that it holds no main text."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attr:
        return False
    return "hidden" in attr or attr.get("aria-hidden", "").lower() == "true" or attr.get("role", "").lower() in ROLES or "display:none" in attr.get("style", "").replace(" ", "").lower()


@lru_cache(maxsize=100_000)
def marked_name(name: str, in_article: bool) -> bool:
    """Whether a class or id is made of words for boilerplate and layout only."""
    parts = {x.lower() for x in NAMES.findall(name)}
    parts = {x for x in parts if not x.isdigit()}
    if parts <= LAYOUT:
        return "header" in parts and not in_article and parts <= {"header", "site", "page", "top", "main", "global", "wrapper", "container", "inner"}
    return parts <= LAYOUT | MARKS


def marked(tag: str, attr: dict[str, str], in_article: bool) -> bool:
    """Whether a name of the element speaks of boilerplate."""
    if not attr or tag in ("html", "body"):
        return False
    names = attr.get("class", "").split() + attr.get("id", "").split()
    return any(marked_name(x, in_article) for x in names)


@lru_cache(maxsize=200_000)
def path_codes(path: str) -> tuple[int, ...]:
    """Codes of a container path and of all that enclose it, innermost first."""
    out = []
    while path:
        out.append(code(path))
        path = path.rpartition(">")[0]
    return tuple(out)


@lru_cache(maxsize=200_000)
def tag_code(path: str, tag: str) -> int:
    return code(f"{path}\0<{tag}>")


class Block:
    """A run of text: its container path, whether an article is marked around it, whether a name speaks
    of boilerplate, its text, how many of its characters are linked, whether it is a heading."""

    __slots__ = ("article", "heading", "linked", "path", "soft", "text")

    def __init__(self, path: str, article: bool, soft: bool, text: str, linked: int, heading: bool):
        self.path, self.article, self.soft, self.text, self.linked, self.heading = path, article, soft, text, linked, heading

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def menu(self) -> bool:
        return self.linked * 2 > len(self.text)

    def code(self) -> int:
        return code(f"{self.path}\0{self.text}")


class Frame:
    __slots__ = ("article", "kinds", "path", "skipped", "soft", "tag")

    def __init__(self, tag: str, skipped: bool, article: bool, soft: bool, path: str):
        self.tag, self.skipped, self.article, self.soft, self.path = tag, skipped, article, soft, path
        self.kinds: dict[str, int] = {}


class Page:
    """Blocks of one page, and its tokens in order: codes of tags, and blocks."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.tokens: list[int | Block] = []
        stack = [Frame("", False, False, False, "")]
        piece: list[str] = []
        links = linked = 0

        def flush() -> None:
            nonlocal linked
            if piece:
                text = " ".join(unescape("".join(piece)).split())
                if text:
                    top = stack[-1]
                    block = Block(top.path, top.article, top.soft, text, linked, any(f.tag in HEADINGS for f in stack))
                    self.blocks.append(block)
                    self.tokens.append(block)
                piece.clear()
            linked = 0

        def close(until: int) -> None:
            if any(f.tag in BLOCK for f in stack[until:]):
                flush()
            for f in reversed(stack[until:]):
                self.tokens.append(tag_code(f.path, "/" + f.tag))
            del stack[until:]

        at, n = 0, len(html)
        while at < n:
            m = TOKEN.match(html, at)
            at = m.end()
            first = m.group(0)
            if first[0] != "<" or first == "<":
                if not stack[-1].skipped:
                    piece.append(first)
                    if links:
                        linked += len(first)
                continue
            name = m.group(2) or m.group(5)
            if not name:
                continue
            tag = name.lower()
            if m.group(1) or m.group(4):
                if tag == "a":
                    links = max(0, links - 1)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    if tag in BLOCK:
                        flush()
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br" and not stack[-1].skipped:
                    piece.append(" ")
                continue
            if tag in BLOCK:
                flush()
                links = 0 if tag in CONTAINER else links
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in SCOPE:
                        break
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[tag]:
                        close(i)
                        break
                    if stack[i].tag in SCOPE and stack[i].tag not in CLOSES[tag]:
                        break
            if tag == "a":
                links = 1  # links do not nest
            attr = attributes(m.group(3) or m.group(6) or "")
            top = stack[-1]
            path = top.path
            if tag in CONTAINER:
                named = attr.get("class") and tag not in ("html", "body")
                kind = tag + ("." + NUMBER.sub("#", " ".join(attr["class"].split())) if named else "")
                if not named:
                    top.kinds[kind] = nth = top.kinds.get(kind, 0) + 1
                    kind = f"{kind}[{nth}]"
                path = f"{path}>{kind}"
            skipped = top.skipped or hidden(tag, attr, top.article)
            soft = top.soft or marked(tag, attr, top.article)
            if tag not in BLOCK and soft and not top.soft:
                skipped, soft = True, False  # a marked phrase inside a block goes
            self.tokens.append(tag_code(path, tag))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else n
                if end:
                    gt = html.find(">", at)
                    at = gt + 1 if gt >= 0 else n
                continue
            if tag not in BLOCK and skipped == top.skipped and tag not in DROPPED:
                continue  # plain inline markup changes nothing
            stack.append(Frame(tag, skipped, top.article or tag in ("article", "main"), soft, path))
        if not stack[-1].skipped:
            flush()

    def codes(self) -> list[int]:
        return [PAGE, *(t if isinstance(t, int) else t.code() for t in self.tokens)]

    def main_text(self, template: Template | None = None) -> str:
        live = [b for b in self.blocks if not template.drops(b)] if template else self.unlinked()
        if any(b.article for b in live):
            inside, beside = 0, {}
            for b in live:
                if b.article:
                    inside += 0 if b.soft else b.words
                elif not b.soft and not b.menu:
                    beside[b.path] = beside.get(b.path, 0) + b.words
            if inside and inside >= max(beside.values(), default=0):
                live = [b for b in live if b.article]
        if any(not b.soft for b in live):
            live = [b for b in live if not b.soft]
        return "\n".join(b.text for b in live)

    def unlinked(self) -> list[Block]:
        """The blocks without those of containers that mostly hold links, the largest container apart."""
        plain: dict[str, int] = {}
        menu: dict[str, int] = {}
        for b in self.blocks:
            if not b.soft:
                count = menu if b.menu else plain
                count[b.path] = count.get(b.path, 0) + b.words
        if not plain:
            return self.blocks
        main = max(plain, key=lambda p: plain[p])
        whole = main.count(">") > 2
        gone = {p for p, n in menu.items() if n > plain.get(p, 0) and p != main and not (whole and p.startswith(main + ">"))}
        return [b for b in self.blocks if b.article or b.path not in gone]


class Template:
    """What a host's template says: its main container, boilerplate containers and template text."""

    __slots__ = ("areas", "main", "texts", "whole")

    def __init__(self, main: int | None, whole: bool, areas: list[int], texts: list[int]):
        self.main, self.whole, self.areas, self.texts = main, whole, frozenset(areas), frozenset(texts)

    def drops(self, block: Block) -> bool:
        if block.article:
            return False
        own = path_codes(block.path)
        if self.main in own[: None if self.whole else 1]:
            return False
        return any(c in self.areas for c in own) or (block.code() in self.texts if self.texts else False)


def code(text: str) -> int:
    """Signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def host_column(url: str = "url") -> Column:
    """The host, lower-cased; empty for null or without ``://``."""
    return F.lower(F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), r"^([^/?#]*)", 1))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


TOKENS = "host string, token long, text boolean, pages long, vector_a long, vector_b long"
TOKENS_ARROW = pa.schema([("host", pa.string()), ("token", pa.int64()), ("text", pa.bool_()), *[(c, pa.int64()) for c in ("pages", "vector_a", "vector_b")]])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, html → tokens combined within a batch: pages, and the summed hashes of the occurrence vector."""
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(html)
            count: dict[tuple[int, bool], int] = {(PAGE, False): 1}
            for t in page.tokens:
                key = (t, False) if isinstance(t, int) else (t.code(), True)
                count[key] = count.get(key, 0) + 1
            own_code = code(html)
            for (token, text), n in count.items():
                own = total.setdefault((host, token, text), [0, 0, 0])
                seed = f"{own_code}:{n}"
                own[0] += 1
                own[1] += xxhash.xxh32_intdigest(seed, 1)
                own[2] += xxhash.xxh32_intdigest(seed, 2)
        yield batch_of([(*k, *v) for k, v in total.items()], TOKENS_ARROW)


def arrangement(codes: list[int], classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each class on a page the code of its members' order, and of the slot that encloses it.

    The order is 0 if the class is not repeated whole in one order, or lies across the slots of a
    larger class; the parent is 0 outside every class.
    """
    at: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        own = classes.get(c)
        if own is not None:
            at.setdefault(own, []).append(i)
    size: dict[int, int] = {}
    order: dict[int, int] = {}
    for c, places in at.items():
        seen = [codes[i] for i in places]
        size[c] = m = len(set(seen))
        whole = len(seen) % m == 0 and len(set(seen[:m])) == m and all(seen[i] == seen[i % m] for i in range(m, len(seen)))
        order[c] = (code(",".join(map(str, seen[:m]))) or 1) if whole else 0
    found: dict[int, tuple[int, int]] = {}
    for c, places in at.items():
        if not order[c]:
            found[c] = (0, 0)
            continue
        m = size[c]
        slots = set()
        for k in range(0, len(places), m):
            lo, hi = places[k], places[k + m - 1]
            inner = (len(codes) + 1, 0, 0)
            for d, others in at.items():
                if d == c or not order[d]:
                    continue
                n = size[d]
                i, j = bisect_left(others, lo), bisect_left(others, hi)
                if i == j:
                    if i % n:  # inside a repeat of d, after its (i mod n)-th token
                        start = i - i % n
                        inner = min(inner, (others[start + n - 1] - others[start], d, i % n))
                elif (i % n or j % n) and (m, c) < (n, d):
                    slots.add(None)
            slots.add(inner[1:])
        parent = next(iter(slots)) if len(slots) == 1 else None
        found[c] = (order[c], code(f"{parent[0]}/{parent[1]}") if parent[0] else 0) if parent else (0, 0)
    return found


STATS = "host string, kind int, a long, b long, c long, pages long, words long, plain long, fixed long, heads long, depth int, held long"
STATS_ARROW = pa.schema([("host", pa.string()), ("kind", pa.int32()), *[(x, pa.int64()) for x in ("a", "b", "c", "pages", "words", "plain", "fixed", "heads")], ("depth", pa.int32()), ("held", pa.int64())])
#: Rows of STATS: an arrangement (class, order, parent), and a container (code, class of its opening tag).
ARRANGED, CONTAINED = 0, 1


def arrangements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, html, classes → arrangements of classes, and what containers hold, combined within a batch."""
    known: dict[str, dict[int, int]] = {}
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        hosts, pages, listed = batch.columns
        for i in range(batch.num_rows):
            host = hosts[i].as_py()
            classes = known.get(host)
            if classes is None:
                if len(known) > 2000:
                    known.clear()
                classes = known[host] = {x["token"]: x["class"] for x in listed[i].as_py() or ()}
            if not classes:
                continue
            page = Page(pages[i].as_py())
            for c, (order, parent) in arrangement(page.codes(), classes).items():
                total.setdefault((host, ARRANGED, c, order, parent), [0] * 7)[0] += 1
            own: dict[str, list[int]] = {}
            for b in page.blocks:
                if b.article or b.soft:
                    continue
                s = own.setdefault(b.path, [1, 0, 0, 0, 0, b.path.count(">"), 1])
                s[1] += b.words
                s[2] += 0 if b.menu else b.words
                s[3] += b.words if b.code() in classes else 0
                s[4] += b.heading
            for path, s in own.items():
                tag = path.rpartition(">")[2].partition(".")[0].partition("[")[0]
                row = total.setdefault((host, CONTAINED, code(path), classes.get(tag_code(path, tag)), None), [0] * 7)
                for k in (0, 1, 2, 3, 4, 6):
                    row[k] += s[k]
                row[5] = s[5]
        yield batch_of([(*k, *v) for k, v in total.items()], STATS_ARROW)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host and html, each html of a host once; only pages that have copies are shuffled where these are few."""
    keyed = pages.where("html <> ''").select("host", F.md5("html").alias("digest"), "html")
    copied = durable(keyed.groupBy("host", "digest").count().where("count > 1").select("host", "digest"))
    if copied.limit(SENT_COPIES + 1).count() <= SENT_COPIES:
        copied = F.broadcast(copied)
    single = keyed.join(copied, ["host", "digest"], "left_anti").select("host", "html")
    several = keyed.join(copied, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.first("html").alias("html"))
    return single.union(several.select("host", "html"))


def with_hosts(rows: DataFrame, by_host: DataFrame, pages_of: DataFrame, kept: list[str]) -> DataFrame:
    """Left join of pages with one row for each host, whose size is checked.

    What a host has is bounded by its frequent tokens, at most 1 / MIN_SUPPORT times those of a mean page.
    """
    size = F.octet_length(F.to_json(F.struct(*[c for c in by_host.columns if c != "host"])))
    if (by_host.agg(F.sum(size)).first()[0] or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(by_host), "host", "left").select(*kept)
    total = pages_of.agg(F.sum("host_pages")).first()[0]
    heavy = F.broadcast(pages_of.where(F.col("host_pages") * HEAVY >= total).select("host"))
    some = rows.join(heavy, "host", "left_semi").join(F.broadcast(by_host.join(heavy, "host", "left_semi")), "host", "left")
    rest = rows.join(heavy, "host", "left_anti").join(by_host.join(heavy, "host", "left_anti"), "host", "left")
    return some.select(*kept).union(rest.select(*kept))


def enough(host_pages: str = "host_pages") -> Column:
    return F.greatest(F.lit(float(MIN_PAGES)), F.col(host_pages) * MIN_SUPPORT)


def deduce(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, html): pages of each host (host, host_pages), the nested template (host, class, size, order,
    parent, support) of valid classes, its tokens (host, token, text, class), and the judged containers
    (host, area, main, depth, boilerplate).
    """
    distinct = distinct_pages(pages)
    token = distinct.mapInArrow(occurrences, TOKENS).groupBy("host", "token", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "vector_a", "vector_b")])
    token = durable(token)
    pages_of = durable(token.where(F.col("token") == PAGE).select("host", F.col("pages").alias("host_pages")))
    frequent = token.join(pages_of, "host").where((F.col("pages") >= enough()) & (F.col("token") != PAGE))
    frequent = frequent.withColumn("class", F.xxhash64("vector_a", "vector_b"))
    classes = frequent.groupBy("host", "class").agg(F.count("*").alias("size"), F.max(~F.col("text")).alias("tagged")).where((F.col("size") >= MIN_TOKENS) & F.col("tagged"))
    member = durable(frequent.join(classes, ["host", "class"]).select("host", "token", "text", "class", "size"))
    listed = member.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("classes"))
    stats = with_hosts(distinct, listed, pages_of, ["host", "html", "classes"]).mapInArrow(arrangements, STATS)
    sums = [F.sum(c).alias(c) for c in ("pages", "words", "plain", "fixed", "heads", "held")]
    stats = durable(stats.groupBy("host", "kind", "a", "b", "c").agg(*sums, F.max("depth").alias("depth")))
    # of a class the arrangement that most pages have; ties go to the lesser code
    ways = stats.where((F.col("kind") == ARRANGED) & (F.col("b") != 0)).groupBy("host", F.col("a").alias("class"))
    best = ways.agg(F.max_by(F.struct("b", "c", "pages"), F.struct("pages", -F.col("b"), -F.col("c"))).alias("w"))
    valid = best.join(pages_of, "host").where(F.col("w.pages") >= enough())
    sizes = member.groupBy("host", "class").agg(F.first("size").alias("size"))
    template = durable(valid.join(sizes, ["host", "class"]).select("host", "class", "size", F.col("w.b").alias("order"), F.col("w.c").alias("parent"), F.col("w.pages").alias("support")))
    tokens = member.join(template.select("host", "class"), ["host", "class"], "left_semi").select("host", "token", "text", "class")
    area = stats.where(F.col("kind") == CONTAINED).join(template.select("host", F.col("class").alias("b"), F.lit(True).alias("framed")), ["host", "b"], "left")
    mean = F.col("words") / F.col("pages")
    lead = area.groupBy("host").agg(F.max_by(F.struct("a", F.col("plain").alias("most"), (F.col("plain") / F.col("pages")).alias("mean")), F.struct("plain", "a")).alias("m"))
    judged = area.join(lead, "host")
    template_text = F.col("fixed") * 2 > F.col("words")
    menu = F.col("plain") * 2 < F.col("words")
    line = (F.col("heads") == 0) & (mean <= LINE) & (mean * LARGER <= F.col("m.mean"))
    is_main = (F.col("a") == F.col("m.a")) & (F.col("m.most") > 0)
    boilerplate = ~is_main & F.coalesce("framed", F.lit(False)) & (template_text | menu | line)
    return pages_of, template, tokens, judged.select("host", F.col("a").alias("area"), is_main.alias("main"), "depth", boilerplate.alias("boilerplate"))


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """host_pages, and for each host with a template (host, main, whole, areas, texts)."""
    pages_of, template, tokens, judged = deduce(pages)
    areas = judged.groupBy("host").agg(
        F.max(F.when(F.col("main"), F.col("area"))).alias("main"),
        # a main container that is the page itself protects only its own text, not the containers inside
        F.coalesce(F.max(F.when(F.col("main"), F.col("depth") > 2)), F.lit(False)).alias("whole"),
        F.collect_list(F.when(F.col("boilerplate"), F.col("area"))).alias("areas"),
    )
    texts = tokens.where("text").groupBy("host").agg(F.collect_list("token").alias("texts"))
    known = template.select("host").distinct()
    return pages_of, durable(known.join(areas, "host", "left").join(texts, "host", "left"))


OUT = "page_id long, url string, text string, n_chars long"


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, html, host, main, whole, areas, texts, known → the main texts."""
    held: dict[str, Template] = {}
    for batch in batches:
        ids, urls, pages, hosts, main, whole, areas, known_texts, known = batch.columns
        texts = []
        for i in range(batch.num_rows):
            html = pages[i].as_py()
            if not html:
                texts.append("")
                continue
            template = None
            if known[i].as_py():
                host = hosts[i].as_py()
                template = held.get(host)
                if template is None:
                    if len(held) > 2000:
                        held.clear()
                    template = held[host] = Template(main[i].as_py(), bool(whole[i].as_py()), areas[i].as_py() or [], known_texts[i].as_py() or [])
            texts.append(Page(html).main_text(template))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``: main text, its blocks joined by newlines.

    Null or empty html gives empty text; broken or cut pages are read as far as they go; very long pages
    are read whole, one at a time; a null URL belongs to the host ''.  Repeated rows are extracted alike.
    Ties between arrangements or main containers go by code.  Empty table: no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host_column())
    pages_of, by_host = templates(rows.select("host", "html"))
    kept = ["page_id", "url", "html", "host", "main", "whole", "areas", "texts", F.col("known")]
    return with_hosts(rows, by_host.withColumn("known", F.lit(True)), pages_of, kept).mapInArrow(extracted, OUT)
