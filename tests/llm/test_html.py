"""HTML extraction against brute force, and what the template adds to elements and names."""

import random
from collections import Counter

import pytest

from quillon.llm import html_template

CLEAN = [f"{a}{b}" for a in ("tha", "ore", "sti", "nad", "uli") for b in ("ren", "so", "mik", "tal", "ver", "one")]
SCHEMA = "page_id long, url string, html string"


PAGE = '<html><head><title>x</title></head><body><div class="top"><p>Site name</p><p>Since 1990</p></div><nav><ul><li>Home</li></ul></nav><div class="body"><h1>{0}</h1><p>{1} &amp; more<br>line</p></div><div class="bottom"><p>Imprint here</p></div><footer>F{0}</footer></body></html>'


def test_template_finds_unmarked_boilerplate(spark):
    rows = [(i, f"http://A.example/{i}", PAGE.format(f"Title {i}", f"Text number {i} of the page")) for i in range(12)]
    rows += [(50, "http://lone.example/", PAGE.format("T", "x")), (60, None, None), (61, "no url", ""), (62, "http://a.example/q", "<p>cut off <b>he"), (0, "http://a.example/0", rows[0][2])]
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[3] == "Title 3\nText number 3 of the page & more line"
    assert "Site name" in text[50] and "FT" not in text[50] and "Home" not in text[50]
    assert text[60] == text[61] == "" and text[62] == "cut off he"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_template.extract(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


@pytest.mark.parametrize("html,want", [
    ("<article><h1>T</h1><p>a\n b</p><aside>x</aside></article><p>out</p>", "T\na b"),
    ("<article><p>x<div class='comments'><p>c</p></div></article>", "x"),
    ("<div id='cookie-banner'>c</div><p>t &#8364; &lt;b&gt; &am", "t € <b> &am"),
    ("<script>var a='</p>';</script><style>p{}</style><p>ok</p><!-- <p>no</p> -->", "ok"),
    ("<ul><li>a<li>b</ul><form><input><p>f</p></form>", "a\nb"),
    ("<article class='no-sidebar'><p>keep</p></article>", "keep"),
    ("<p>1 < 2 and <b>3</b></p><p hidden>h</p>", "1 < 2 and 3"),
])
def test_main_text(html, want):
    assert html_template.Page(html).main_text() == want


@pytest.mark.parametrize("html,want", [
    # names that only hold a word for boilerplate are none
    ("<p>a b c</p><div class='related-work'><p>x</p></div><div class='comment-policy'><p>y</p></div>", "a b c\nx\ny"),
    ("<p>a b c</p><div class='related-posts'><p>x</p></div><div id='post-comments-2'><p>y</p></div>", "a b c"),
    # the mark is on a teaser
    ("<article>teaser</article><div><p>one two three four</p></div>", "teaser\none two three four"),
    ("<article>one two three</article><div><p>x</p></div>", "one two three"),
    # a page that is one widget keeps its text
    ("<div class='widget'><p>all there is</p></div>", "all there is"),
    # phrases inside a block do not break it
    ("<p>a <span hidden>x</span> b <span class='ad'>y</span> c</p>", "a b c"),
    # menus without names
    ("<div><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div><div><p>some text <a href=z>link</a></p></div>", "some text link"),
])
def test_names_and_marks_break_ties(html, want):
    assert html_template.Page(html).main_text() == want


def test_copies_do_not_make_an_article_a_template(spark):
    rng = random.Random(21)
    article = lambda: "".join(f"<p>{' '.join(rng.choice(CLEAN) for _ in range(30))}</p>" for _ in range(3))
    page = lambda body, tag, end="": f"<html><body><{tag}>{body}</{tag}><footer>{end}</footer></body></html>"
    twice, once, plain = article(), article(), article()
    rows = [(i, "http://a.com/x", page(twice, "article", f"seen {i}")) for i in (1, 2)] + [(3, "http://a.com/y", page(once, "article"))]
    rows += [(4, "http://b.com/z", page(plain, "div"))] * 3
    rows += [(5, "http://c.com/z", page(twice, "div"))] * 2 + [(6, "http://c.com/z", page(once, "div"))]
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {1: twice, 2: twice, 3: once, 4: plain, 5: twice, 6: once}
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]].replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")


def site(rng, pages, host):
    """Pages without names or semantic elements: menu, varying advert, text, varying imprint."""
    word = lambda: rng.choice("tha ore sti nad uli mik tal ver".split()) + rng.choice("ren so one x yo zu".split())
    line = lambda n: " ".join(word() for _ in range(n))
    menu = "".join(f"<li><a href=/{i}>{line(1)}</a></li>" for i in range(5))
    rows, want = [], {}
    for i in range(pages):
        own = [line(8), *(line(rng.randint(60, 90)) for _ in range(rng.randint(2, 5)))]
        text = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:])
        lead = "<section><p>We use small files to know you.</p></section>" if i % 2 else ""
        rows.append((len(rows) + 1, f"https://{host}/{i}", f"<html><body><div><ul>{menu}</ul></div>{lead}<table><tr><td>{line(7)}</td></tr></table><div>{text}</div><ol><li>{line(6)}</ol></body></html>"))
        want[rows[-1][0]] = "\n".join(own)
    return rows, want


def test_template_alone_finds_the_text(spark):
    rows, want = site(random.Random(2), 16, "Plain.example")
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the notice on every second page is a class of its own, nested in a slot of the page's
    assert sum(got[k] == want[k] for k in want) == len(want)
    alone = {i: html_template.Page(h).main_text() for i, _, h in rows}
    assert not any(alone[k] == want[k] for k in want)


def brute_classes(pages):
    """Valid classes by the definition: sets of tokens with one occurrence vector, ordered and nested."""
    codes = [html_template.Page(h).codes()[1:] for h in pages]
    texts = {b.code() for h in pages for b in html_template.Page(h).blocks}
    counts = [Counter(c) for c in codes]
    vectors = {}
    for t in set().union(*codes):
        v = tuple(c[t] for c in counts)
        if sum(map(bool, v)) >= max(html_template.MIN_PAGES, len(pages) * html_template.MIN_SUPPORT):
            vectors.setdefault(v, set()).add(t)
    classes = [c for c in vectors.values() if len(c) > 1 and c - texts]

    def rounds(page, c):
        own = [(i, t) for i, t in enumerate(page) if t in c]
        m = len({t for _, t in own})
        whole = own and [t for _, t in own] == [t for _, t in own[:m]] * (len(own) // m)
        return [own[k : k + m] for k in range(0, len(own), m)] if whole else None

    def slot(page, r, d):
        """(repeat, gap) of class d that holds the run r; None if a token of d is inside it."""
        lo, hi = r[0][0], r[-1][0]
        for k, other in enumerate(rounds(page, d) or []):
            if any(lo < i < hi for i, _ in other):
                return None if not (lo < other[0][0] and other[-1][0] < hi) else "around"
            if other[0][0] < lo and hi < other[-1][0]:
                return k, sum(i < lo for i, _ in other)
        return "outside"

    good = []
    for c in classes:
        ways = Counter()
        for page in codes:
            runs = rounds(page, c)
            if runs and all(slot(page, r, d) for r in runs for d in classes if len(d) > len(c)):
                ways[tuple(t for _, t in runs[0])] += 1
        if ways and max(ways.values()) >= max(html_template.MIN_PAGES, len(pages) * html_template.MIN_SUPPORT):
            good.append(frozenset(c))
    return good


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(9):
        rows = "".join(f"<tr><td>k{j}</td><td>{rng.random()}</td></tr>" for j in range(rng.randint(1, 4)))
        halves = ["<div class=a><p>Top line</p></div>", "<div class=b><p>Second line</p></div>"]
        if i in (2, 5):
            halves.reverse()
        extra = "<div class=c><p>Now and then</p></div>" if i % 3 else ""
        pages.append(f"<html><body>{''.join(halves)}{extra}<table>{rows}</table><p>{rng.random()}</p></body></html>")
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    pages_of, template, tokens, _ = html_template.deduce(df)
    got = {}
    for r in tokens.collect():
        got.setdefault(r["class"], set()).add(r["token"])
    assert pages_of.first()["host_pages"] == 9
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute_classes(pages)))
    rows = {r["class"]: r for r in template.collect()}
    # pages with the other order do not support the class; the optional container is nested
    assert sorted(r["support"] for r in rows.values()) == [6, 7]
    assert any(r["parent"] != 0 for r in rows.values())


def test_order_and_nesting():
    way = html_template.arrangement
    assert way([1, 2, 3, 1, 2], {1: 7, 2: 7})[7][0] == way([1, 2], {1: 7, 2: 7})[7][0] != 0
    assert way([1, 2], {1: 7, 2: 7})[7][0] != way([2, 1], {1: 7, 2: 7})[7][0]
    assert way([1, 2, 2, 1], {1: 7, 2: 7})[7] == (0, 0)
    inner = way([1, 5, 6, 5, 6, 2], {1: 7, 2: 7, 5: 8, 6: 8})
    assert inner[8][1] == html_template.code("7/1") and inner[7][1] == 0
    crossed = way([1, 5, 2, 6], {1: 7, 2: 7, 5: 8, 6: 8})
    assert sorted(x == (0, 0) for x in crossed.values()) == [False, True]


def test_all_joins_give_the_same(spark, monkeypatch):
    rows, _ = site(random.Random(3), 8, "a.example")
    rows += [(100 + i, u.replace("a.example", "b.example"), h) for i, u, h in site(random.Random(4), 6, "b.example")[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, html_template.extract(df).collect()))
    monkeypatch.setattr(html_template, "SENT_BYTES", 0)
    monkeypatch.setattr(html_template, "SENT_COPIES", 0)
    for heavy in (1, 2, 1024):
        monkeypatch.setattr(html_template, "HEAVY", heavy)
        assert sorted(map(tuple, html_template.extract(df).collect())) == want


def test_long_repeated_and_odd_rows(spark):
    long = "<p>" + "word &amp; more " * 200_000 + "</p>" + "<div>" * 3000 + "deep"
    rows = [(1, "http://h/", long), (1, "http://h/", long), (None, None, "<p>x</p>"), (2, "http://h/", None), (3, "", "")]
    df = spark.createDataFrame([(*r, "z", "z", 1) for r in rows], SCHEMA + ", host string, text string, token int")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_template.extract(df).collect())
    n = len(" ".join(["word & more"] * 200_000)) + 5
    assert got == [("1", n), ("1", n), ("2", 0), ("3", 0), ("None", 1)]
