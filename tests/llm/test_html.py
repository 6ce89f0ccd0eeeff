from __future__ import annotations

import random
import re
import time

import pytest

from tidefold.llm import html

SITE = """<html><head><title>T</title><style>p{{}}</style></head><body><div class="wrap"><header><h2>Site</h2></header><nav><ul><li>Home</li></ul></nav>
<div class="sidebar">side</div><article><h1>{title}</h1><p>{one}</p><div class="ad">buy</div><p>{two}<br>more &amp; more</p><ul><li>a<li>b</ul></article>
<div id="comments"><p>nice</p></div><footer>&copy; me</footer><script>var t = "<p>no</p>";</script></div></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in html.main_text(df).collect()}


def test_article_of_pages_of_one_host(spark):
    rows = [(i, f"https://Host.example/{i}", SITE.format(title=f"Title {i}", one=f"One  {i}\n x", two=f"Two {i}")) for i in range(6)]
    got = run(spark, rows)
    assert got == {i: f"Title {i} One {i} x Two {i} more & more a b" for i in range(6)}
    assert run(spark, rows[:1]) == {0: got[0]}  # names decide alone


def test_template_goes_where_no_container_is(spark):
    page = "<html><body><div>Menu one</div><div>Menu two</div><div>Menu three</div><div>{}</div></body></html>"
    rows = [(i, "http://h.example/x", page.format(f"text {i}")) for i in range(5)]
    assert run(spark, rows) == {i: f"text {i}" for i in range(5)}


def test_copies_of_pages_without_container_keep_their_text(spark):
    page = "<html><body>" + "".join(f"<div>Passage number {i} of the text</div>" for i in range(10)) + "<div>{}</div></body></html>"
    whole = " ".join(f"Passage number {i} of the text" for i in range(10))
    copies = [(i, "http://h.example/x", page.format("end")) for i in range(4)]
    assert run(spark, copies) == {i: f"{whole} end" for i in range(4)}
    near = [(i, "http://h.example/x", page.format(f"end {i}")) for i in range(4)]  # half of the host's pages
    other = [(i, "http://h.example/x", f"<html><body><p>Page {i}</p></body></html>") for i in range(4, 8)]
    assert run(spark, near + other) == {i: f"{whole} end {i}" for i in range(4)} | {i: f"Page {i}" for i in range(4, 8)}
    two = [(i, "http://h.example/x", f"<html><body><div>A common passage</div><p>Text {i} of its own page</p></body></html>") for i in range(2)]
    assert run(spark, two) == {i: f"A common passage Text {i} of its own page" for i in range(2)}


def test_marked_elements_around_the_article_of_one_page(spark):
    body = "The whole text of the article of this page"
    rows = [
        (1, "http://one.example/x", f'<html><body><p>Site</p><div class="layout sidebar-right"><article>{body}</article><div class="sidebar">side</div></div></body></html>'),
        (2, "http://two.example/x", f'<html><body><article>{body}</article><div class="sidebar"><article>Teaser of more</article></div></body></html>'),
    ] + [(i, "http://many.example/x", f'<html><body><form id="banner-{i}"><main>{body} {i}</main></form></body></html>') for i in range(3, 6)]
    assert run(spark, rows) == {1: body, 2: body} | {i: f"{body} {i}" for i in range(3, 6)}


def test_template_decides_inside_containers_and_about_teasers(spark):
    inside = "<html><body><main><p>Read more on our site</p><p>Written by the staff</p><p>Text {} and so on</p></main></body></html>"
    rows = [(i, "http://in.example/x", inside.format(i)) for i in range(4)]
    teaser = "<html><body><article>Teaser {}</article><div>The long body of page {} that no name marks</div><div>All rights kept</div></body></html>"
    rows += [(i, "http://teaser.example/x", teaser.format(i, i)) for i in range(4, 8)]
    assert run(spark, rows) == {i: f"Text {i} and so on" for i in range(4)} | {i: f"Teaser {i} The long body of page {i} that no name marks" for i in range(4, 8)}


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>open <b>bold", "open bold"), ("<article><p>a</p><!-- <p>no</p> --><p>b", "a b"),
    ("<div><p>x &#233; &nbsp; y</p><script>1<2", "x é y"), ("<form><input>q</form><p>z", "z"), ("a < b and c > d", "a < b and c > d"),
])
def test_odd_pages(spark, page, text):
    assert run(spark, [(1, None, page)]) == {1: text}


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"https://{'big' if i % 3 else 'small'}.example/{i}", SITE.format(title=i, one="x", two="y")) for i in range(12)]
    want = run(spark, rows)
    monkeypatch.setattr(html, "MOST_BROADCAST", -1)
    assert run(spark, rows) == want


def test_empty_table(spark):
    assert run(spark, []) == {}


def brute(rows):
    """Template deduction in memory: whole vectors as tuples, classes by equal ones, nests by lookup, slots by sums."""
    pages = [(i, re.sub(r"^https?://([^/]*).*", r"\1", url or "").lower(), h) for i, url, h in rows]
    out = {}
    for host in {h for _, h, _ in pages}:
        once = [html.Page(x) for x in sorted({h for _, o, h in pages if o == host})]
        kinds, parents, counts, places, shares = {}, {}, {}, {}, {}
        for k, page in enumerate(once):
            for token, parent, kind, n, place, share in html.tokens_of(page)[0]:
                kinds[token], parents[token] = max(kind, kinds.get(token, 0)), parent
                counts.setdefault(token, [0] * len(once))[k] = n
                places.setdefault(token, []).append(place)
                shares.setdefault(token, []).append(share)
        mean = lambda of, t: sum(of[t]) / len(of[t])
        classes = {}
        for t, v in counts.items():
            n = sum(x > 0 for x in v)
            if n >= max(html.LEAST_PAGES, len(once) * html.LEAST_SHARE):
                classes.setdefault(tuple(v), []).append(t)
        elements = lambda c: [t for t in c if kinds[t] < html.TEXT]
        valid = [c for c in classes.values() if len(c) >= html.LEAST_TOKENS and len({mean(places, t) for t in elements(c)}) == len(elements(c))]
        of = {t: k for k, c in enumerate(valid) for t in elements(c)}
        template, single, wrappers = set(), set(), set()
        for k, c in enumerate(valid):
            if len({of.get(parents[t]) for t in elements(c)} - {k}) > 1:
                continue
            n = sum(x > 0 for x in counts[c[0]])
            held = sum(mean(shares, t) for t in c if kinds[t] == html.TEXT)
            for t in c:
                if kinds[t] < html.TEXT:
                    template.add(t)
                    single |= {t} if sum(counts[t]) == n and kinds[t] in (html.HOLDER, html.WRAPPER) else set()
                    wrappers |= {t} if kinds[t] == html.WRAPPER else set()
                elif held <= html.MOST_TEXT and n >= html.LEAST_TEXT_PAGES:
                    template.add(t)
        sums, whole = {}, 0
        for page in [html.Page(h) for _, o, h in pages if o == host]:
            for b in page.blocks:
                if b.token in template or not set(b.marks) <= wrappers:
                    continue
                whole += len(b.text)
                at, up = b.path, []
                while at:
                    up.append(at)
                    at = page.elements[at][0]
                for depth, p in enumerate(reversed(up), 1):
                    if p in single:
                        sums[p] = (sums.get(p, (0, 0))[0] + len(b.text), depth)
        best = max(((-n, d, p) for p, (n, d) in sums.items() if n > whole * html.DOMINANT), default=(0, 0, None))[2] if template else None
        out |= {i: html.Page(h).main_text(frozenset(template), frozenset(wrappers), best) for i, o, h in pages if o == host}
    return out


def site(rng, host, n):
    """Pages of one made-up layout whose names say nothing."""
    name = lambda: "".join(rng.choice("qxzjkw") for _ in range(5))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    menu, story, side, foot, wrap = (name() for _ in range(5))
    fixed = [text(3) for _ in range(6)]
    rows, want = [], []
    for i in range(n):
        body = [text(rng.randint(15, 40)) for _ in range(rng.randint(1, 5))]
        title = text(4)
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        rows.append((host * 1000 + i, f"http://h{host}.example/{i}", f'<html><body><div class="{menu}"><span>{fixed[0]}</span><span>{fixed[1]}</span></div><div class="{wrap}"><h1>{title}</h1><div class="{story}">{paragraphs}</div>'
                     f'<div class="{side}"><b>{fixed[2]}</b><i>{text(2)}</i></div></div><div class="{foot}">{fixed[3]}<u>{fixed[4]}</u></div></body></html>'))  # fmt: skip
        want.append(" ".join([title, *body]))
    return rows, want


def test_article_is_found_whatever_names_say_and_equals_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for host, n in ((1, 12), (2, 5), (3, 30)):
        more, texts = site(rng, host, n)
        rows += more
        want |= {r[0]: t for r, t in zip(more, texts, strict=True)}
    rows += [(9000 + i, f"http://h1.example/copy{i}", rows[0][2]) for i in range(4)] + [(9100, "http://h2.example/odd", "<html><body><p>another layout"), (9101, None, None), (9102, "http://alone.example/", rows[3][2])]
    got = run(spark, rows)
    assert {k: got[k] for k in want} == want
    assert all(got[9000 + i] == want[1000] for i in range(4)) and got[9100] == "another layout" and got[9101] == ""
    assert got == brute([(i, u, h or "") for i, u, h in rows])


def test_brute_force_on_named_layouts(spark):
    rng = random.Random(7)
    rows = [(100 * h + i, f"https://s{h}.example/{i}", SITE.format(title=rng.random(), one=rng.choice(["x", "y z", "same words here"]), two=rng.random())) for h, n in ((1, 1), (2, 2), (3, 9), (4, 14)) for i in range(n)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 12])
def test_what_articles_repeat_stays_whatever_their_number(spark, n):
    page = "<html><head></head><body><article><h1>Title {0}</h1><p>{1}</p><p>Share this story</p></article><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/x", page.format(i, f"story number {i} goes on")) for i in range(n)]
    assert run(spark, rows) == {i: f"Title {i} story number {i} goes on Share this story" for i in range(n)}


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a</p><script src=/ads/1/>track(1);</script><p>b</p>", "a b"),
    ("<p>a</p><style media=x/>p { }</style ><p>b</p><textarea/>c</textarea\n/><p>d", "a b d"),
    ("<p>a</p><svg><g><svg x='>'><text>in</text></svg><text>label</text></g></svg><p>b</p>", "a b"),
    ("<p>a</p><svg/><p>b</p><object><object>x</object>y</object><p>c</p>", "a b c"),
    ("<article><p>a</p><div class='gdpr-banner-x'>We use cookies</div><p>b</p></article>", "a b"),
])
def test_raw_elements_end_where_they_end(spark, page, text):
    assert run(spark, [(1, None, page)]) == {1: text}


def story(i):
    lines = [f"Paragraph {k} of story {i} that goes on for some time and says this and that" for k in range(8)]
    return "".join(f"<p>{x}</p>" for x in lines), " ".join(lines)


STORY, PLAIN = story(0)


def test_discussions_by_structure(spark):
    """Hosts of one page and of nine, named in several ways; without <article> nothing tells the menu of a single page."""
    one = "<div class='k'><b class='w'>Reader {0}</b><i>on Monday</i><p>I agree with number {0} and more</p></div>"
    rows, want = [], {}
    for name in ("fb-comments", "commentlist", "discussion", "qzx"):
        for outer, pages in (("article", 1), ("article", 9), ("div", 1), ("div", 9)):
            for i in range(pages):
                key, (html_, plain) = len(rows), story(i)
                said = "".join(one.format(f"{i}{k}") for k in range(2 + i % 3))
                rows.append((key, f"http://{name}.{outer}{pages}/x", f"<html><body><div class='m'>Menu</div><{outer} class='z'><h1>Title {i}</h1>{html_}<div class='{name}'><h3>What readers say</h3>{said}</div></{outer}></body></html>"))
                want[key] = f"{'Menu ' * (outer == 'div' and pages == 1)}Title {i} {plain}"
    assert run(spark, rows) == want


@pytest.mark.parametrize("end", [
    "<ul>" + "<li class='x'><b>Term</b><p>what it means</p></li>" * 3 + "</ul>",  # no class tells who speaks
    "<div class='f'>" + "<div class='q'><h3 class='y'>Question</h3><p>Answer</p><p class='u'>More</p></div>" * 3 + "</div>",
    "<table class='t'>" + "<tr class='r'><td class='a'>1</td><td class='b'>2</td></tr>" * 3 + "</table>",
    "<div class='g'>" + "<figure class='i'><b class='n'>Name</b><i>caption</i></figure>" * 3 + "</div>",
    "<div class='c'>" + "<div class='k'><b class='w'>Who</b><i>when</i><p>what</p></div>" * 3 + "</div><p>The end</p>",  # not at the end
])
def test_what_is_no_discussion_stays(end):
    told = f"{PLAIN} {re.sub('<[^>]*>', ' ', end)}"
    assert html.Page(f"<article>{STORY}{end}</article>").main_text(frozenset()).replace(" ", "") == told.replace(" ", "")


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>story</p></article><article class='comment'><p>nice</p></article>", "story"),
    ("<article><p>story</p><div class='reply'>no</div><div class='reader-responses'>nor this</div></article>", "story"),
    ("<main><article class='teaser'>Card</article><div class='post-body'>Real story</div></main>", "Real story"),
    ("<article><p>a</p><div class='related-work'>b</div><div id='menu-costs'>c</div><p class='form-factor'>d</p><p class='ad-free'>e</p><p>x <math><mi>y</mi></math></p></article>", "a b c d e x y"),
    ("<article>a<div class='ad-box'>no</div><div class='siteSidebar'>no</div><div class='comment-list'>no</div></article>", "a"),
    ("<div class='layout sidebar-right'><article>kept</article></div>", "kept"),
])
def test_names_check_single_pages(spark, page, text):
    assert run(spark, [(1, "http://x.example/", page)]) == {1: text}


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a<" * 300_000 + ">", "<div>" * 200_000, "<!" * 500_000, '<a "' * 250_000, "<b>" * 100_000 + "<hr>" * 100_000, "</div>" * 200_000, "<p><b>" * 100_000, "<a '>x" * 100_001, "<script>" * 100_000])
def test_broken_pages_take_seconds(page):
    began = time.monotonic()
    html.Page(page)
    assert time.monotonic() - began < 10
