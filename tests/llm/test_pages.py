"""Pages, URLs and the benchmark: extraction, reputation and decontamination."""

import math
import random

import pytest
from pyspark.sql import functions as F

from caseweave.llm import decontaminate, html_extract, queries, url_filter
from caseweave.llm.html_extract import Page

SF = "/root/testdata/sf0.001"


def lines(html):
    return [b[0] for b in Page(html).blocks]


def test_article_of_a_plain_page():
    html = """<!doctype html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav>Menu</nav><aside>Side</aside>
    <article><h1>Title &amp; more</h1><p>One <b>two</b>&nbsp;three<p>Four<br>five <script>x()</script><div class="share-bar">Share</div><ul><li>a<li>b</ul>
    <section class="comments"><p>Reader</p></section><form>Mail <input></form></article><footer>&copy;</footer>"""
    assert lines(html) == ["Title & more", "One two three", "Four five", "a", "b"]


def test_quotes_inside_unquoted_values_are_plain():
    assert lines("<body><p><a title=don't>first</a> para</p><p>second isn't</p></body>") == ["first para", "second isn't"]


def test_names_are_evidence_by_their_last_word_and_size():
    story = "<p>" + "a long story " * 20 + "</p>"
    for name in ("story share-post", "search-results-story", "privacy-law-article", "promo", "search results", "widget-area"):
        assert lines(f'<body><div class="{name}">{story}</div><p>end</p></body>')[0].startswith("a long story")
    for name in ("share-bar", "comments", "post-comments", "article-sidebar", "cookie-notice", "main-nav", "adBanner"):
        assert lines(f'<body><div class="x">{story}</div><div class="{name}">out</div></body>') == ["a long story " * 19 + "a long story"]
    assert lines(f'<body><p>short story</p><div class="comments">{story}</div></body>') == ["short story"]


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><span>", "<ul><li>", "<section class=x><p>t ", "<table><tr><td>", "</b><i>", "<article><div>w "])
def test_deep_pages_take_linear_time(part):
    import time

    start = time.time()
    page = Page(part * 60_000 + "end")
    assert page.blocks[-1][0].endswith("end") and time.time() - start < 20


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<article></article>", "<script>x"])
def test_pages_without_text(html):
    assert lines(html) in ([], ["<"])


def test_largest_article_wins_and_comments_are_none():
    html = '<main><article class="comment">long reader comment, longer than the story itself</article><article>The story</article></main>'
    assert lines(html) == ["The story"]


def test_long_main_beats_a_teaser_and_sibling_articles_stay_together():
    story = "a long story told in the main element of the page"
    assert lines(f'<main><p>{story}</p></main><div class="more"><article>teaser</article></div>') == [story]
    assert lines(f'<main><article><p>{story}</p></article><article><p>second part</p></article></main><div class="more"><article>teaser</article></div>') == [story, "second part"]
    assert lines(f'<div class="part1"><article>{story}</article></div><div class="part2"><article>second part</article></div>') == [story, "second part"]
    assert lines(f"<main><p>note</p><article>{story}</article></main>") == [story]


LONG = "a long paragraph of the story " * 11 + "ends"


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="content comments-open"><p>L</p></div>', ["L"]),
        ('<div class="no-comments"><p>L</p></div>', ["L"]),
        ('<article class="comments-open"><p>L</p></article>', ["L"]),
        ('<main><div class="discussion"><p>L</p></div></main>', ["L"]),
        ('<main><h1>T</h1><div class="comments"><p>L</p></div></main>', ["T", "L"]),
        ('<main><p>L</p><section id="related-work"><h2>Related work</h2><p>x</p></section></main>', ["L", "Related work", "x"]),
        ('<main><p>L</p><section id="form-validation"><p>x</p></section><section id="discussion"><p>y</p></section></main>', ["L", "x", "y"]),
        ('<main><p>L</p><div id="responses-to-the-crisis"><p>x</p></div><p class="ad-hoc">y</p></main>', ["L", "x", "y"]),
        ('<main><p>L</p><h2 id="search-algorithms" class="ad">Search</h2><p>x</p></main>', ["L", "Search", "x"]),
        ('<main><section id="intro"><h2>Intro</h2><p>L</p></section><section id="comments"><h2>Comments</h2><p>x</p></section></main>', ["Intro", "L", "Comments", "x"]),
        ("<p>The result is <output>42</output>, a <label>label</label>.</p>", ["The result is 42, a label."]),
        ("<p>one two<script>x</script> three <noscript>n</noscript>four <svg><text>t</text></svg>five <button>b</button>six</p>", ["one two three four five six"]),
        ('<div>one <span class="notice">two</span> three<p>L <i class="share-link">x</i></div>', ["one two three", "L x"]),
    ],
)
def test_names_do_not_remove_articles_and_their_sections(html, want):
    assert lines(f"<body>{html.replace('L', LONG)}</body>") == [x.replace("L", LONG) for x in want]


@pytest.mark.parametrize(
    "part",
    [
        '<section class="comments"><h2>Comments</h2><p>R</p></section>', '<div id="comments"><h2>Comments</h2><p>R</p></div>', '<div class="comments-area">R</div>', '<ol class="comment-list"><li>R</ol>', '<div class="post-comments"><p>R</p></div>',
        '<div class="ad">R</div>', '<div class="ad-slot"><p>R</p></div>', '<div class="widget-area">R</div>', '<div class="related-posts"><h3>More</h3><p>R</p></div>', '<div id="sidebar"><p>R</p></div>', '<p class="cookie-notice">R</p>', '<div class="notice">R</div>', '<div><span class="advert">R</span></div>', '<div class="comments"><article>R R R R R R</article></div>',
    ],
)
def test_parts_that_are_no_article_go(part):
    assert lines(f"<body><main><h1>T</h1><p>{LONG}</p>{part}</main></body>") == ["T", LONG]


def test_a_page_of_very_many_classes_is_nested_in_linear_time():
    import time

    import pyarrow as pa

    marks = [{"pos": 10 * k + j, "token": 10 * k + j, "cls": k, "pages": 5, "root": False} for k in range(1, 4001) for j in range(3)]
    marks += [{"pos": 0, "token": 0, "cls": 0, "pages": 9, "root": True}, {"pos": 90000, "token": 1, "cls": 0, "pages": 9, "root": True}]
    batch = pa.RecordBatch.from_pydict({"host": ["h"], "marks": [marks]})
    start = time.time()
    rows = sum(b.num_rows for b in html_extract._nested([batch]))
    assert rows <= 3 * 4001 and time.time() - start < 2


def site(k, words):
    return f'<html><body><div class="a{k}"><p>Fixed banner text</p><p>Fixed second line</p></div><div class="x"><div class="y"><p>{words} one</p><p>{words} two</p></div></div><div class="z">Fixed end</div></body></html>'


@pytest.mark.parametrize("most_broadcast", [1_000_000, -1])
def test_template_of_a_host_without_article_elements(spark, most_broadcast):
    rows = [(k, "http://h.example/%d" % k, site(k, "story number %d with many words in it %s" % (k, "w%d " % k * 30))) for k in range(8)]
    rows += [(100, "http://other.example/", "<body><p>Single page text</p></body>"), (101, None, None), (102, "http://h.example/x", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1))
    found = html_extract.main_text(pages, most_broadcast=most_broadcast).collect()
    assert len(found) == 12
    by = {r.page_id: r for r in found}
    for k in range(8):
        assert "Fixed" not in by[k].text and by[k].text.count("\n") == 1 and by[k].text.startswith(f"story number {k} ")
        assert by[k].n_chars == len(by[k].text)
    assert by[100].text == "Single page text" and by[101].text == by[102].text == ""
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_repeated_texts_inside_articles_stay_unless_on_every_page(spark):
    rows = [(k, "http://h.example/%d" % k, f"<article><p>Read our terms</p><p>Story {k} {'word ' * (k + 9)}</p>{'<p>Shared line</p>' if k % 2 else ''}</article>") for k in range(10)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("terms" not in t for t in found.values())
    assert all(("Shared line" in t) == (k % 2 == 1) for k, t in found.items())


def test_template_holds_classes_of_some_pages_and_texts_that_stand_twice(spark):
    side = "<p>Side one</p><p>Side two</p><p>Side three</p>"
    rows = []
    for k in range(14):
        story = f"<p>Story {k} {'word ' * (k + 40)}</p>"
        mail = "" if k == 3 else "<p>Get our mail</p>" * (2 if k == 5 else 1)
        rows.append((k, f"http://h.example/{k}", f"<article>{mail}{story}{side if k % 2 else ''}{'<p>Quoted line</p>' if k < 6 else ''}</article>"))
    rows.append((50, "http://h.example/e", "<article><p>Page not found</p></article>"))
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("mail" in t or "Side" in t for t in found.values())
    assert all(f"Story {k} " in found[k] and ("Quoted line" in found[k]) == (k < 6) for k in range(14))
    assert found[50] == "Page not found"


def test_only_classes_in_one_order_and_slot_are_valid(spark):
    """Deduction by brute force: classes by their vectors, valid by order and slot."""
    rows, parts = [], {"side": ["s1", "s2", "s3"], "loose": ["l1", "l2", "l3"], "split": ["p1", "p2", "p3"]}
    rng = random.Random(6)
    for k in range(20):
        story = [f"story {k} {'word ' * (30 + k)}", f"more {k} {'text ' * (30 + k)}"]
        blocks = ["banner", story[0], "middle", story[1], "end"]
        if k % 3 == 0:
            blocks[2:2] = parts["side"]  # always before the middle
        if k % 3 == 1:
            blocks[1:1] = rng.sample(parts["loose"], 3) if k > 1 else parts["loose"]  # in no order
        if k % 4 == 0:
            blocks[2:2] = ["p1", "p2"]
            blocks[-1:-1] = ["p3"]  # around the middle
        rows.append((k, f"http://h.example/{k}", "".join(f"<p>{b}</p>" for b in blocks)))
    found = {r.page_id: r.text.split("\n") for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    pages = {r[0]: r[2][3:-4].split("</p><p>") for r in rows}
    vectors = {}
    for t in {t for p in pages.values() for t in p}:
        vectors.setdefault(tuple(p.count(t) for p in pages.values()), []).append(t)
    fixed = {t for v, c in vectors.items() for t in c if sum(map(bool, v)) > 10}
    whole = {t for v, c in vectors.items() for t in c if all(v)}
    for v, c in vectors.items():
        on = [p for p in pages.values() if c[0] in p]
        orders = {tuple(t for t in p if t in c) for p in on}
        slots = {tuple(sum(u in whole for u in p[: p.index(t)]) for t in c) for p in on}
        if len(c) >= 3 and len(on) >= 5 and len(orders) == 1 and len(slots) == 1 and len(set(next(iter(slots)))) == 1:
            fixed |= set(c)
    assert {"s1", "banner", "end"} <= fixed and not fixed & {"l1", "p1", "p3"}
    for k, p in pages.items():
        assert found[k] == [" ".join(t.split()) for t in p if t not in fixed]


def test_copies_of_one_page_are_no_template(spark):
    rows = [(k, "http://h.example/%d" % k, "<article><p>Same text</p></article>") for k in range(20)]
    found = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in found.collect()} == {"Same text"}


URLS = ["http://www.Example.com/en/x", "https://example.com/en/?q", "https://a.example.com/fr/", "http://x.net/es/a", "http://x.net/es", "http://net/fr/#f", "ftp://x.org/en/", None, "no scheme", "http://", "http://xnet/es/", "HTTP://WWW.EXAMPLE.COM/en/../"]


def ruled(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_rules_by_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS)]
    none = spark.createDataFrame([], "page_id long, bad int")
    for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), none, queries.URL_RULES).collect():
        host, path, rule = ruled(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "allow")


def test_reputation_shrinks_small_hosts_to_their_domain(spark):
    rows, outcomes = [], []
    for host, bad, n in (("bad.one.org", 40, 40), ("new.one.org", 0, 1), ("good.two.org", 0, 40), ("new.two.org", 1, 1), ("un.three.org", 0, 0)):
        for k in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{k}"))
            if k < n:
                outcomes.append((len(rows) - 1, int(k < bad)))
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")
    hosts = pages.join(known, "page_id", "left").select(F.split("url", "/")[2].alias("host"), "bad")
    found = {r.host: r for r in url_filter.reputation(hosts).collect()}
    assert found["bad.one.org"].host_mean > 0.9 > 0.1 > found["good.two.org"].host_mean
    assert found["good.two.org"].host_mean < found["new.two.org"].host_mean < 1
    assert found["new.one.org"].host_mean > found["good.two.org"].host_mean
    assert found["bad.one.org"].host_sd < found["un.three.org"].host_sd
    verdicts = {r.host: r.verdict for r in url_filter.judge(pages, known, []).collect()}
    assert verdicts["bad.one.org"] == "block" and verdicts["good.two.org"] == verdicts["un.three.org"] == "allow"
    assert url_filter.judge(pages.limit(0), known, queries.URL_RULES).count() == 0


def words_of(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if w]


def best_windows(docs, items, size=5, least=0.8):
    from collections import Counter

    found = {}
    for item, text in items:
        own = words_of(text)
        width = min(size, len(own))
        want = Counter(tuple(own[k : k + width]) for k in range(len(own) - width + 1)) if own else Counter()
        for doc, body in docs:
            w = words_of(body)
            for at in range(len(w) - len(own) + 1 if own else 0):
                window = w[at : at + len(own)]
                have = Counter(tuple(window[k : k + width]) for k in range(len(window) - width + 1))
                common = sum((have & want).values())
                s = common / (sum(have.values()) + sum(want.values()) - common)
                if s >= least and (doc, item) not in found or s > found.get((doc, item), (0, 2))[1] + 1e-12 and s >= least:
                    found[doc, item] = (at, s)
    return found


def test_leaks_by_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(8).collect()] + [(900, "two words"), (901, None), (902, ""), (903, "!!")]
    own = [t for _, t in items[:8]]
    swapped = own[2].split()
    swapped[len(swapped) // 2] = "changed"
    docs = [(k, t) for k, t in enumerate([f"before {own[0]} after", own[1].upper().replace(" ", " , "), "x " + " ".join(swapped) + " y", own[3][: len(own[3]) // 2], "nothing here", "", None, "these two words stand", f"{own[4]} {own[4]}", "lorem " * 3000 + own[5]])]
    table = spark.createDataFrame([*docs, docs[0], (None, own[0])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = best_windows(docs, items)
    got = {(r.doc_id, r.item_id): (r.window_start, r.similarity) for r in decontaminate.leaks(table, bench).collect()}
    assert set(got) == set(want)
    for key, (at, s) in want.items():
        assert got[key][0] == at and math.isclose(got[key][1], s, abs_tol=1e-6)
    kept = {r.doc_id for r in decontaminate.clean(table, bench).collect()}
    assert kept == {None, *(d for d, _ in docs)} - {d for d, _ in want}
    assert decontaminate.leaks(table.limit(0), bench).count() == 0
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_leaks_of_texts_with_one_id_and_of_repetitive_items(spark):
    w = [f"word{k}" for k in range(40)]
    chant = " ".join(["la", "la", "la", "di"] * 12)
    items = [(1, " ".join(w)), (1, " ".join(reversed(w))), (2, chant)]
    docs = [(1, "x " + " ".join(w[:20])), (1, " ".join(w[20:]) + " y"), (2, "one " + " ".join(w)), (2, "nothing"), (3, "pre " * 9 + chant + " la"), (4, " ".join(reversed(w))), (5, "la la la di " * 5)]
    want = {}
    for key, (at, s) in ((k, v) for d in docs for i in items for k, v in best_windows([d], [i]).items()):
        if key not in want or s > want[key][1]:
            want[key] = (at, s)
    got = {(r.doc_id, r.item_id): (r.window_start, r.similarity) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=1).collect()}
    assert got == {k: (at, round(s, 6)) for k, (at, s) in want.items()} and set(got) == {(2, 1), (4, 1), (3, 2)}


def test_leaks_with_their_halves_swapped(spark):
    w = [f"word{k}" for k in range(60)]
    thirds = w[40:] + w[20:40] + w[:20]
    items = [(1, " ".join(w)), (2, " ".join(f"other{k}" for k in range(40)))]
    docs = [(1, "at first " + " ".join(w[30:] + w[:30]) + " and last"), (2, " ".join(thirds)), (3, "before " * 100 + " ".join(w[25:] + w[:25])), (4, " ".join(w[30:])), (5, " ".join(f"other{(k + 20) % 40}" for k in range(40)))]
    want = best_windows(docs, items)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.window_start, r.similarity) for r in got} == {k: (at, round(s, 6)) for k, (at, s) in want.items()}
    assert {(1, 1), (3, 1), (5, 2)} <= set(want) and (4, 1) not in set(want)
