"""Main text of pages, and URL rules."""

import random
import re
import time

from tidemark.llm import html_template, url_rules

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title {n}</h1><p>First <b>bold</b>&amp; more<br>text {n}.<p>Second&nbsp;paragraph, {body}</p><form><p>Sign up</p></form><div class="ad slot">Buy</div>
<ul><li>One</li><li>Two</li></ul><table><tr><td>cell<td>next</table></article><section id="comments"><p>A reader says</p></section></main>
<aside>Side</aside><div role="banner">B</div><footer>&copy; foot</footer></body></html>"""


def lines(n, body):
    return f"Title {n}\nFirst bold& more text {n}.\nSecond paragraph, {body}\nOne\nTwo\ncell\nnext"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_without_what_surrounds_it(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(n=i, body=f"body {i} " * (i + 1))) for i in range(6)]
    rows += [(10, "http://single.example.com/", PAGE.format(n=10, body="x")), (11, None, PAGE.format(n=11, body="y"))]
    got = {r.page_id: r for r in html_template.main_texts(frame(spark, rows)).collect()}
    for i, _, _ in rows:
        body = f"body {i} " * (i + 1) if i < 6 else "x" if i == 10 else "y"
        assert got[i].text == lines(i, body.strip()), i
        assert got[i].n_chars == len(got[i].text)


def test_template_finds_an_unnamed_main_slot_and_drops_constant_slots(spark):
    prose = [" ".join(f"word{i}x{k}" for k in range(40 + 3 * i)) for i in range(8)]
    page = "<html><body><div id=c1><span>Always the same words here</span></div><div id=c2><div><p>{a}</p><p>{b}</p></div><span class=z>Tell a friend</span></div><div id=c3><a href=x>{c}</a></div></body></html>"
    rows = [(i, "https://plain.example.org/x", page.format(a=p, b=p[::-1], c=f"link {i}")) for i, p in enumerate(prose)]
    got = {r.page_id: r.text for r in html_template.main_texts(frame(spark, rows)).collect()}
    assert all(got[i] == f"{p}\n{p[::-1]}" for i, p in enumerate(prose))


def test_nothing_beside_the_largest_slot_is_lost(spark):
    words = lambda name, i, n: " ".join(f"{name}{i}x{k}" for k in range(n + i % 3))
    nested = "<html><body><div id=c1><span>Always the same</span></div><div class=content><div class=intro><p>{a}</p></div><div class=text><p>{b}</p></div></div><ul><li><a href=x>{c}</a></li></ul></body></html>"
    split = "<html><body><article class=first><p>{b}</p></article><div><article class=second><p>{a}</p></article></div><ul><li><a href=x>{c}</a></li></ul></body></html>"
    rows, want = [], {}
    for i in range(8):
        a, b, c = words("a", i, 6), words("b", i, 40), f"link {i}"
        for k, (page, text) in enumerate(((nested, f"{a}\n{b}"), (split, f"{b}\n{a}"))):
            for host in (f"h{k}.example.org", f"alone{i}x{k}.example.org"):  # by the template, and by the page alone
                want[len(rows)] = text
                rows.append((len(rows), f"https://{host}/{i}", page.format(a=a, b=b, c=c)))
    got = {r.page_id: r.text for r in html_template.main_texts(frame(spark, rows)).collect()}
    for i, text in want.items():
        alone = rows[i][1].startswith("https://alone") and "class=content" in rows[i][2]  # a page alone does not show what is constant
        assert set(text.split("\n")) <= set(got[i].split("\n")) if alone else got[i] == text, rows[i]


def test_equal_vectors_form_classes():
    def token(n, parent, place, times, vector, **more):
        return {"token": n, "parent": parent, "depth": 0 if n == 0 else 1 if parent == 0 else 2 if parent in (1, 3) else 3, "tag": "div", "pages": 5, "times": times, "vector": vector, "place": place,
                "mass": 0, "link": 0, "same": False} | more

    found = html_template.deduce([token(0, 0, -1, 5, 1), token(1, 0, 0, 5, 1, mass=9), token(2, 1, 1, 5, 1, mass=8), token(3, 1, 2, 12, 7), token(4, 3, 3, 12, 7), token(5, 1, 4, 6, 9)], 5)
    classes = dict(found.order)
    assert classes[1] == classes[2] and classes[3] == classes[4] != classes[1] and 5 not in classes
    assert found.main[0] == 2 and html_template.Template.unpacked(found.packed()) == found
    assert html_template._valid(found, {1: 5, 2: 2, 3: 0, 4: 1}) == {3, 4}  # a class out of order is not used


def test_classes_are_those_of_gathered_occurrence_vectors(spark):
    rng = random.Random(4)

    def markup(depth):
        return "".join(f"<{t} class=k{rng.randint(0, 2)}>{rng.choice(['', 'word ' * rng.randint(1, 9)])}{markup(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "p"], k=rng.randint(0, 3)))

    pages = [f"<body><div id=top>same</div>{markup(3)}<div id=low>{markup(2)}</div></body>" for _ in range(12)]
    rows = spark.createDataFrame([("h", i, x) for i, x in enumerate(pages)], "_host string, _page long, _html string")
    found = html_template.Template.unpacked(html_template.templates(rows).first()["_template"])
    vectors = {}  # every token's times on each page, gathered
    for i, x in enumerate(pages):
        for token in (page := html_template.parse(x)).token[1:]:
            vectors.setdefault(token, [0] * len(pages))[i] += 1
    vectors = {t: tuple(v) for t, v in vectors.items() if sum(c > 0 for c in v) >= len(pages) / 2}
    groups = {}
    for t, v in vectors.items():
        groups.setdefault(v, set()).add(t)
    want = {frozenset(g) for v, g in groups.items() if len(g) > 1 or set(v) <= {0, 1} or v == groups.get("page")}
    got = {}
    for t, i in found.order:
        got.setdefault(i, set()).add(t)
    # the page itself is in the class of what stands once on every page
    assert {frozenset(g) for g in got.values()} == want


def test_names_are_evidence_and_no_verdict(spark):
    openings = ['<div class="overflow-hidden">', '<div id="page" class="has-sidebar">', '<div class="reader-content">', '<div class="site nav-closed">', '<form id="aspnetForm">', '<div class="widget">', '<div class="share wrapper">']
    body = '<nav><a href=/>Menu</a></nav>{open}<h1>Title {n}</h1><section class="social-history"><p>Some history of {n}, told at length.</p></section><p class="search-result">A result {n}.</p><div class="share-buttons"><p>Send</p></div></div></form><div class="comment-list"><p>{c}</p></div><div class="sidebar-left"><p>Latest of all</p></div>'
    rows, want = [], {}
    for k, opening in enumerate(openings):
        for n in range(7):
            host = f"many{k}.example.com" if n else f"one{k}.example.com"
            want[len(rows)] = f"Title {n}\nSome history of {n}, told at length.\nA result {n}."
            rows.append((len(rows), f"http://{host}/{n}", f"<html><body>{body.format(open=opening, n=n, c=f'I, reader {n}, say this. ' * 9)}</body></html>"))
    for r in html_template.main_texts(frame(spark, rows)).collect():
        assert r.text == want[r.page_id], rows[r.page_id]
    heads = {"comment-list": "comments"[:7], "sidebar-left": "sidebar", "relatedPosts": "related", "skip-link": "skip", "site-footer": "footer", "search-result": None, "social-history": None, "nav-closed": None,
             "has-sidebar": None, "overflow-hidden": None, "reader-content": None, "header": None, "": None}
    assert {n: html_template.marks(n) for n in heads} == heads


def test_deep_markup_takes_linear_time():
    for opening in ("<b>", "<div class=x>", "<li>", "<article>"):
        begun = time.time()
        page = html_template.parse(opening * 100_000 + "deep text")
        tokens = html_template.tokens_of(page)
        assert html_template.extract(opening * 100_000 + "deep text", None) == "deep text" and len(tokens) <= 100_001
        assert sum(len(repr(t)) for t in tokens) < 300 * 100_001 and time.time() - begun < 60


def test_page_edges(spark):
    rows = [(1, "http://e.example.com", None), (2, "http://e.example.com", ""), (3, "x", "no markup at all & a < b"), (4, "http://e.example.com", "<p>" * 3000 + "deep" + "<i a='b>" * 50), (5, None, "</div></p><li>x"),
            (5, None, "</div></p><li>x"), (None, None, "<script>only"), (7, "http://L.example.com", "<p>" + "long text " * 60_000)]
    docs = frame(spark, rows).selectExpr("*", "'z' as _html", "'y' as name", "1 as text")
    got = html_template.main_texts(docs).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and (by[1], by[2], by[3], by[5], by[None]) == ("", "", "no markup at all & a < b", "x", "")
    assert by[4].startswith("deep") and len(by[7]) == 60_000 * 10 - 1
    assert html_template.main_texts(frame(spark, [])).count() == 0


def by_all_rules(url, rules):
    """Every rule tried on every URL."""
    host, path = url_rules.parts_of(url)
    lower = (host + path).translate(url_rules._TO_LOWER)
    fit = [r for r in rules if re.match(r.pattern, host + path if r.name else lower)]
    named = [r for r in fit if r.name]
    best = max(named or fit, key=lambda r: (len(r.name or r.pattern), r.action == "allow", r.pattern), default=None)
    return (host, path, best.name if best else None, best.action if best else "allow")


def test_index_gives_what_all_rules_give(spark):
    urls = ["http://a.org/", "http://a.org", "https://X.Example.ORG/es/1?q#f", "https://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://b.com/fr/x", "http://b.com/de/", "http://b.com/FR/",
            "ftp://free-bets.example.net/", "http://x.net/casino/1", "http://betsy.net/", "http://m.net/track?x", "http://adserver", "no scheme/org/", "", None, "http://a.org:80/", "http://u@c.com/de/?ads", "http://ÀÉ.com/de/ü", "://org/", "http://a.net//ads//"]
    rows = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(0, urls[0], "v"), (None, urls[7], "v")], "page_id long, url string, host string")
    got = url_rules.judge_urls(rows).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[r.page_id if r.page_id is not None else 7]
        assert (r.host, r.path, r.rule, r.verdict) == by_all_rules(u, url_rules.RULES), u
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdict[0] == ("org/", "allow") and verdict[1] == (None, "allow") and verdict[2] == ("example.org/es/", "block") and verdict[3] == ("example.org/en/1", "block") and verdict[4] == ("org/", "allow")
    assert verdict[9] == (None, "block") and verdict[10] == (None, "block") and verdict[11] == (None, "allow") and verdict[14] == (None, "allow")
    assert url_rules.judge_urls(rows.limit(0)).count() == 0


def test_rarest_literal_indexes_a_rule():
    rules = (url_rules.pattern_rule("block", "^common^rare^"), url_rules.prefix_rule("allow", "org", "/x1"), url_rules.pattern_rule("block", "*part*"))
    index = url_rules.RuleIndex(rules, {"common": 90, "rare": 2, "org": 5})
    assert dict(index.by_token) == {"rare": [0], "org": [1]} and index.always == [2]
    assert index.judge("a.net", "/common-rare/") == (None, "block") and index.judge("b.org", "/x12") == ("org/x1", "allow") and index.judge("zpartz.net", "/") == (None, "block")
