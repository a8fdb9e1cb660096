import itertools
import random

import pytest

from strataline.llm import wrappers as W

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def article(rng, k):
    blocks = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 30))) + f" n{k}." for _ in range(rng.randint(1, 6))]
    return f"Title {k} &amp; more", blocks


def styled(kind, k, title, blocks, rng):
    body = "".join(f"<p>{b[:5]}<b>{b[5:9]}</b>{b[9:]}</p>\n" for b in blocks)
    if kind == "article":
        return f'<html><head><title>{title}</title><script>x="</p>";</script></head><body><nav><ul><li><a href="/{k}">menu {k}</a></li></ul></nav><div class="ad">buy {k}</div><article><h1>{title}</h1>{body}<section class="comments"><p>great {k}</p></section></article><footer>foot {k}</footer></body></html>'
    if kind == "div":
        aside = f'<aside>side {k}</aside>' if rng.random() < 0.5 else ""
        return f'<body><header>site {k}</header><div class="cookie-notice">ok? {k}</div>{aside}<div class="post-body content"><h1>{title}</h1>{body}<form><p>mail {k}</p></form></div><div id="comments"><p>hi {k}</p></div></body>'
    return f"<body><div class=menu>m {k}</div><table><tr><td><h1>{title}</h1>{body}</td></tr></table><p>All rights kept</p><div class='footer'>f {k}</div></body>"


@pytest.mark.parametrize("fan", [32, 2])
def test_main_text(spark, monkeypatch, fan):
    monkeypatch.setattr(W, "FAN_IN", fan)
    rng = random.Random(4)
    rows, expect = [], {}
    for k in range(90):
        kind = ["article", "div", "table"][k % 3]
        title, blocks = article(rng, k)
        rows.append((k, f"http://{kind}.example.org/p{k}", styled(kind, k, title, blocks, rng), "x"))
        expect[k] = " ".join([title.replace("&amp;", "&"), *blocks])
    rows += [(100, "http://article.example.org/x", None, "x"), (101, "http://article.example.org/y", "", "x"), (102, None, "<p>lone <i>te</i>xt", "x"), (103, "http://one.example.org/", "<article><p>a<p>b&nbsp;&eacute;<br>c</article>" * 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string").repartition(5)
    got = {r.page_id: (r.text, r.n_chars) for r in W.extract_main(df).collect()}
    assert got.pop(100) == ("", 0) and got.pop(101) == ("", 0)
    assert got.pop(102)[0] == "lone text" and got.pop(103)[0] == "a b é c"
    assert {k: v[0] for k, v in got.items()} == expect
    assert all(v[1] == len(v[0]) for v in got.values())


def test_expression_and_empty(spark):
    a = W.wrapper_of(W.nested("<ul><li>a</li><li>b</li></ul><p>x</p>"))
    b = W.wrapper_of(W.nested("<ul><li>c</li></ul><hr><p>x</p>"))
    assert "".join(x.expression() for x in W.align(a, b)) == "<ul>(<li>#PCDATA</li>)+</ul>(<hr></hr>)?<p>x</p>"
    assert W.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layouts_mixed_on_one_host(spark):
    rng = random.Random(9)
    rows, expect = [], {}
    for k in range(60):
        title, blocks = article(rng, k)
        body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
        kind = (["article"] * 6 + ["main", "content", "post", "table"])[k % 10]
        page = {"article": f"<article>{body}</article>", "main": f"<main>{body}</main>", "content": f'<div class="content">{body}</div>', "post": f'<div class="post">{body}</div>', "table": f"<table><tr><td>{body}</td></tr></table>"}[kind]
        url = "http://mixed.example.org/" if k < 30 else None
        rows.append((k, url, f"<body><nav><p>menu {k}</p></nav>{page}<footer>foot {k}</footer></body>"))
        expect[k] = " ".join([title.replace("&amp;", "&"), *blocks])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in W.extract_main(pages).collect()} == expect


def test_texts_with_a_common_opening_or_equal_on_all_pages(spark):
    opening = "the same words again " * 15
    a, b = (W.wrapper_of(W.nested(f"<p>{opening}{x}</p><p>x<!-- -->{x}</p>")) for x in ("one", "two"))
    assert "".join(x.expression() for x in W.align(a, b)) == "(<p>#PCDATA</p>)+"
    a, b = (W.wrapper_of(W.nested(f"<h1>{opening}{x}</h1><h2>x<!-- -->{x}</h2><h3>{opening}</h3>")) for x in ("one", "two"))
    assert [x.below[0].text is None for x in W.align(a, b)] == [True, True, False]
    page = '<body><div class="content"><h1>News</h1><p>{}</p></div><div class="footer">foot</div></body>'
    bodies = {f"open{k}": opening + f"end {k}" for k in range(4)} | {f"same{k}": "mirrored text" for k in range(4)}
    rows = [(k, f"http://{name[:4]}.example.org/{k}", page.format(body), body) for k, (name, body) in enumerate(bodies.items())]
    got = W.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, body string").repartition(3))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"News {body}" for k, _, _, body in rows}


def soup(title, body, side):
    return f'<body><div class="x1"><div class="q"><p>{side}</p><p>{side}</p></div><div class="r"><h1>{title}</h1><p>{body}</p></div></div><div class="z">Made by us</div></body>'


def test_the_host_tells_what_the_page_alone_does_not(spark):
    """A long text that all pages of a host share is no main text, though it is the most on each page."""
    side = "the same long text beside every page of this host " * 8
    rows = [(k, f"http://soup.example.org/{k}", soup(f"Title {k}", f"own text of page {k}", side)) for k in range(6)]
    got = {r.page_id: r.text for r in W.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"Title {k} own text of page {k}" for k in range(6)}
    alone = W.wrapper_of(W.nested(rows[0][2]))
    assert "own text" not in W.read_main(W.nested(rows[0][2]), alone, W.mark_main(alone))


def test_class_words_need_evidence(spark):
    """Inside an article, words such as share or tags drop an item only if it is fixed, optional or links."""
    page = (
        '<article><h1>T {k}</h1><figure><img src="a"><figcaption>caption {k}</figcaption></figure><p class="tags">prose {k} here</p><p class="share-price">price {k}</p>'
        '<div class="side-effects">effects {k}</div><div class="share">Share this</div><div class="tags"><a href="/a">one {k}</a> <a href="/b">two</a></div>{note}<div class="comment-list"><p>hi {k}</p></div><div class="ad">buy {k}</div></article>'
    )
    rows = [(k, "http://a.example.org/", page.format(k=k, note='<div class="notice">late {k}</div>' if k % 2 else "")) for k in range(6)]
    got = {r.page_id: r.text for r in W.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {k: f"T {k} caption {k} prose {k} here price {k} effects {k}" for k in range(6)}


def test_deep_wide_long_and_repeated_pages(spark, monkeypatch):
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    wide = [f"<article>{''.join(f'<p>a{i}</p><table><tr><td>{i}</td></tr></table>' for i in range(n))}</article>" for n in (3000, 2900)]
    long_ = f"<article><p>{'word ' * 400_000}</p></article>"
    rows = [(1, "http://d.example.org/", deep), (2, "http://w.example.org/", wide[0]), (3, "http://w.example.org/", wide[1]), (4, "http://l.example.org/", long_), (4, "http://l.example.org/", long_), (5, None, deep)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    texts = {}
    for most in (W.WRAPPER_BYTES, -1):  # by broadcast and by the salted join
        monkeypatch.setattr(W, "WRAPPER_BYTES", most)
        texts[most] = sorted((r.page_id, r.text) for r in W.extract_main(pages).collect())
        assert len(texts[most]) == 6
    assert len(set(map(str, texts.values()))) == 1
    got = dict(texts[-1])
    assert got[1] == got[5] == "deep text" and got[4] == ("word " * 400_000).strip()
    assert got[2] == " ".join(f"a{i} {i}" for i in range(3000)) and got[3] == " ".join(f"a{i} {i}" for i in range(2900))


def test_alignment_keeps_a_longest_common_sequence():
    """Against all common sequences of small streams."""
    rng = random.Random(6)
    for _ in range(200):
        a, b = (["".join(rng.choice("pqrs")) for _ in range(rng.randint(0, 6))] for _ in "ab")
        a, b = ([k for i, k in enumerate(x) if i == 0 or x[i - 1] != k] for x in (a, b))
        common = max((c for n in range(len(a) + 1) for c in itertools.combinations(range(len(a)), n) if is_part([a[i] for i in c], b)), key=len)
        level = [W.Node(k) for k in a]
        out = W.align(level, [W.Node(k) for k in b])
        both = [x for x in out if x.seen == 2]
        assert len(both) <= len(common) and sum(not x.optional for x in out) <= len(common)
        assert len(common) == len(both) or any(x.repeated for x in out)
        for keys in (a, b):  # the level matches both streams
            assert is_part(keys, [k for x in out for k in ([x.key] * 3 if x.repeated else [x.key])])


def is_part(small, large):
    it = iter(large)
    return all(k in it for k in small)


def texts_of(pages, host=None):
    """The main text of each page of one host, read as the tasks read it."""
    wrapper = None
    for page in pages:
        level = W.wrapper_of(W.nested(page))
        wrapper = level if wrapper is None else W.align(wrapper, level)
    reader = W._Reader(W.json.dumps([len(pages), [x.pack() for x in wrapper]]))
    return [reader.read(page) for page in pages]


def test_long_sequences_are_aligned_as_one(monkeypatch):
    rng = random.Random(12)
    for cells in (1, 30, W.CELLS):
        monkeypatch.setattr(W, "CELLS", cells)
        for _ in range(60):
            a, b = ([rng.choice("pqrs") for _ in range(rng.randrange(14))] for _ in range(2))
            pairs = list(W._common(a, b))
            assert [x for x, _ in pairs if x is not None] == list(range(len(a))) and [y for _, y in pairs if y is not None] == list(range(len(b)))
            assert all(a[x] == b[y] for x, y in pairs if x is not None and y is not None)
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, j in itertools.product(range(len(a)), range(len(b))):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            assert sum(x is not None and y is not None for x, y in pairs) == best[-1][-1]


@pytest.mark.parametrize("pairs", [50, 499, 2_000])
def test_an_insertion_at_the_front_of_a_long_level(pairs):
    body = lambda k: "".join(f"<p>text {k} {i}</p><hr>" for i in range(pairs))
    side = '<div class="side">own side text</div>'
    more = "".join(f"<h2>more {i}</h2><ol></ol>" for i in range(300))
    one, two = texts_of([f"<article>{body(1)}{side}</article>", f"<article>{more}{body(2)}{side}</article>"])
    want = lambda k: " ".join(f"text {k} {i}" for i in range(pairs))
    # it is the same on both pages, and named so
    assert one == want(1) and two == " ".join(f"more {i}" for i in range(300)) + " " + want(2)
    own = [x.replace("own side", f"own side {k}") for k, x in enumerate([f"<article>{body(1)}{side}</article>", f"<article>{more}{body(2)}{side}</article>"])]
    assert [x.endswith(f"own side {k} text") for k, x in enumerate(texts_of(own))] == [True, True]


@pytest.mark.parametrize("depth", [20, 230, 3_000])
def test_furniture_below_any_depth(depth):
    inside = lambda k: "<div>" * depth + f'<p>text {k}</p><nav><ul><li>menu</li><li>items {k}</li></ul></nav><div class="ad-slot">buy <b>{k}</b></div><p>more {k}</p>' + "</div>" * depth
    pages = [f"<body><article><h1>T {k}</h1>{inside(k)}<p>end {k}</p></article><footer>x</footer></body>" for k in range(3)]
    assert texts_of(pages) == [f"T {k} text {k} more {k} end {k}" for k in range(3)]


def test_layouts_far_ahead():
    """An item that holds what no nearer item of its class holds, behind twelve others."""
    front = "".join(f'<div class="box"><h{i % 3 + 3}>h {i}</h{i % 3 + 3}></div><p class="k{chr(97 + i)}">between {i}</p>' for i in range(12))
    last = lambda k: f'<div class="box"><table><tr><td>{k} found</td></tr></table></div>'
    pages = [f"<article>{front}{last(1)}</article>", f"<article>{front}{last(2)}</article>", f"<article>{last(3)}</article>"]
    assert [x.endswith(f"{k} found") for k, x in enumerate(texts_of(pages), 1)] == [True] * 3


def test_class_words_inside_an_article():
    kept = "promo-code nav-theory reply ad-hoc comment".split()
    gone = "ad ad-banner promo cookie-notice newsletter-signup comments sidebar-ad nav".split()
    page = lambda k: "<article><h1>T</h1>" + "".join(f'<p class="{c}">{c} {k}</p><hr>' for c in kept + gone) + f"<p>end {k}</p></article>"
    assert texts_of([page(k) for k in range(3)]) == ["T " + " ".join(f"{c} {k}" for c in kept) + f" end {k}" for k in range(3)]
    replies = lambda k: f'<article><p>text {k}</p><div class="reply">one {k}</div><div class="reply">two {k}</div></article>'
    assert texts_of([replies(k) for k in range(3)]) == [f"text {k}" for k in range(3)]


def test_teasers_and_headers_of_articles():
    page = lambda k: f'<body><article class="teaser"><p>read also {k}</p></article><article><header><h1>Title {k}</h1><p>site {k}</p></header><p>text {k} of some length</p></article><article class="teaser"><p>and {k}</p></article></body>'
    assert texts_of([page(k) for k in range(4)]) == [f"Title {k} text {k} of some length" for k in range(4)]
    parts = lambda k: f"<body><article><p>part one {k}</p></article><hr><article><p>part two {k}</p></article></body>"
    assert texts_of([parts(k) for k in range(4)]) == [f"part one {k} part two {k}" for k in range(4)]


def made_host(seed):
    """Pages of one host without an article element, and their main texts, which are known as they are made."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    shells = {
        "front": ["<div><a href=/a>Home</a> <a href=/b>About</a></div>", "<div><ul><li><a href=/x>One</a><li><a href=/y>Two</a></ul></div>", f"<div>{say(6)}</div>"],
        "back": [f"<div><p>{say(9)}</p></div>", "<div><a href=/t>Terms</a> <a href=/i>Imprint</a></div>", f"<div><small>{say(4)}</small></div>"],
    }
    front, back = (rng.sample(shells[k], rng.randint(1, 3)) for k in ("front", "back"))
    back.insert(rng.randint(0, len(back)), f"<blockquote><p>{say(600)}</p></blockquote>")  # more than a page says itself
    tag = rng.choice(["section", "div", "td"])
    pages, wanted = [], []
    for k in range(rng.randint(3, 7)):
        blocks = [say(rng.randint(8, 40)) for _ in range(rng.randint(2, 9))]
        title = say(4)
        body = f"<h1>{title}</h1>" + "".join(f"<p>{b[:9]}<i>{b[9:14]}</i>{b[14:]}</p>\n" for b in blocks)
        pages.append(f"<html><head><title>{title} - site</title></head><body>{''.join(front)}<{tag}>{body}</{tag}>{''.join(back)}</body></html>")
        wanted.append(" ".join([title, *blocks]))
    return pages, wanted


@pytest.mark.parametrize("seed", range(25))
def test_hosts_whose_texts_are_known(seed):
    """No element or class names the main text: what the pages of the host share is not it."""
    pages, wanted = made_host(seed)
    assert texts_of(pages) == wanted
    assert [texts_of([p])[0] for p in pages] != wanted  # one page alone does not tell
