import random

from chatsift.llm import html_diff

SCHEMA = "page_id long, url string, html string, lines string, host int"


def lcs_size(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_common_lines_equal_the_textbook_length():
    rng = random.Random(6)
    for _ in range(800):
        a, b = ([rng.randrange(rng.choice([2, 6])) for _ in range(rng.randrange(14))] for _ in range(2))
        at = html_diff.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == lcs_size(a, b)
        left = iter(b)
        assert all(any(x == y for y in left) for x in (a[i] for i in at))  # a subsequence of b


def test_long_pages_are_aligned_by_halves_as_well(monkeypatch):
    rng = random.Random(16)
    for limit in (1, 20, 200):
        monkeypatch.setattr(html_diff, "MAX_BITS", limit)
        for _ in range(150):
            a, b = ([rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randrange(40))] for _ in range(2))
            at = html_diff.common_lines(a, b)
            assert at == sorted(set(at)) and len(at) == lcs_size(a, b)
            left = iter(b)
            assert all(any(x == y for y in left) for x in (a[i] for i in at))


def test_pages_without_any_telling_markup(spark):
    """No article element, class or role: what the pages of a host share goes, what is their own stays."""
    rows, own = [], {}
    for i in range(30):
        host = i % 3
        own[i] = [f"headline {i}", *(f"paragraph {i} {k} of its own" for k in range(4))]
        frame = [f"menu of host {host}", "home", "about us", *own[i], f"all rights reserved {host}"]
        rows.append((i, f"http://h{host}.example/a/{i:02d}", "".join(f"<div>{x}</div>" for x in frame), "x", 1))
    got = run(spark, rows)
    assert {i: t.split("\n") for i, t in got.items()} == own


def run(spark, rows):
    return {r.page_id: r.text for r in html_diff.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(body, lang="en"):
    return f"<!DOCTYPE html><html lang={lang}><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_markup_roles_and_references(spark):
    body = ("<nav><ul><li><a href=/x>Menu</a></ul></nav><div class='ad'>Buy</div><!-- note --><header>Site</header>"
            "<article><h1>Head &amp; tail</h1><p><b>One\n  two.<br><p>Caf&eacute; &lt;3&#33;<p>a <i>b</i>c</p>"
            "<form><input><button>Send</button></form><aside>Side</aside><div id=comments><p>Nice</p></div>"
            "<pre>x\n y</pre>2 < 3</article><div class=\"cookie-notice x\">OK</div><footer>&copy; me</footer>")
    got = run(spark, [(1, "http://h/a", page(body), "x", 1)])
    assert got[1] == "Head & tail\nOne two.\nCafé <3!\na bc\nx y\n2 < 3"


def test_class_names(spark):
    body = ("<div class='site-header'>Site</div><div class='content has-sidebar'><article class='post'><div class='article-header'>"
            "<h1>Title</h1></div><p>Words.</p><div class='share-box'>Share</div></article><article class='comment'>Nice</article>"
            "</div><div id='left-sidebar'>Side</div>")
    assert run(spark, [(1, "http://h/a", page(body), "x", 1)])[1] == "Title\nWords."


def test_unmarked_template_lines_are_deleted_by_differencing(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        own = "".join(f"<p>text {i} {k} {rng.random()}</p>" for k in range(3))
        rows.append((i, f"http://h.example.com/a/{i:03d}", page(f"<div>Home</div><div>About us</div><section>{own}</section><div>Terms</div>"), "x", 1))
    rows.append((90, rows[4][1] + "/copy", rows[4][2], "x", 1))  # a copy of an article deletes nothing of it
    rows.append((91, "http://other.org/", page("<div>Home</div><div>Alone</div>"), "x", 1))
    got = run(spark, rows)
    for i in range(30):
        assert got[i].count("\n") == 2 and got[i].startswith(f"text {i} 0")
    assert got[90] == got[4]
    assert got[91] == "Home\nAlone"


def test_article_lines_shared_with_the_neighbour_stay(spark):
    body = lambda i: f"<div>Menu</div><article><h1>Same head</h1><p>same words</p><p>own {i}</p></article>"
    got = run(spark, [(i, f"http://h/{i}", page(body(i)), "x", 1) for i in range(4)])
    assert got == {i: f"Same head\nsame words\nown {i}" for i in range(4)}


def test_nulls_broken_markup_repeats_and_empty(spark):
    rows = [(1, None, None, None, None), (2, "http://h/", "", "x", 1), (3, "http://h/x", "<p>open <b>bold<div>next", "x", 1),
            (4, "::", "plain & simple &nbsp; <", "x", 1), (3, "http://h/x", "<p>open <b>bold<div>next", "x", 1),
            (5, "http://h/y", "<p>" + "long words " * 50000, "x", 1), (6, "http://h/z", "</div></p></article><script>never closed", "x", 1)]
    df = html_diff.main_texts(spark.createDataFrame(rows, SCHEMA))
    assert df.count() == len(rows)
    got = {r.page_id: r for r in df.collect()}
    assert got[1].text == got[2].text == got[6].text == "" and got[3].text == "open bold\nnext" and got[4].text == "plain & simple <"
    assert got[5].n_chars == len("long words " * 50000) - 1
    assert html_diff.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_pages_keep_exactly_their_articles(spark):
    import html
    import re

    from conftest import SF01

    df = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: r.text for r in html_diff.main_texts(df).collect()}
    for r in df.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_runs_of_equal_pages_lose_their_template_lines(spark, monkeypatch):
    """Copies under other ids and addresses, more than a neighbour on either side reaches."""
    monkeypatch.setattr(html_diff, "COPIES", 4)
    body = lambda i: f"<div>Home</div><div>About us</div><section><p>words {i}</p><p>more {i}</p><p>last {i}</p></section><div>Terms</div>"
    rows = [(i, f"http://h/a/{i}", page(body(i)), "x", 1) for i in range(6)]
    rows += [(100 + k, f"http://h/a/3?utm={k}", page(body(3)), "x", 1) for k in range(20)]
    marked = body(3).replace("<div>Home</div>", "<nav>Home</nav>").replace("<section>", "<article>").replace("</section>", "</article>")
    rows += [(200, "http://h/a/3?print", page(marked), "x", 1)]
    got = run(spark, rows)
    for i, text in got.items():
        own = 3 if i >= 100 else i
        assert text == f"words {own}\nmore {own}\nlast {own}", i


def test_flat_markup_loses_its_template_lines(spark):
    """Menu, notice and footer at the same place as more own paragraphs; a pair's own line stays."""
    own = lambda i: "".join(f"<p>text {i} {k}</p>" for k in range(12))
    pair = lambda i: "<p>quoted by two</p>" if i in (4, 5) else ""
    rows = [(i, f"http://h/a/{i}", page(f"<p>Home</p><p>Notice</p>{own(i)}{pair(i)}<p>Terms</p>"), "x", 1) for i in range(10)]
    got = run(spark, rows)
    for i, text in got.items():
        assert text.split("\n") == [f"text {i} {k}" for k in range(12)] + ["quoted by two"] * (i in (4, 5))


def test_numbers_of_pages_that_fill_blocks_exactly(spark, monkeypatch):
    monkeypatch.setattr(html_diff, "BLOCK", 8)
    for n in (8, 16, 17):
        rows = [(i, f"http://h.example/p/{i:03d}", f"<div>menu</div><div>own line {i}</div>") for i in range(n)]
        got = html_diff.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert sorted((r.page_id, r.text) for r in got) == [(i, f"own line {i}") for i in range(n)]
