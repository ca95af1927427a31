from functools import lru_cache

import pytest

from tessera.llm import html

PAGES = "page_id bigint, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t = "</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><header>top</header>
<article><h1>Head &amp; line</h1><p><b>First   part.<br><p>Second <i>text</i> &lt;here&gt;&nbsp;now.</p><aside>side</aside>
<form><input value="q"><button>go</button></form><section id="comments"><p>nice post</p></section></article>
<div class="cookie-notice">accept</div><footer>&copy; me</footer></body></html>"""


def texts(spark, rows, **kw):
    return {r.page_id: r for r in html.extract(spark.createDataFrame(rows, PAGES), **kw).collect()}


def test_article_alone(spark):
    got = texts(spark, [(1, "http://a.b/en/1", PAGE)])[1]
    assert got.text == "Head & line\nFirst part.\nSecond text <here> now."
    assert got.n_chars == len(got.text) and got.url == "http://a.b/en/1"


def test_lines_shared_with_the_nearest_page_go(spark):
    page = "<html><body><p>Site title</p><p>{}</p><p>All rights held</p></body></html>".format
    got = texts(spark, [(i, f"http://a.b/en/{i}", page(f"Own text {i}.")) for i in range(1, 5)] + [(9, "http://other.c/en/1", page("Alone."))])
    assert [got[i].text for i in range(1, 5)] == [f"Own text {i}." for i in range(1, 5)]
    assert got[9].text == "Site title\nAlone.\nAll rights held"  # no page of its host to compare with


def test_copies_keep_their_text(spark):
    page = "<html><body><p>Same text on both.</p></body></html>"
    got = texts(spark, [(1, "http://a.b/en/1", page), (2, "http://a.b/en/2?x=1", page)])
    assert {r.text for r in got.values()} == {"Same text on both."}


@pytest.mark.parametrize("broken,expected", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>open &eacute;", "open é"), ("<script>never closed <p>x", ""),
    ("<!-- never closed <p>x", ""), ("<p>5 < 6 & 7</p>", "5 < 6 & 7"), ("<nav><p>m</nav><p>t</p>", "t"), ("<p title='a > b'>quoted</p>", "quoted"), ("<div hidden>no</div><p>yes</p>", "yes"),
])
def test_odd_markup(spark, broken, expected):
    assert texts(spark, [(1, "http://a.b/1", broken)])[1].text == expected


def test_edge_rows_and_split_hosts(spark):
    rows = [(1, None, PAGE), (None, "http://a.b/1", PAGE), (2, "", None)] + [(10 + i, f"http://a.b/en/{i}", f"<body><p>Menu</p><p>Text {i}</p></body>") for i in range(60)]
    df = spark.createDataFrame(rows, PAGES)
    got = html.extract(df, group=10).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id and r.page_id >= 10} == {f"Text {i}" for i in range(60)}
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


@lru_cache(None)
def brute_lcs(a, b):
    if not a or not b:
        return 0
    return max(brute_lcs(a[1:], b), brute_lcs(a, b[1:]), (a[0] == b[0]) + brute_lcs(a[1:], b[1:]) if a[0] == b[0] else 0)


@pytest.mark.parametrize("a,b", [("abcbdab", "bdcaba"), ("", "a"), ("aaaa", "aa"), ("abc", "xyz"), ("xaxbx", "abab")])
def test_alignment_is_a_longest_common_subsequence(a, b):
    taken = sorted(html.shared_lines(list(a), list(b)))
    assert len(taken) == brute_lcs(tuple(a), tuple(b))
    rest = iter(b)
    assert all(any(c == a[k] for c in rest) for k in taken)


def test_differences_decide_inside_articles_too(spark):
    page = "<body><p>Site</p><article><p>Sign in</p><p>Own text {0}.</p></article></body>".format
    got = texts(spark, [(i, f"http://a.b/en/{i}", page(i)) for i in range(1, 6)])
    assert [got[i].text for i in range(1, 6)] == [f"{'Sign in' + chr(10) if i in (1, 5) else ''}Own text {i}." for i in range(1, 6)]  # a first or last page has one neighbour only


def test_near_copies_keep_their_article(spark):
    page = "<body><p>Site</p><article><p>A first line that all have.</p><p>A second line that all have.</p><p>Own {0}</p></article></body>".format
    got = texts(spark, [(i, f"http://a.b/en/{i}", page(i)) for i in range(1, 6)])
    assert [got[i].text for i in range(1, 6)] == [f"A first line that all have.\nA second line that all have.\nOwn {i}" for i in range(1, 6)]


def test_names_inside_an_article(spark):
    page = '<body><article><p>Text.</p><div class="search results"><p>Found here.</p></div><p class="alert">Mind this.</p><p>So <span class="ad">buy</span> it goes.</p><div class="cookie-notice">Accept</div></article><div class="search"><p>Find</p></div></body>'
    assert texts(spark, [(1, "http://a.b/1", page)])[1].text == "Text.\nFound here.\nMind this.\nSo it goes."


def test_furniture_that_repeats_is_found_by_the_differences(spark):
    """Of lines in menus and footers those that the neighbour has go as shared, the others by the elements' names."""
    lines, kinds = zip(*html.blocks("<body><nav><p>Home</p><p>Own link</p></nav><article><p>Text one here.</p></article><footer>All rights</footer></body>"), strict=True)
    assert html.decided(list(lines), list(kinds), ["Home", "Other link", "Text two.", "All rights"], None) == ["shared", "named", "kept", "shared"]


def test_a_whole_host_against_plain_code(spark):
    import random

    rng = random.Random(3)
    rows, parsed = [], {}
    for i in range(60):
        own = [f"line {rng.randrange(6)}" for _ in range(rng.randint(0, 3))] + [f"own {i} {j}" for j in range(rng.randint(0, 3))]
        inside = [f"art {rng.randrange(5)}" for _ in range(rng.randint(0, 3))] + [f"text {i} {j}" for j in range(rng.randint(0, 4))]
        rng.shuffle(own)
        rows.append((i, f"http://a.b/{rng.randrange(400)}", f"<body>{''.join(f'<p>{x}</p>' for x in own)}<article>{''.join(f'<p>{x}</p>' for x in inside)}</article></body>"))
        parsed[i] = [(x, False) for x in own] + [(x, True) for x in inside]
    order = sorted(rows, key=lambda r: (r[1].removeprefix("http://a.b"), r[0]))
    got = texts(spark, rows, group=8)

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for at, (i, url, _) in enumerate(order):
        sides = sorted((k for k in (at - 1, at + 1) if 0 <= k < len(order)), key=lambda k: (-common(url, order[k][1]), k))
        size, inside = sum(len(x) for x, _ in parsed[i]), sum(len(x) for x, d in parsed[i] if d)
        said = []
        for k in sides:
            hit = html.shared_lines([x for x, _ in parsed[i]], [x for x, _ in parsed[order[k][0]]])
            assert len(hit) == brute_lcs(tuple(x for x, _ in parsed[i]), tuple(x for x, _ in parsed[order[k][0]]))
            if 2 * sum(len(parsed[i][j][0]) for j in hit if parsed[i][j][1]) >= inside:
                hit = {j for j in hit if not parsed[i][j][1]}
            said.append(set() if sum(len(parsed[i][j][0]) for j in hit) == size else hit)
        near, both = said[0], said[0] & (said[1] if len(said) > 1 else set())
        if not near and 2 * inside > size:
            expected = [x for x, d in parsed[i] if d]
        else:
            expected = [x for j, (x, d) in enumerate(parsed[i]) if j not in (both if d else near)]
        assert got[i].text == "\n".join(expected), (i, url)


def test_long_pages_align_exactly(monkeypatch):
    import random

    rng = random.Random(2)
    for cells in (html.CELLS, 50):
        monkeypatch.setattr(html, "CELLS", cells)
        for _ in range(200):
            a, b = (["x" + rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
            size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
            taken, rest = sorted(html.shared_lines(a, b)), iter(b)
            assert len(taken) == size[-1][-1] and all(any(c == a[k] for c in rest) for k in taken)


def test_body_beside_a_teaser_article_stays(spark):
    page = "<body><p>Site</p><article><p>Teaser {0}</p></article><div>The long body of page {0} itself.</div></body>".format
    got = texts(spark, [(i, f"http://a.b/en/{i}", page(i)) for i in range(1, 3)] + [(9, "http://alone.c/1", page(9))])
    assert [got[i].text for i in (1, 2)] == [f"Teaser {i}\nThe long body of page {i} itself." for i in (1, 2)]
    assert got[9].text == "Site\nTeaser 9\nThe long body of page 9 itself."  # nothing to compare with, and the article is not most of it


@pytest.mark.parametrize("group", [html.GROUP, 7])
def test_pages_meet_their_nearest_page_of_the_whole_host(spark, group):
    menu = "<body><p>Menu of {0}</p><p>Text {1}</p></body>".format
    rows = [(i, f"http://a.b/en/{i}/", menu("a.b", i)) for i in range(100, 140)]  # each is a folder of its own
    rows += [(i, f"http://{i}.c/en/", menu("c", i)) for i in range(200, 210)]  # alone on their hosts
    got = texts(spark, rows, group=group)
    assert all(got[i].text == f"Text {i}" for i in range(100, 140))
    assert all(got[i].text == f"Menu of c\nText {i}" for i in range(200, 210))


def test_cuts_change_nothing(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.x/{'/'.join(str(k * 7919 % 97))}{'/' * (k % 3 == 0)}", f"<body>{''.join(f'<p>line {k * j % 5}</p>' for j in range(4))}<article><p>t {k}</p></article></body>") for k in range(90)]
    rows += [(None, "http://a.x/1", "<p>u</p>"), (None, None, "<p>v</p>"), (1, "http://a.x/1", "<p>w</p>")] + [(300 + k, "http://a.x/1", f"<p>same</p><p>{k}</p>") for k in range(20)]
    got = [sorted(map(str, html.extract(spark.createDataFrame(rows, PAGES), group=g).collect())) for g in (10_000, 9, 2)]
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2]


@pytest.mark.parametrize(
    "name,gone",
    [("menu-of-the-day", False), ("hidden-gems", False), ("adslot", True), ("discussion", True), ("respond", True), ("ad", True), ("site-nav", True), ("ad_slot_2", True), ("comments-list", True), ("cookie-notice left", True), ("advice", False), ("story navigation-systems", False), ("Main-Menu", True)],
)
def test_whole_names_decide(name, gone):
    found = html.blocks(f'<article><p>Before</p><div class="x" id="{name}">Inside</div><p>After</p></article>')
    assert [t for t, kind in found if kind != html.OUT] == (["Before", "After"] if gone else ["Before", "Inside", "After"])


def test_repeated_furniture_of_a_host_goes_by_differences(spark):
    site = "<div>Home | News | About us</div>{}<div>Imprint of the house</div>"
    rows = [(k, f"http://h.org/a/{k}", "<body>" + site.format(f"<p>Story number {k} begins.</p><p>It goes on with {k * 7}.</p>") + "</body>") for k in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Story number {k} begins.\nIt goes on with {k * 7}." for k in range(8)}
