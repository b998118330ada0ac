"""URL rules and main text of pages."""

import itertools
import random

import numpy as np
import pytest

from namesieve.llm import crf_extract, html_blocks, url_digests

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BLOCKED = [("ads.example.net", "/", "block"), ("ads.example.net", "", "block")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Example.ORG/es/1?x#y", ("www.example.org", "/es/1", "example.org/es/", "block")),
        ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
        ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("x://org/", ("org", "/", "org/", "allow")),
        ("x://org", ("org", "", None, "allow")),
        ("http://a.com/de/?/fr/", ("a.com", "/de/", "com/de/", "block")),
        ("http://a.com?/de/", ("a.com", "", None, "allow")),
        ("http://xcom/fr/", ("xcom", "/fr/", None, "allow")),
        ("http://b.ads.example.net/q", ("b.ads.example.net", "/q", None, "block")),
        ("http://ads.example.net", ("ads.example.net", "", None, "block")),
        ("http://badads.example.net/", ("badads.example.net", "/", None, "allow")),
        ("http://ÄB.org/ß", ("Äb.org", "/ß", "org/", "allow")),
        ("no scheme.org/", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("http:///path", ("", "/path", None, "allow")),
        ("http://" + "a." * 5000 + "org/" + "p" * 90_000, ("a." * 5000 + "org", "/" + "p" * 90_000, "org/", "allow")),
    ],
)
def test_judge(spark, url, want):
    df = spark.createDataFrame([(1, url, "x"), (None, url, "y")], "page_id long, url string, rule string")
    out = url_digests.judge(df, RULES, BLOCKED)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {tuple(r)[1:] for r in out.collect()} == {want}


def test_collisions_are_told_apart_by_their_strings(monkeypatch):
    monkeypatch.setattr(url_digests.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    entries = [(f"h{i}.net", "/" * (i % 2), f"v{i % 4}") for i in range(40)]
    found = url_digests.Digests(url_digests.build(entries))
    parts = [(f"h{i}.net".encode(), b"/") for i in range(45)]
    assert found.longest(parts) == [(f"h{i}.net" + "/" * (i % 2), f"v{i % 4}") if i < 40 else None for i in range(45)]


def test_many_entries_against_a_plain_search():
    chance = random.Random(2)
    name = lambda: "".join(chance.choice("ab.") for _ in range(chance.randint(1, 6)))
    entries = [(name(), "/" + name(), chance.choice("xyz")) for _ in range(300)]
    parts = [(name().encode(), f"/{name()}{name()}".encode()) for _ in range(800)]
    first = {}
    for h, p, v in entries:
        first.setdefault((h, p), v)

    def plain(host, path):
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in first.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else None

    assert url_digests.Digests(url_digests.build(entries)).longest(parts) == [plain(h.decode(), p.decode()) for h, p in parts]


def test_empty_and_oversized_lists(spark, monkeypatch):
    assert url_digests.Digests(url_digests.build([])).longest([(b"a.org", b"/")]) == [None]
    df = spark.createDataFrame([("a.org", "/", None), (None, "/", "x")], "h string, p string, v string")
    assert url_digests.entries(df, "h", "p", "v") == [("a.org", "/", "block")]
    monkeypatch.setattr(url_digests, "MAX_ENTRIES", 1)
    with pytest.raises(ValueError, match="entries"):
        url_digests.build(RULES)
    with pytest.raises(ValueError, match="entries"):
        url_digests.entries(df, "h", "p", "v")
    assert url_digests.judge(spark.createDataFrame([], "page_id long, url string"), [], []).count() == 0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        ("  \n ", []),
        ("plain &amp; text", ["plain & text"]),
        ("<p>a<p>b<br>c", ["a", "b c"]),
        ("<p>a <b>b</b>\n\t c</p><!-- x > y --><p>d</p>", ["a b c", "d"]),
        ('<script>var t="</p>";</script><p title="a>b">x</p><style>p{}</style>', ["x"]),
        ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("1 < 2 and <3", ["1 < 2 and <3"]),
        ("<p>open <!-- never closed <p>x", ["open"]),
        ("<script>never closed <p>x", []),
        ("<P CLASS=x>&lt;b&gt; &#233; &nbsp; é", ["<b> é é"]),
        ("<a href=x>in</a>line <span>text</span>", ["inline text"]),
        ('<p class="un"closed>x', ["x"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html_blocks.blocks(page)] == texts


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a</p><video-js id=x></video-js><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><title-card>b</title-card><p>rest</p><title>t</title>", ["a", "b", "rest"]),
        ("<svg class=i/><p>rest</p>", ["rest"]),
        ("<p>a</p><!--><p>b</p>", ["a", "b"]),
        ("<p>a</p><!---><p>b</p><!-- x --><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><!-- x --!><p>b</p><!-- y > --><p>c</p><!-- z", ["a", "b", "c"]),
        ("<math/><p>a</p><math>x</math><p>rest</p>", ["a", "rest"]),
        ("<svg><title>no</title></svg><p>rest</p>", ["rest"]),
        ("<p>a<video src=x><p>rest</p>", ["a", "rest"]),
        ('<title>1 <b "2</title><p class="x">rest</p>', ["rest"]),
        (f'<script data-x="{"y" * 9000}">var code;</script><p>rest</p>', ["rest"]),
        (f'<p title="{"y>" * 9000}">rest</p>', ["rest"]),
    ],
)
def test_raw_elements_end_where_they_should(page, texts):
    assert [b.text for b in html_blocks.blocks(page)] == texts


def test_many_unclosed_raw_elements_stay_linear():
    assert len(html_blocks.blocks("<svg><p>word" * 60_000)) == 60_000


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert [b.text for b in html_blocks.blocks(deep)] == ["x"]
    assert len(html_blocks.blocks("<p>word word" * 30_000)) == 30_000
    assert html_blocks.blocks('<a "' * 5_000) is not None


@pytest.fixture(scope="module")
def field(request):
    spark = request.getfixturevalue("spark")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return crf_extract.fit(crf_extract.sample(pages, "page_id", "html"))


def test_held_out_layouts(field):
    test = list(crf_extract.layouts(crf_extract.FILLER, 200, seed=991))
    right = [p == q for found, labels in test for p, q in zip(field.decode(found), labels)]
    assert len(test) > 150 and sum(right) / len(right) > 0.97


def test_decode_is_the_best_of_all_state_sequences():
    rng = np.random.default_rng(4)
    pages = ["<nav><a>Home</a><p>News today</p></nav><div>" + "".join(f"<p>Line {i}, of some length.</p>" for i in range(k)) + "</div>" for k in range(7)]
    for page in [*pages, "<p>one</p>", ""]:
        found = html_blocks.blocks(page)
        for _ in range(20):
            chain = crf_extract.Field()
            chain.weights, chain.moves = rng.standard_normal(chain.weights.shape), rng.standard_normal((2, 2, 2))
            emit, same = (crf_extract._features(found) @ chain.weights, crf_extract._same(found)) if found else ([], [])

            def score(states):
                moves = sum(chain.moves[same[t], states[t - 1], states[t]] for t in range(1, len(states)))
                return moves + sum(e for e, y in zip(emit, states) if y)

            best = max(itertools.product((0, 1), repeat=len(found)), key=score)
            assert score(chain.decode(found)) == pytest.approx(score(best))


A = "<h1>A title of some words</h1><p>The first paragraph is about the river, and it is long enough.</p><p>The second one says more.</p>"
WANT = "A title of some words\n\nThe first paragraph is about the river, and it is long enough.\n\nThe second one says more."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav><article>{A}</article><footer>&copy; 2024 Some House</footer>",
        f"<body><div class='menu'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='post-content'>{A}</div><div class='sidebar'><h3>Related</h3><p>Another story you may like.</p></div>",
        f"<body><header><p>The Daily Paper</p></header><main><article>{A}</article><section class='comments'><h2>Comments</h2><div class='comment'><p>I did not agree with this at all, sorry.</p></div></section></main>",
        f"<body><div class='cookie-banner'><p>We use cookies to make this site work.</p><button>Accept</button></div><article>{A}</article><aside><p>Buy now, while it lasts.</p></aside><form><label>Your mail</label><input><button>Send</button></form>",
        f"<body><article>{A}<div class='ad'>Best prices for all shoes, today only.</div></article><footer><p>All rights reserved.</p></footer>",
    ],
)
def test_hand_made_pages(field, page):
    assert field.extract(page) == WANT


def test_extract_table(spark, field):
    rows = [(1, "u", f"<article>{A}</article>", "x"), (None, None, None, "x"), (2, "u", "", "x"), (1, "u", f"<article>{A}</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in crf_extract.extract(df, field=field).collect()]
    assert got == [(1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "u", "", 0), (1, "u", WANT, len(WANT))]
    assert crf_extract.extract(df.limit(0)).count() == 0
