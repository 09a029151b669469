"""Pattern search, page extraction and URL verdicts against plain Python."""

import hashlib
import random
import re

import pytest
from helpers import awkward, documents, empty, prose

from credence.llm import decontaminate, html_extract, url_filter

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_find(texts, items, window=10):
    out = []
    for k, text in texts:
        w, hit, found = plain_words(text), set(), set()
        for item, t in items:
            p = plain_words(t)
            m = min(window, len(p))
            for s in range(len(p) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at:at + m] == p[s:s + m]:
                        hit.update(range(at, at + m))
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_all_occurrences(seed):
    rng = random.Random(seed)
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for i in range(12)]
    found = {(s, p.length, i) for p in decontaminate.build(items, 4) for s, these in p.search(text) for i in these}
    want = set()
    for i, t in items:
        p = [x.encode() for x in t.split()]
        m = min(4, len(p))
        for s in range(len(p) - m + 1 if m else 0):
            want |= {(at, m, i) for at in range(len(text) - m + 1) if text[at:at + m] == p[s:s + m]}
    assert found == want


def test_windows_without_their_words_are_skipped():
    p = decontaminate.build([(1, prose(1, 60))])[0]
    assert p.most == 9 and set(p.shift.values()) == set(range(9))


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_find(spark, block_bytes):
    passage = prose(50, 40)
    items = [(1, passage), (2, " ".join(passage.split()[5:17])), (3, "one two three"), (4, None), (5, " .,! "), (10, "Straße 中文"), (None, "one"), (1, "zz yy")]
    texts = [r[:2] for r in awkward()] + [(90, "Intro. " + passage.upper().replace(" ", ", ") + " outro"), (91, " ".join(passage.split()[3:12])),
                                           (92, passage + " " + passage), (93, "été straße 中文 zz yy one"), (94, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(1)
    out = decontaminate.digest(decontaminate.find(documents(spark, [(*t, None, None, None) for t in texts]), bench, block_bytes=block_bytes))
    want = plain_find(texts, [("null" if i is None else i, t) for i, t in items])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    kept = decontaminate.clean(documents(spark, [(*t, None, None, None) for t in texts]), bench, block_bytes=block_bytes)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(w[0]) for w in want if not w[5])


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.digest(decontaminate.find(documents(spark), nothing)).collect()
    assert len(out) == len(awkward()) and not any(r["contaminated"] for r in out)
    assert {r["items_sha256"] for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate.find(empty(spark), nothing).count() == 0
    assert decontaminate.clean(documents(spark), nothing).count() == len(awkward())


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "This sentence is long enough to be running text of an article."
CASES = [
    (page(f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}<p><b>B</b>ig&nbsp;&amp; \n small</article><footer>&copy; x</footer>"),
     f"Head\n{LONG}\nBig & small"),
    (page(f"<div class='site-header'>Site</div><div id=main><div class='post-1'><p>{LONG}</p><div class='ad-box'>Buy</div><p>Two<br>lines</p>"
          f"<div class='comments'><p>{LONG} {LONG} {LONG}</p></div></div></div><aside>More</aside><form>Name <input></form>"), f"{LONG}\nTwo lines"),
    (page(f"<script>if (a<b) x='</p>'</script><p>{LONG}</p><style>p{{}}</style><!-- <p>no</p> --><noscript>js</noscript>"), LONG),
    (page(f"<main><section><p>{LONG}</p></section><section><p>Second. {LONG}</p></section></main><div role='navigation'>x y z</div>"), f"{LONG}\nSecond. {LONG}"),
    (page(f"<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><p>{LONG}</article>"), f"one\ntwo\nc1\nc2\n{LONG}"),
    (page(f"<div class='cookie-notice'><p>{LONG} {LONG}</p></div><div><p>{LONG}</p></div>"), LONG),
    (page(f"<div hidden><p>{LONG} no</p></div><div style='display: none'><p>{LONG} no</p></div><p>{LONG}"), LONG),
    ("", ""), ("plain < text &lt;b&gt; &#233;&eacute;", "plain < text <b> éé"), ("<p>cut <i", "cut"), ("<<>></p></div><", "<<>>\n<"),
    ("<body><p>a</p>" + "<div>" * 300 + "deep" + "</div>" * 300, "deep"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_page(html, want):
    assert html_extract.extract_page(html, []) == want


@pytest.mark.parametrize("piece", ["<svg-icon name='x'></svg-icon>", "<title-bar></title-bar>", "<style-guide></style-guide>", "<svg class=i viewBox='0 0 1 1'/>",
                                   "<svg href='/a>b/>' />", "<math/>", "<SVG\n/>", "<svg><path d='M0'/><title>no</title></svg>", "<style type='x'>no</style>", "<svg a=/b>no</svg>"])
def test_raw_elements_end_where_they_end(piece):
    assert html_extract.extract_page(page(f"<article><p>{LONG}</p>{piece}<p>Second. {LONG}</p></article>"), []) == f"{LONG}\nSecond. {LONG}"


@pytest.mark.parametrize("body,want", [
    (f"<div class='layout with-sidebar'><p>{LONG} {LONG}</p><p>{LONG}</p><div class='sidebar'><p>Side.</p></div></div><p>Small.</p>", f"{LONG} {LONG}\n{LONG}"),
    (f"<article class='post comments-open'><p>{LONG}</p><div class='comments'><p>Nice.</p></div></article><p>Copyright.</p>", LONG),
    (f"<div class='has-menu'><article><p>{LONG} {LONG}</p></article></div><div class='promo'><p>{LONG}</p></div><p>Small.</p>", f"{LONG} {LONG}"),
    (f"<div class='post'><p>{LONG} {LONG}</p><div class='related'><article><p>{LONG}</p></article></div></div>", f"{LONG} {LONG}"),
    ("<div class='widget'><p>One.</p></div><div class='social'><p>Other text.</p></div>", "Other text."),
])
def test_class_words_do_not_take_the_article(body, want):
    assert html_extract.extract_page(page(body), []) == want


def test_unclosed_quotes_and_tags_take_linear_time():
    for text in ("<a href=\"" * 20_000, "<" * 200_000, "<!--" * 50_000, "<p " * 50_000, "<script>" * 20_000, "&" * 100_000):
        html_extract.extract_page(text, [])


def test_hosts_vote(spark):
    """A page whose longest container is not the article follows its host."""
    usual = page(f"<div class='c12'><p>{LONG}</p><p>{LONG}</p></div><div class='extra'><p>Short.</p></div>")
    odd = page(f"<div class='c7'><p>The article.</p></div><div class='extra'><p>{LONG} {LONG}</p></div>")
    rows = [(i, "http://A.example.org/x", usual) for i in range(5)] + [(9, "https://a.example.org?q", odd), (10, None, odd), (11, "x", None), (None, "http://a.example.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS k", "2 AS host", "3 AS paths", "4 AS salt")
    for limit in (html_extract.BROADCAST_BYTES, 0):
        html_extract.BROADCAST_BYTES, old = limit, html_extract.BROADCAST_BYTES
        out = html_extract.extract(pages)
        got = {r["page_id"]: r for r in out.collect()}
        html_extract.BROADCAST_BYTES = old
        assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
        assert got[0]["text"] == f"{LONG}\n{LONG}" and got[9]["text"] == "The article." and got[10]["text"] == f"{LONG} {LONG}"
        assert got[11]["text"] == got[None]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """The driver's pages: what stands between the article tags, block by block."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search("<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits, default=(0, None, None))[1]


URLS = ["http://com/x", "https://www.EXAMPLE.com/en/1", "http://a.example.com/en/", "http://a.example.com/en", "http://example.com/de/1?x=http://b.net/es/", "http://b.net/fr/x#y",
        "http://net/es/", "http://xnet/es/", "http://a.org", "http://a.com", "http://a.com?x", "ftp://ÄB.com/", "no scheme", "://", "", None, "http://www.example.com/en/x\ny",
        "http://sub.www.example.com/en/q", "a://b://c.com/d", "http://a.com:80/en/"]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://x.com/", None), (0, URLS[0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS features", "3 AS prediction", "4 AS k")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            host, path, rule = plain_url(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == ({v: k for k, v in url_filter.RULES}.get(r["rule"]) or r["verdict"]) if r["rule"] is None else True
        if r["rule"]:
            assert r["verdict"] == dict((b, a) for a, b in url_filter.RULES)[r["rule"]]
        assert r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_model_tells_unwanted_words(spark):
    urls = {"https://m.casino-royal.example.org/en/5": "block", "https://www.spam-farm.example.org/de/9": "block", "https://blog.harbour-walks.example.org/en/5": "allow",
            "https://ththon.example.org/fr/77": "allow", "": "allow", "https://www.wool-and-yarn.example.net/en/3?page=2": "allow"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=[]).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_model_on_labels_it_has_not_seen(spark):
    rows = url_filter.labelled_urls()
    random.Random(2).shuffle(rows)
    cut = len(rows) * 3 // 4
    model = url_filter.learn(spark, rows[:cut])
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[cut:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=[], model=model).collect()}
    right = sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows[cut:]))
    assert right / (len(rows) - cut) > 0.95
