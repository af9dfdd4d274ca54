import pytest

from docloom.llm import catalog, html_text

from .helpers import empty

PARAGRAPH = "This is one of the paragraphs that a reader of the page has come for, and it is long enough to be told apart. "
LONG = PARAGRAPH * 3
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About the site</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 example</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}{body}{FOOT}</body></html>"


CASES = {
    "article": (page(f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article>"), f"Head {LONG.strip()} Short."),
    "short article": (page("<article><p>Be.</p><p>And so.</p></article>"), "Be. And so."),
    "no article element": (page(f"<div><h1>Head</h1><p>{LONG}</p><p>Short.</p></div>"), f"Head {LONG.strip()} Short."),
    "advert beside": (page(f'<div class="ad">{LONG}</div><article><p>{LONG}</p></article>'), LONG.strip()),
    "advert inside": (page(f'<article><p>{LONG}</p><div class="ad-box">Buy now</div><p>End.</p></article>'), f"{LONG.strip()} End."),
    "comments": (page(f'<article><p>{LONG}</p></article><section id="comments"><p>{LONG}</p></section>'), LONG.strip()),
    "link list": (page(f'<p>{LONG}</p><p><a href="#">{LONG}</a></p>'), LONG.strip()),
    "long and poor": (page(f"<p>{LONG}</p><div>{'XKCD QWERTY ZXCV ' * 20}</div>"), LONG.strip()),
    "references": (page(f"<article><p>{LONG} &amp;&lt;&#233;&eacute;&nbsp;x &am &amp</p></article>"), f"{LONG.strip()} &<éé x &am &"),
    "white space": (page("<article><p>a\n\t b c</p><p> </p></article>"), "a b c"),
    "unclosed inline": (page("<article><p><b>one<br><p>two</p></article>"), "one two"),
    "inline joins": (page("<article><p>w<i>or</i>d with a <a href='x'>link</a></p></article>"), "word with a link"),
    "cut off": (f"<body>{NAV}<article><p>{LONG}</p><p>Cut of", f"{LONG.strip()} Cut of"),
    "cut off in a tag": ("<article><p>text</p><p class='x", "text"),
    "cut off in a script": ("<article><p>text</p><script>var a = 1", "text"),
    "comment and form": (page(f"<article><!-- no <p>x</p> --><form><p>{LONG}</p></form><p>yes</p></article>"), "yes"),
    "quoted bracket": ('<article><p title="a > b">text</p></article>', "text"),
    "not a tag": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "only menus": (page(""), ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert html_text.main_text(html) == want


TEXT = LONG.strip()
WHOLE = {
    "body named": (f"<html class='no-comments'><body class='has-sidebar'><p>{LONG}</p></body></html>", TEXT),
    "layout named": (page(f"<div class='layout-with-sidebar'><div class='sidebar'>{LONG}</div><p>{LONG}</p><p>{LONG}</p></div>"), f"{TEXT} {TEXT}"),
    "article named": (page(f"<article class='post comments'><p>{LONG}</p></article>"), TEXT),
    "wrapper named": (page(f"<div id='widget'><p>{LONG}</p><p>{LONG}</p></div><div class='ad'>{LONG}</div>"), f"{TEXT} {TEXT}"),
    "title named": (page(f"<article><h1 class='entry-header'>Head</h1><h1 class='header'>Two</h1><p>{LONG}</p></article>"), f"Head Two {TEXT}"),
    "form around": (f"<body><form id='aspnetForm'>{NAV}<div><p>{LONG}</p><p>Short.</p></div>{FOOT}</form></body>", f"{TEXT} Short."),
    "form around an article": (f"<body><form>{NAV}<article><p>Be.</p></article>{FOOT}</form></body>", "Be."),
    "long comments": (page(f"<article><p>{LONG}</p></article><div class='comments-area'>{f'<p>{LONG}</p>' * 5}</div>"), TEXT),
    "poor article": (page(f"<div class='ad'>{LONG}</div><article><p>{'XKCD ' * 50}</p></article>"), ("XKCD " * 50).strip()),
    "long form beside": (page(f"<p>{LONG}</p><p>{LONG}</p><form><p>{LONG}</p></form>"), f"{TEXT} {TEXT}"),
}
LINKS = {
    "unclosed name": (page(f"<a name='top'><p>{LONG}</p><p>{LONG}</p>"), f"{TEXT} {TEXT}"),
    "unclosed link": (page(f"<article><p><a href='#'>Top</p><p>{LONG}</p><p>end</p></article>"), f"{TEXT} end"),
    "nested link": (page(f"<article><p>{LONG}<a href='x'>one <a href='y'>two</a></p><p>{LONG}</p></article>"), f"{LONG}one two {TEXT}"),
    "link around blocks": (page(f"<p>{LONG}</p><a href='x'><div>{LONG}</div></a>"), TEXT),
    "link ends outside": (page(f"<article><p><a href='#'>Top</p><p>{LONG}</p><p>end</a></p></article>"), f"{TEXT} end"),
    "self-closed svg": (page(f"<article><svg width='1'/><p>{LONG}</p><svg><text>no</text></svg><iframe src='x'/><p>two</p></article>"), f"{TEXT} two"),
    "object without end": (page(f"<article><object data='x'><iframe><p>{LONG}</p></article>"), TEXT),
}


RUSSIAN = "Это один из абзацев, ради которых читатель открыл страницу, и он достаточно длинный, чтобы его узнать. " * 3
CHINESE = "这是读者打开这个页面时想要看到的段落之一，它的长度足以让人把它和菜单区分开来。" * 6
ITALIAN = "Questo paragrafo racconta una storia abbastanza lunga perché chi legge possa riconoscerla subito. " * 3
OTHER = {
    "russian page": (page(f"<h1>Глава</h1><p>{RUSSIAN}</p><p>{RUSSIAN}</p>"), f"Глава {RUSSIAN}{RUSSIAN.strip()}"),
    "chinese beside english": (page(f"<p>{LONG}</p><p>{CHINESE}</p>"), f"{TEXT} {CHINESE}"),
    "other latin language": (page(f"<div><p>{ITALIAN}</p><p>Fine.</p></div>"), f"{ITALIAN.strip()} Fine."),
    "russian menu": (page(f"<p>{RUSSIAN}</p><p><a href='#'>{RUSSIAN}</a></p>"), RUSSIAN.strip()),
    "foreign comments": (page(f"<p>{RUSSIAN}</p><p>{RUSSIAN}</p><div class='reader-comments'><p>{RUSSIAN}</p></div>"), f"{RUSSIAN}{RUSSIAN.strip()}"),
    "hidden parts": (page(f"<article><p>{LONG}</p><div hidden><p>{LONG}</p></div><p style='color:red; display: none'>x<p>{LONG}</p></article>"), f"{TEXT} {TEXT}"),
    "hidden words": (page("<article><p>w<span hidden>x</span>ord <b style=\"display:none\">no</b>yes</p></article>"), "word yes"),
    "not hidden": (page("<article><p class='a hidden b' data-x='hidden'>one</p><p style='overflow:hidden'>two</p></article>"), "one two"),
    "hidden until scripts run": (f"<body style='visibility:hidden'>{NAV}<p>{LONG}</p></body>", TEXT),
    "unclosed list items": (page(f"<article><p>{LONG}</p><ul><li class='ad-box'>no<li>yes</ul></article>"), f"{TEXT} yes"),
    "mostly link": (page(f"<article><p>{LONG}</p><p>As told in <a href='x'>the report of the committee on pages</a>, he left.</p><p>{LONG}</p></article>"), f"{TEXT} As told in the report of the committee on pages, he left. {TEXT}"),
    "links only": (page(f"<article><p>{LONG}</p><ul><li><a href='x'>One more</a> (3)</li></ul></article>"), TEXT),
}
NOTICES = "reader-comments user-comments post-comments article-comments comment-thread paywall-notice legal-notice cookie-policy discussion postComments".split()
PLAIN = "no-comments comments-closed has-sidebar ad-free with-comments entry-header header-image commentary notification".split()


@pytest.mark.parametrize("name", OTHER)
def test_other_scripts_hidden_parts_and_linked_paragraphs(name):
    html, want = OTHER[name]
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("name", [*NOTICES, *PLAIN])
def test_names_of_notices_and_comments(name):
    part = f"<section class='{name}'><p>{LONG}</p></section>"
    want = TEXT if name in NOTICES else f"{TEXT} {TEXT}"
    assert html_text.main_text(page(f"<article><p>{LONG}</p></article>{part}")) == want
    assert html_text.main_text(page(f"<article><p>{LONG}</p>{part}</article>")) == want


def brute_second_pass(found, labels):
    """For each open block a walk to both sides, as far as its stretch goes."""
    out = []
    for i, label in enumerate(labels):
        votes = []
        for step in (-1, 1):
            j = i
            while label == html_text.OPEN and 0 <= j + step < len(found) and not found[j].excluded:
                j += step
                if found[j].excluded or found[j].article != found[i].article:
                    break
                if labels[j] != html_text.OPEN:
                    votes.append((abs(j - i), labels[j]))
                    break
        least = min((d for d, _ in votes), default=0)
        lone = html_text.GOOD not in labels or found[i].article > 0
        near = [v for d, v in votes if d == least] or [html_text.GOOD if lone else html_text.BAD]
        out.append(max(near) if label == html_text.OPEN else label)
    return out


def test_second_pass_equals_a_walk_from_each_block():
    import random

    rng = random.Random(5)
    for _ in range(3_000):
        excluded = [rng.random() < 0.15 for _ in range(rng.randrange(12))]
        edges = [rng.randrange(3) for _ in excluded]
        found = [html_text.Block("x", 0, e, 0, a // 2) for e, a in zip(excluded, sorted(edges))]
        labels = [html_text.BAD if e else rng.choice([1, 0, -1, -1]) for e in excluded]
        assert html_text.second_pass(found, list(labels)) == brute_second_pass(found, labels)


@pytest.mark.parametrize("name", WHOLE)
def test_names_and_forms_leave_the_page_whole(name):
    html, want = WHOLE[name]
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("name", LINKS)
def test_links_and_raw_content_end(name):
    html, want = LINKS[name]
    assert html_text.main_text(html) == want


def test_query_gives_the_articles_of_the_table(spark, sf):
    import html
    import re

    got = {r.page_id: r for r in catalog.op6_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_hard_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", "<p>" * 50_000 + "deep", "x", "y"), (2, "u", "plain words 😀", "x", "y"), (2, "u", "plain words 😀", "x", "y")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [
        (1, None, "", 0), (None, "u", "deep", 4), (2, "u", "plain words 😀", 13), (2, "u", "plain words 😀", 13),
    ]
    assert html_text.extract(empty(spark).selectExpr("doc_id as page_id", "lang as url", "text as html")).collect() == []
