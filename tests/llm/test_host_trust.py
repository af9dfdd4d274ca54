import re
from collections import Counter, defaultdict

from compare import difference, duck

from docloom.llm import catalog, host_trust

from .helpers import as_tables

LOWER = {c: c + 32 for c in range(65, 91)}
PAGES = "page_id bigint, url string, html string, host string, score string, blocked string"
UNIT = host_trust.UNIT


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path, rules=host_trust.RULES):
    fits = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def flow(seeds, edges):
    """Plain personalised PageRank in whole numbers; ``edges``: (src, dst) to links."""
    out = Counter()
    for (src, _), n in edges.items():
        out[src] += n
    base = {h: s * 15 // 100 for h, s in seeds.items() if s}
    score = dict(base)
    for _ in range(host_trust.TURNS):
        new = Counter(base)
        for (src, dst), n in edges.items():
            new[dst] += score.get(src, 0) * n * 85 // (out[src] * 100)
        score = {h: s for h, s in new.items() if s}
    return score


def brute(rows):
    pages = [(p, *parts(u), h) for p, u, h in rows]
    share, edges = defaultdict(Counter), Counter()
    for _, host, path, html in pages:
        share[host][rule_of(host, path)[1]] += 1
        for link in re.findall(r"""href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]*)""", html or "", re.I):
            link = link.translate(LOWER)
            if host and link and link != host:
                edges[host, link] += 1
    seed = lambda v: {h: c[v] * UNIT // c.total() if 2 * c[v] >= c.total() else 0 for h, c in share.items()}
    trust = flow(seed("allow"), edges)
    distrust = flow(seed("block"), Counter({(b, a): n for (a, b), n in edges.items()}))
    out = []
    for p, host, path, _ in pages:
        rule, verdict = rule_of(host, path)
        bad = distrust.get(host, 0)
        verdict = verdict or ("block" if bad > trust.get(host, 0) and bad >= host_trust.THRESHOLD else "allow")
        out.append((p, host, path, rule, verdict))
    return sorted(out, key=str)


def run(spark, rows):
    got = host_trust.judge(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES))
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()), key=str)


def link(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


ROWS = [
    (1, "https://bad.net/x?q=/y", link("https://bad.net/self")),
    (2, "http://bad.net", None),
    (3, "https://Helper.example.info/a#://b", link("https://BAD.net/", "//bad.net/z", "https://evil.net/")),
    (4, "https://mixed.info/", link("https://bad.net/", *["https://good.org/fr/"] * 30)),
    (5, "https://good.org/fr/1", link("https://friend.info/", "/local", "mailto:x@y.net")),
    (6, "https://good.org/de/1", ""),
    (7, "https://friend.info/x", link("https://bad.net/x", "https://good.org/")),
    (8, "https://a.example.net/en/1", ""),
    (9, "https://a.example.net/en", ""),
    (10, "https://example.com/de/x", ""),
    (11, "https://example.com/en/x", ""),
    (12, "https://example.com/en/y", ""),
    (13, "https://half.example.com/de/x", ""),
    (14, "https://half.example.com/en/x", ""),
    (15, "https://notexample.com/de/x", ""),
    (16, "https://xnet/", ""),
    (17, "https://net/", ""),
    (18, "no scheme.net/", link("https://bad.net/")),
    (19, None, None),
    (None, "", ""),
    (20, "ftp://user@h.NET:21/p?x", ""),
    (20, "ftp://user@h.NET:21/p?x", ""),
    (21, "https://far.info/", link("https://helper.example.info/x")),
    (22, "a\n://b.net/\nline", None),
    (23, "https://?x", "<a href=https://bad.net>" + " word" * 100_000),
]


def test_rules_scores_and_verdicts(spark):
    got = run(spark, ROWS)
    assert got == brute(ROWS)
    verdict = {p: v for p, _, _, _, v in got}
    # who links to blocked hosts is blocked, and who links to such; who is trusted by good ones is not
    assert verdict[3] == verdict[4] == verdict[21] == "block" and verdict[7] == "allow"
    assert verdict[2] == verdict[14] == "block" and verdict[6] == verdict[11] == verdict[15] == "allow"


def test_longest_rule_and_empty(spark):
    assert rule_of("a.example.net", "/en/1") == ("example.net/en/", "allow")
    assert run(spark, []) == []
    assert host_trust.judge(spark.createDataFrame([(1, "https://a.net/", "")], "page_id int, url string, html string"), []).collect()[0].verdict == "allow"


def test_hub_and_chain(spark):
    chain = [(i, f"https://h{i}.info/", link(f"https://h{i + 1}.info/")) for i in range(6)]
    hub = [(100 + i, "https://hub.info/", link(*[f"https://h{j}.info/" for j in range(i, i + 60)])) for i in range(30)]
    rows = [*chain, *hub, (200, "https://h6.info/", link("https://bad.net/")), (201, "https://bad.net/", link("https://hub.info"))]
    assert run(spark, rows) == brute(rows)


def test_query_against_sql(spark, sf, tmp_path):
    name = "op12_url_filter"
    assert difference(spark, duck(sf), name, catalog.op12_url_filter, catalog.ORACLES[name], sf) is None
    path = as_tables(spark, tmp_path, pages=spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], PAGES).coalesce(1))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    assert difference(spark, con, name, catalog.op12_url_filter, catalog.ORACLES[name], path) is None
