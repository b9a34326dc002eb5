"""URL filters: fixed rules and mined rules against brute force."""

import random
import re
from itertools import combinations

from heliodor.llm import urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_tokens(url):
    host, path = parts(url)
    query = re.match(r".*?://[^?#]*\?([^#]*)", url or "", re.S)
    out = {"h:" + x for x in host.split(".")} | {"p:" + x for x in re.split("[^A-Za-z0-9]+", path)}
    out |= {"q:" + x.split("=")[0] for x in query[1].split("&")} if query else set()
    return {x for x in out if len(x) > 2}


def test_all(spark):
    rng = random.Random(2)
    pages = [(None, "http://a.org/x", "z"), (0, None, "z"), (1, "no scheme", "z"), (2, "http://EXAMPLE.com", "z"), (3, "https://WWW.example.com/en/a?b#c", "z"), (4, "http://x.example.com/en/q", "z"), (5, "http://ample.net/es", "z"), (6, "ftp://Ünet.net/fr/é", "z"), (7, "http://net/es/://x/", "z"), (8, "http://telecom/es/", "z"), (9, "http://?x#/", "z")]
    labels = []
    for i in range(10, 900):
        host = rng.choice(["a", "b", "bad", "spam"]) + "." + rng.choice(["example.org", "site.net", "z.io"])
        url = f"http://{host}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice(['win', 'news', 'shop'])}/{i}" + rng.choice(["", "?ref=1", "?a=1&b=2#t"])
        wrong = ("spam" in url and "win" in url) or ("bad.z" in url)
        pages.append((i, url, "z"))
        if rng.random() < 0.7:
            labels.append((i, int(rng.random() > (0.9 if wrong else 0.05)), int(rng.random() < 0.02)))
    labels += [(None, 0, 1), (12, None, None), (5000, 0, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, tokens string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    limits = {"min_support": 0.05, "min_rows": 15, "min_confidence": 0.6}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, marks, **limits).collect()}
    by_id = {i: u for i, u, _ in pages}
    rows = [(brute_tokens(by_id[i]), q == 0 or t == 1) for i, q, t in labels if i in by_id and i is not None and q is not None]
    bad = [t for t, b in rows if b]
    tokens = sorted({x for t in bad for x in t if sum(x in u for u in bad) >= 0.05 * len(bad)})
    found = []
    for size in range(1, 6):
        for items in combinations(tokens, size):
            items = set(items)
            if sum(items <= t for t in bad) >= 0.05 * len(bad):
                held = [b for t, b in rows if items <= t]
                if len(held) >= 15 and sum(held) >= 0.6 * len(held):
                    found.append(items)
    assert found
    for i, url, _ in pages:
        host, path = parts(url)
        rule, verdict = fixed(host, path)
        verdict = verdict or ("block" if any(r <= brute_tokens(url) for r in found) else "allow")
        assert got[i] == (host, path, rule, verdict), url
    assert any(v[2] is None and v[3] == "block" for v in got.values())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, marks).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(one, marks).collect()] == ["allow"]


def test_long_and_repeated_urls(spark):
    """Long urls and long token sets that many bad urls share are mined in bounded work; the rules are those of brute force."""
    shared = "/".join(f"w{i}" for i in range(60))
    pages = [(i, f"http://h{i % 7}.io/{shared}/" + ("x" if i % 3 else "y")) for i in range(30)]
    pages += [(100, "http://long.io/" + "/".join(f"z{i}" for i in range(1000)))] * 2
    pages += [(200 + i, f"http://ok.io/{'/'.join(f'g{j}' for j in range(i % 5))}/a{i}") for i in range(40)]
    pages += [(300, "http://q.io/w59/"), (301, f"http://q.io/{shared}/new")]
    labels = [(i, 1 if i >= 200 else 0, 0) for i in sorted({i for i, _ in pages if i < 300})]
    df, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(df, marks).collect()}
    rules = [x for x in sorted({x for _, u in pages for x in brute_tokens(u)}) if sum(x in brute_tokens(u) for i, u in pages if i < 200) >= 20 and not any(x in brute_tokens(u) for i, u in pages if 200 <= i < 300)]
    assert len(rules) > 60
    assert got == {i: "block" if set(rules) & brute_tokens(u) else "allow" for i, u in pages}
    assert got[300] == got[301] == "block"
