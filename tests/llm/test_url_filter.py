import re

from marketlens.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/x", "https://www.example.com/en/x?q=1#z", "http://a.www.example.com/en/", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "ftp://casino-win.org/de/1", "http://cheap-pills.example.org/", "http://cheap.org/", "http://essexxxx.org", "http://xxx.org/a",
    "http://win.win.org/free", "http://a.org/?free=bets", "http://É.org/Casino", "http://com/", "http://com", "x://y://casino.org",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = host.translate(low)
    fits = [(len(r), r, v) for v, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, default=None)
    found = {t for t in (*U.STRICT, *U.SOFT) if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", (url or "").translate(low))}
    bad = any(t in U.STRICT for t in found) or sum(t in U.SOFT for t in found) >= U.SOFT_NEEDED
    return host, path, rule[1] if rule else None, rule[2] if rule else "block" if bad else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine", 3) for i, u in enumerate([*URLS, *URLS])], "page_id int, url string, host string, weight int")
    got = {(r.page_id, r.host, r.path, r["rule"], r.verdict) for r in U.judge(pages).collect()}
    assert got == {(i, *brute(u)) for i, u in enumerate([*URLS, *URLS])}


def test_smallest_table(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = U.query(spark, folder).collect()
    assert {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in rows} == {i: brute(u) for i, u in urls.items()}


def test_counts_and_empty(spark):
    assert U.terms_in("free-free.win/casinos/casino", U.automaton(U.vocabulary())) == {"free": 2, "win": 1, "casino": 1}
    assert U.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0
