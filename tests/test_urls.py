import random
from urllib.parse import parse_qsl, urljoin, urlsplit

from pyspark.sql import functions as F

from sitegraph.functions import urls


def canonical(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    found = rows.select("i", urls.canonical_url(F.col("u")).alias("c")).orderBy("i").collect()
    return [row.c for row in found]


def valued_pairs(url):
    """Pairs of the query that have a value, in any order."""
    return sorted(pair for pair in parse_qsl(urlsplit(url.strip()).query))


def check(url, found):
    """What holds for every canonical URL, whatever it looked like."""
    was, now = urlsplit(url.strip()), urlsplit(found)
    assert now.fragment == "" and now.scheme == was.scheme
    assert now.netloc in (was.netloc.lower(), was.netloc.lower().removeprefix("www."))
    assert not now.netloc.startswith("www.") or was.netloc.lower().startswith("www.www.")
    assert valued_pairs(found) == valued_pairs(url)
    keys = [key for key, _ in parse_qsl(now.query)]
    assert keys == sorted(keys)
    assert now.query or not found.endswith("/")
    assert now.path.rstrip("/;") == was.path.rstrip("/;")


def test_documented_cases(spark):
    cases = {
        "https://Example.com/page/#section?param=value": "https://example.com/page",
        "https://example.com/page/": "https://example.com/page",
        "https://www.site.com/notes/part/3/?draft": "https://site.com/notes/part/3",
        "HTTP://WWW.Ex.com:80/A/?b=2&a=1&a=0&c=": "http://ex.com:80/A/?a=1&a=0&b=2",
        "https://e.com/?q=a+b&x=%7E*~%zz&y=é": "https://e.com/?q=a+b&x=~%2A~%25zz&y=%C3%A9",
        "https://user:Pw@www.e.com/;p?x=y": "https://user:pw@www.e.com/;p?x=y",
        "https://wwwwww.e.com///": "https://wwwwww.e.com",
        " https://e.com/x\n": "https://e.com/x",
        "https://": "https://",
        "/": "/",
        "": "",
    }
    assert canonical(spark, list(cases)) == list(cases.values())


def test_all_page_urls_keep_what_they_name(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select("url", urls.canonical_url(F.col("url")).alias("c")).collect()
    for row in rows:
        check(row.url, row.c)


def test_random_urls(spark):
    rng = random.Random(11)

    def part(size=6):
        return "".join(rng.choice("abZ0 -_.~+*é&=;/%") for _ in range(rng.randrange(size)))

    hosts = ["a.com", "WWW.b.org", "www.c.net:81"]
    made = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}/{part()}?{part(9)}#{part()}" for _ in range(3000)]
    found = canonical(spark, made)
    for url, got in zip(made, found):
        check(url, got)
    settled = [url for url in found if ";" not in url]  # an empty parameter list goes one at a time
    assert canonical(spark, settled) == settled


def test_resolve_like_a_browser(spark):
    bases = ["https://example.com/a/b/c.html?x=1", "https://example.com", "https://example.com/d/", "http://w.com/a//b/"]
    refs = ["x", "/x", "../x", "./x", "../../../x", "?q=1", "//o.com/y", "https://z.com/a/../b", "", "x/../y/", "..", ".",
            "a//b", "/a/../b", "/a//b?q=../c", "x?y=/../z", "/", "tel:1", "g;x=1/../y"]
    df = spark.createDataFrame([(b, r, urljoin(b, r)) for b in bases for r in refs], "b string, r string, want string")
    rows = df.select("*", urls.resolve(urls.base_parts(F.col("b")), F.col("r")).alias("got")).collect()
    assert [row for row in rows if row.got != row.want] == []


def test_host_and_crawlable(spark):
    df = spark.createDataFrame(
        [("https://WWW.wwe.com/x",), ("http://e.com:80?x",), ("javascript:void(0)",), ("tel:+1",), ("/rel",)], "u string"
    )
    rows = df.select(urls.host(F.col("u")).alias("h"), urls.is_crawlable(F.col("u")).alias("c")).collect()
    assert [(r.h, r.c) for r in rows] == [("wwe.com", True), ("e.com:80", True), ("", False), ("", False), ("", False)]
