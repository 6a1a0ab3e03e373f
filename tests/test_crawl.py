import random
from collections import defaultdict

from pyspark.sql import functions as F

from sitegraph.functions import urls
from sitegraph.functions.text import let
from sitegraph.operators import crawl, links
from sitegraph.sources import captures as cap

SITE = "https://s.com/"


def breadth_first(graph, seed, max_depth, max_pages):
    """Level by level; the page limit is tested before a level."""
    found, level, depth = {seed: 0}, [seed], 0
    done = 0
    while level and depth < max_depth:
        done += len(level)
        if done >= max_pages:
            break
        depth += 1
        level = sorted({t for u in level for t in graph[u] if t not in found})
        found.update((t, depth) for t in level)
    return found


def random_graph(hub):
    rng = random.Random(7)
    graph = defaultdict(set)
    names = [f"{SITE}{i}" for i in range(120)]
    for _ in range(260):
        graph[rng.choice(names)].add(rng.choice(names))
    if hub:  # one page holds a third of all links
        graph[names[0]].update(names[:90])
    return names, graph


def tables(spark, names, graph, seeds):
    edges = spark.createDataFrame([(a, b) for a in graph for b in graph[a]], "src string, dst string")
    return spark.createDataFrame([(s,) for s in seeds], "url string"), edges


def test_many_seeds_like_a_plain_walk(spark):
    for hub, max_depth, max_pages in [(False, 3, 1000), (True, 2, 30), (True, 5, 7)]:
        names, graph = random_graph(hub)
        seeds = names[:6]
        got = defaultdict(dict)
        for row in crawl.crawl_bfs(*tables(spark, names, graph, seeds), max_depth, max_pages).collect():
            assert row.url not in got[row.seed]
            got[row.seed][row.url] = row.depth
        assert got == {s: breadth_first(graph, s, max_depth, max_pages) for s in seeds}


def test_strict_limit_cuts_the_last_level(spark):
    names, graph = random_graph(True)
    rows = crawl.crawl_bfs(*tables(spark, names, graph, names[:1]), 3, 20, strict=True).collect()
    whole = breadth_first(graph, names[0], 3, 20)
    assert {(r.url, r.depth) for r in rows} == set(sorted(whole.items(), key=lambda p: (p[1], p[0]))[:20])


def test_large_frontier_is_not_broadcast(spark, monkeypatch):
    names, graph = random_graph(True)
    monkeypatch.setattr(crawl, "sized_side", lambda df: df)
    rows = crawl.crawl_bfs(*tables(spark, names, graph, names[:2]), 3, 1000).collect()
    assert {(r.seed, r.url, r.depth) for r in rows} == {
        (s, u, d) for s in names[:2] for u, d in breadth_first(graph, s, 3, 1000).items()
    }


def test_frontier_leaves_out_what_is_known(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("b", "d")], "src string, dst string")
    state = spark.createDataFrame([("a", "a", 0), ("a", "c", 1)], "seed string, url string, depth int")
    assert crawl.crawl_frontier(state, edges, 0).collect() == [("a", "b", 1)]


def test_links_of_a_page(spark):
    page = """
    <ul><li><a href="/garden/roses">Roses</a></li><li><a href='https://plants.test/garden/herbs/'>Herbs</a></li>
    <li><a href=https://seeds.test/shop>Shop</a></li></ul><a href="javascript:open()">o</a><a href="tel:55">t</a>
    <a href="mailto:x@plants.test">m</a><a href="#list">l</a><a href="/garden/roses#red">red</a>
    """
    for base in ("https://plants.test", "https://www.plants.test/"):
        rows = links.html_links(spark.createDataFrame([(base, page)], "url string, content string")).collect()
        assert {r.dst for r in rows} == {"https://plants.test/garden/roses", "https://plants.test/garden/herbs"}
        assert {r.src for r in rows} == {"https://plants.test"}


def test_edges_prefer_the_captured_list(spark):
    anchors = '<a href="/from-html">x</a>'
    rows = [
        (1, "https://a.com/1", anchors, None, None),
        (2, "https://a.com/2", anchors, [], None),
        (3, "https://a.com/3", anchors, ["https://www.a.com/x/#f", "/relative", "tel:1", "https://b.com/y", "https://a.com/x"], None),
        (4, "https://a.com/4", anchors, ["https://a.com/z"], "timeout"),
    ]
    raw = spark.createDataFrame(rows, "page_id long, url string, html string, links array<string>, error string").select(
        "*", F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    fetches = cap.load_fetches(raw)
    assert {tuple(r) for r in links.page_edges(fetches).collect()} == {
        ("https://a.com/1", "https://a.com/from-html"), ("https://a.com/3", "https://a.com/x"),
    }
    assert [(r.host, r.error, r.failures) for r in cap.failures_per_host(fetches).collect()] == [("a.com", "scrape failed: timeout", 1)]


def test_duplicates(spark):
    df = spark.createDataFrame([(3, "https://www.a.com/x/"), (1, "https://a.com/x#f"), (2, "https://a.com/y")], "page_id long, url string")
    assert {tuple(r) for r in links.duplicate_urls(df).collect()} == {("https://a.com/x", 1, 2), ("https://a.com/y", 2, 1)}


def test_progress(spark):
    state = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("a", "c", 1)], "seed string, url string, depth int")
    fetches = spark.createDataFrame([("a", None), ("b", "boom")], "url string, error string")
    rows = [tuple(r) for r in crawl.crawl_progress(state, fetches).orderBy("depth").collect()]
    assert rows == [(0, 1, 1, 0, 2, 1), (1, 2, 0, 2, 0, 3)]


def test_whole_chain_without_limits(spark):
    steps = [f"https://a.com/{i}" for i in range(30)]
    edges = spark.createDataFrame([*zip(steps, steps[1:]), (steps[-1], steps[0])], "src string, dst string").repartition(2).cache()
    seeds = spark.createDataFrame([(steps[0],)], "url string")
    reached = crawl.crawl_bfs(seeds, edges, max_depth=None, max_pages=None)
    assert {(r.url, r.depth) for r in reached.collect()} == {(url, i) for i, url in enumerate(steps)}


def test_resumed_crawl_is_a_fresh_one(spark):
    """New links lower depths far away, open new parts and close cycles; new seeds join."""
    for seed, max_depth in [(1, None), (2, 4), (3, 2), (4, None)]:
        draw = random.Random(seed)
        names = [f"{SITE}{i}" for i in range(90)]
        chain = list(zip(names[:30], names[1:31]))
        old = chain + [(draw.choice(names), draw.choice(names)) for _ in range(60)]
        new = [(draw.choice(names), draw.choice(names)) for _ in range(12)] + [(names[2], names[25]), (names[25], names[0])]
        frames = [spark.createDataFrame(rows, "src string, dst string").distinct() for rows in (old, new, old + new)]
        seeds = [spark.createDataFrame([(n,) for n in some], "url string") for some in (names[:2], names[40:41], [*names[:2], names[40]])]
        state = crawl.crawl_bfs(seeds[0], frames[0], max_depth=max_depth, max_pages=None)
        resumed = crawl.resume_crawl(state, frames[1], frames[2], seeds[1], max_depth)
        fresh = crawl.crawl_bfs(seeds[2], frames[2], max_depth=max_depth, max_pages=None)
        got, want = (sorted(map(tuple, df.select("seed", "url", "depth").collect())) for df in (resumed, fresh))
        assert got == want


def test_resumed_crawl_walks_only_what_changed(spark, monkeypatch):
    steps = [f"https://a.com/{i}" for i in range(40)]
    edges = spark.createDataFrame(list(zip(steps, steps[1:])), "src string, dst string").cache()
    state = crawl.crawl_bfs(spark.createDataFrame([(steps[0],)], "url string"), edges, max_depth=None, max_pages=None)
    new = spark.createDataFrame([(steps[30], "https://a.com/new"), (steps[39], steps[0])], "src string, dst string")
    walked = []
    real = crawl.join_side
    monkeypatch.setattr(crawl, "join_side", lambda df: (walked.append(df.count()), real(df))[1])
    got = crawl.resume_crawl(state, new, edges.unionByName(new)).collect()
    assert {(r.url, r.depth) for r in got} == {*((u, i) for i, u in enumerate(steps)), ("https://a.com/new", 31)}
    assert sum(walked) <= 2


def test_resume_without_news_and_stored_states(spark):
    edges = spark.createDataFrame([("https://a.com/1", "https://a.com/2")], "src string, dst string")
    state = crawl.crawl_bfs(spark.createDataFrame([("https://a.com/1",)], "url string"), edges)
    same = crawl.resume_crawl(state, edges.limit(0), edges)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, state.collect()))
    fetches = spark.createDataFrame([("https://a.com/1", None), ("https://a.com/1", "boom")], "url string, error string")
    rows = {r.url: r.status for r in crawl.crawl_state(state, fetches).collect()}
    assert rows == {"https://a.com/1": "fetched", "https://a.com/2": "pending"}


def test_resumed_crawl_stores_what_it_finds_once(spark, monkeypatch):
    steps = [f"https://a.com/{i}" for i in range(12)]
    edges = spark.createDataFrame([*zip(steps, steps[1:]), (steps[0], steps[0])], "src string, dst string").cache()
    old, new = edges.where("src = dst"), edges.where("src <> dst")
    state = crawl.crawl_bfs(spark.createDataFrame([(steps[0],)], "url string"), old, max_depth=None, max_pages=None)
    stored = []

    def counted(real):
        def store(df, *args, **kwargs):
            stored.append(df.count())
            return real(df, *args, **kwargs)
        return store

    for name in ("cut_lineage", "join_side", "write_stage"):
        monkeypatch.setattr(crawl, name, counted(getattr(crawl, name, None)), raising=False)
    got = crawl.resume_crawl(state, new, edges)
    assert {(r.url, r.depth) for r in got.collect()} == {(u, i) for i, u in enumerate(steps)}
    # What the new links reach from the state at once is one row; every other URL is stored with its level.
    assert sum(stored) <= 1 + len(steps) - 1


def test_url_of_a_page_is_worked_out_once_per_page(spark):
    pages = spark.createDataFrame([("https://a.com/1/?b=1", ["https://a.com/2"])], "url string, targets array<string>").cache()
    found = links._edges(pages)
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)[0]
    assert "regexp" not in above
    assert [tuple(r) for r in found.collect()] == [("https://a.com/1/?b=1", "https://a.com/2")]


def test_plain_urls_take_the_short_way_to_the_same_form(spark):
    sites = ["a.com", "www.a.com", "www.www.a.com", "www.", "www", "A.com", "a.com:80", "", ".", "u@a.com", "é.com", "a..com"]
    paths = ["", "/", "//", "/x", "/x/", "/x//", "/x//y", "/X/y.html", "/x;", "/x;/", "/x?b=2&a=1", "/x#f", "/#f", "/x\n", "/x y", "/%7Ex", "/./x", "/../x", "/~x", "?q=1", "/x\n/"]
    raw = [f"{scheme}{site}{path}" for scheme in ("https://", "http://", "HTTP://", "ftp://", "//", " https://", "") for site in sites for path in paths]
    rows = [(u, ("https:", "https://www.b.com", "/d/e", "/d/", "?q=1")) for u in [*raw, None]]
    df = spark.createDataFrame(rows, "u string, base struct<scheme: string, origin: string, path: string, folder: string, query: string>")
    found = df.cache().select(
        "u", urls.canonical_url(F.col("u")).alias("got"), let(urls.clean_url(F.col("u")), urls._canonical).alias("want"),
        urls.canonical_target(F.col("base"), F.col("u")).alias("target"),
        let(urls.clean_url(urls.resolve(F.col("base"), F.col("u"))), urls._canonical).alias("resolved"),
    )
    for row in found.collect():
        assert (row.got, row.target) == (row.want, row.resolved), row.u


def test_links_to_the_same_site_in_any_spelling(spark):
    targets = [f"{scheme}://{site}/x" for scheme in ("http", "https") for site in ("a.com", "www.a.com", "www.www.a.com", "A.com", "a.com.b.com", "b.com")]
    pages = spark.createDataFrame([(f"https://{site}/p", [*targets, "/y", "?q=1"]) for site in ("WWW.a.com", "www.www.a.com")], "url string, targets array<string>")
    a, wwwa = "https://a.com", "https://www.a.com"
    assert {tuple(r) for r in links._edges(pages.cache()).collect()} == {
        *((f"{a}/p", u) for u in ("http://a.com/x", f"{a}/x", "http://www.a.com/x", f"{wwwa}/x", f"{a}/y", f"{a}/p?q=1")),
    }
