import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import html, html_tree, text
from sitegraph.operators import pages


def run(spark, value, rule):
    return spark.createDataFrame([(value,)], "t string").select(rule(F.col("t")).alias("r")).first().r


MARKDOWN = {
    "a\r\nb\rc": "a\nb\nc",
    "## Head\n### Sub": "Head\nSub",
    "**b** *i* __B__ _I_": "b i B I",
    "[text](http://x.y)": "text",
    "- one\n* two\n+ three": "• one\n• two\n• three",
    "1. one\n22. two": "one\ntwo",
    "a ```x\ny``` b `c`": "a b c",
    "> quote": "quote",
    "x\n---\ny": "x\n\ny",
    "a\tb   c": "a b c",
    "a\n\n\n\n\nb": "a\n\nb",
    "١. arabic digit": "arabic digit",
    "- no-break blank": "• no-break blank",
    "line * not a new line*": "line  not a new line",
}


@pytest.mark.parametrize("source", MARKDOWN)
def test_markdown_rules(spark, source):
    assert run(spark, source, text.markdown_to_text) == MARKDOWN[source]


VOLATILE = {
    "What is 7 + 6? ok then": "ok then",
    "at 14:32:45 today": "at  today",
    "on 2024-01-02 10:11:12 it": "on 2024-01-02  it",
    "Last updated: 15 May 2025 rest": "rest",
    "Updated: January 15, 2025 rest": "rest",
    "id 123e4567-e89b-12d3-a456-426614174000 end": "id  end",
    "x" + "a1" * 16 + "y z": "xy z",
    "h " + "0f" * 32 + " end": "h  end",
    "long ordinarywordwithoutend here": "long  here",
    "session_id=abc9 and Token: x1 end": "and  end",
    "go javascript:void(0) now": "go  now",
    "keep this\n12345\nabc\ndeadbeef\n\n  spaced  ": "keep this\nspaced",
    "éabcdefghijklmnopq kept": "éabcdefghijklmnopq kept",
    "٣٤\nline": "line",
}


@pytest.mark.parametrize("source", VOLATILE)
def test_volatile_rules(spark, source):
    assert run(spark, source, text.scrub_volatile) == VOLATILE[source]


def test_unicode_rules_agree_with_python(spark):
    odd = ["a\u0085b  c　 d\n\x1c- x\n", "é٣:٤٥:٦٧ 1:22:33", "_a b_ *c\n*d* ```x ```", " # not\n#  yes  ",
           "ſession_id=aſ token: K", "١٢٣٤-٠١-٠٢ 10:11:12", "x" * 15 + "é", "abcdefghijklmnop_", "abcdefghijklmnoṕ"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    steps = [*rules.MARKDOWN_RULES, *rules.VOLATILE_RULES, *rules.LINE_LEFTOVERS]
    rows = df.select(*[text.replace_all(F.col("t"), [step]).alias(f"r{i}") for i, step in enumerate(steps)]).collect()
    for i, (pattern, replacement, *_) in enumerate(steps):
        assert [row[i] for row in rows] == [re.sub(pattern, replacement, t, flags=re.MULTILINE) for t in odd], pattern
    stripped = [r.r for r in df.select(text.strip(F.col("t")).alias("r")).collect()]
    assert stripped == [t.strip() for t in odd]
    split = [r.r for r in df.select(text.words(F.col("t")).alias("r")).collect()]
    assert split == [t.split() for t in odd]


def test_quality_lines(spark):
    long = "x" * 60
    source = "\n".join(["short", f"  {long}  ", f"[{'l' * 55}](http://a.b)", f"![]({'u' * 60})", "=" * 60, f"![alt](u) {long}"])
    row = pages.quality_lines(spark.createDataFrame([(source,)], "text string")).first()
    assert row.quality_text == "\n\n".join([long, "l" * 55, f"!alt {long}"])
    assert (row.kept, row.dropped) == (3, 3)


def test_main_text_and_title(spark):
    page = (
        "<html><head><title> T &amp;amp; &#8364;&#x41;\n x</title><script>var a='</p>';</script></head><body>"
        "<nav>n<a href='/x'>y</a></nav><!-- <script> --><div class=\"ad\">ad</div><p>Hello  <b>w</b>orld&nbsp;x<br>line2"
        "<table><tr><td>t</td></tr></table><p>last &lt;b&gt; &unknown; &#0;<footer>f</footer>"
    )
    assert run(spark, page, html.main_text) == "Hello world x\nline2\nlast <b> &unknown; &#0;"
    assert run(spark, page, html.html_title) == "T &amp; €A x"
    assert run(spark, "<p>no title", html.html_title) == ""


def test_hrefs(spark):
    page = "<a href=\"/a\">A</a><a class=x href='/b?x=1&amp;y=2'><A HREF=/c>C</A><abbr href='no'><a data-href='/no' href='/yes'>"
    assert run(spark, page, html.hrefs) == ["/a", "/b?x=1&y=2", "/c", "/yes"]


def test_title_chain(spark):
    rows = [
        ("u1", "<title>h</title>", "# m", {"title": " t "}, "t", "metadata"),
        ("u2", "<title>h</title>", "x\n  # m  \n# n", {"title": " "}, "m", "markdown"),
        ("u3", "<title>h</title>", "## m", {}, "h", "html"),
        ("u4", "", "#m", {}, "u4", "url"),
    ]
    df = spark.createDataFrame(rows, "url string, content string, markdown string, metadata map<string,string>, want string, won string")
    assert [(r.title, r.title_source) for r in pages.page_titles(df).collect()] == [(r[4], r[5]) for r in rows]


def test_page_without_long_lines_has_no_text(spark):
    """An extraction that finds only short lines does not fall back to the markdown."""
    df = spark.createDataFrame(
        [(1, "u", "<p>short</p>", "markdown text", {}, [], None, None), (2, "v", "", "markdown text", {}, [], None, None)],
        "page_id long, url string, content string, markdown string, metadata map<string,string>, links array<string>, "
        "error string, fetched_at timestamp",
    )
    found = {r.url: r.clean_text for r in pages.page_documents(df).collect()}
    assert found == {"u": "", "v": "Page URL: v\nPage Title: v\n\nmarkdown text"}


def test_metadata(spark):
    df = spark.createDataFrame([('{"page_type":"blog","k":1}',), ("",), ("{bad",), (None,), ('{"k":2}',)], "metadata string")
    rows = pages.page_metadata(df, "k long, page_type string").collect()
    assert [r.page_type for r in rows] == ["blog", "other", "other", "other", "other"]
    assert [r.fields and r.fields.k for r in rows] == [1, None, None, None, 2]


def test_free_metadata(spark):
    rows = [('{"page_type":"blog","a":{"b":[1,{"c":"x"}]},"n":1.5}',), ("[1,2]",), ("{bad",), (None,), ("",), ('"text"',), ("{}",), ('{"page_type":7}',)]
    found = pages.page_metadata_free(spark.createDataFrame(rows, "metadata string"))
    got = found.select("page_type", "keys", F.try_variant_get("free", "$.a.b[1].c", "string").alias("c"), F.col("free").isNull().alias("lost"), F.to_json("free").alias("whole")).collect()
    assert [r.page_type for r in got] == ["blog", "other", "other", "other", "other", "other", "other", "7"]
    assert [r["keys"] for r in got] == [["a", "n", "page_type"], [], [], [], [], [], [], ["page_type"]]
    assert got[0].c == "x" and [r.lost for r in got] == [False, False, True, True, True, False, False, False]
    assert got[0].whole == '{"a":{"b":[1,{"c":"x"}]},"n":1.5,"page_type":"blog"}'


PIECES = ["<nav>", "<nav ", "</nav>", "</NAV >", "<!--", "-->", "<table>", "</table>", "<div class='ad'>", "<div>", "</div>", "text ", "\n", " ", ">",
          "<p>", "<b", "İ", "<script", "</script>", "<", "<navx>"]


def plain_main_text(page):
    """The same rule in one place, with the library's patterns in another regex engine."""
    flat = re.sub(r"\s+", " ", page)
    for pattern, put in ((html.DROPPED_BLOCKS, ""), (html.BLOCK_BREAKS, "\n"), (html.ANY_TAG, "")):
        flat = re.sub(pattern, put, flat)
    return "\n".join(line for line in (part.strip() for part in re.sub("[^\\S\n]+", " ", flat).split("\n")) if line)


def test_broken_pages_as_the_patterns_say(spark):
    draw = random.Random(4)
    made = ["".join(draw.choices(PIECES, k=draw.randint(1, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(p,) for p in made], "h string").select("h", html.main_text(F.col("h")).alias("t")).collect()
    assert [(r.h, r.t, plain_main_text(r.h)) for r in rows if r.t != plain_main_text(r.h)] == []


def test_markdown_as_the_patterns_say(spark):
    draw = random.Random(5)
    made = ["".join(draw.choices(["\n" * text.LONG_RUN, " " * text.LONG_RUN, "- ", "* ", "1. ", "> ", "\n", " ", "x", "12.", "-", "\n\n", "+ ", "a b", "# "], k=draw.randint(1, 20))) for _ in range(3000)]
    rows = spark.createDataFrame([(m,) for m in made], "m string").select("m", text.markdown_to_text(F.col("m")).alias("t")).collect()

    def plain(value):
        for pattern, put, *_ in rules.MARKDOWN_RULES:
            value = re.sub("(?m)" + pattern, put, value)
        return value

    assert [(r.m, r.t, plain(r.m)) for r in rows if r.t != plain(r.m)] == []


@pytest.mark.parametrize("unit", ["<nav>", "<!-- ", "<p ", "<div class='ad'> ", " \n", "- \n\n", "["])
def test_time_grows_with_the_text(spark, unit):
    rule = html.main_text if "<" in unit else text.markdown_to_text
    frames = [spark.createDataFrame([(unit * (size // len(unit)),)], "t string") for size in (100_000, 1_600_000)]
    times = []
    for frame in frames:
        start = time.perf_counter()
        frame.select(F.length(rule(F.col("t")))).collect()
        times.append(time.perf_counter() - start)
    assert times[1] < 8 + 32 * times[0]  # 16 times the text; by the square it would be 256 times


def test_entities(spark):
    page = "<title>Caf&eacute; &times; M&uuml;ller &rarr; &#000000065; &#x0041; &amp;lt; &#38;lt; &bogus; &amp x&nbsp;y &#xD800;</title>"
    assert run(spark, page, html.html_title) == "Café × Müller → A A &lt; &lt; &bogus; &amp x\xa0y &#xD800;".replace("\xa0", "\xa0")


class Plain(HTMLParser):
    """The same rule by the standard library's parser, as a tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.parts = [], []

    def handle_starttag(self, tag, attributes):
        if tag in html_tree.BLOCKS and not any(d for _, d in self.stack):
            self.parts.append("\n")
        if tag not in html_tree.VOID:
            self.stack.append((tag, tag in html_tree.DROPPED or (tag == "div" and (dict(attributes).get("class") or "").strip().lower() == "ad")))

    def handle_endtag(self, tag):
        if tag in [name for name, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
        if tag in html_tree.BLOCKS and not any(d for _, d in self.stack):
            self.parts.append("\n")

    def put(self, value):
        if not any(d for _, d in self.stack):
            self.parts.append(" ".join(re.split(r"\s+", value)))

    handle_data = put

    def handle_entityref(self, name):
        self.put({"amp": "&", "lt": "<"}.get(name, f"&{name};"))


def plain_tree(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return "\n".join(line for line in (" ".join(part.split()) for part in "".join(parser.parts).split("\n")) if line)


def test_tree_text_of_nested_and_unclosed_blocks(spark):
    pages_of = {
        "<div class='ad'>x<div>inner</div>still ad</div>kept": "kept",
        "<table><tr><td><table><tr><td>a</td></tr></table>b</td></tr></table><p>c": "c",
        "<div><nav>open<p>gone</div>after": "after", "<nav>all is gone": "", "a</nav>b": "ab", "<p>1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "<script>if (a<b) x='<p>';</script>y": "y", "<style>p{}": "", "a<!-- <nav> -->b<!-- open": "ab", "<DIV CLASS=\"ad\">x</DIV>y<br/>z": "y\nz",
        "<form>a<form>b</form>c</form>d &amp;lt; &bogus;": "d &lt; &bogus;", "<h2>T</h2>\u0130<P>x": "T\n\u0130\nx",
    }
    frame = spark.createDataFrame([*((p,) for p in pages_of), (None,)], "h string")
    got = {r.h: r.t for r in frame.select("h", html_tree.main_text_tree(F.col("h")).alias("t")).collect()}
    assert got == {**pages_of, None: None}


def test_tree_text_as_a_plain_parser_has_it():
    draw = random.Random(8)
    pieces = ["<nav>", "</nav>", "<table>", "</table>", "<div class='ad'>", "<div>", "</div>", "text ", "\n", "<p>", "</p>", "<br>", "<form>", "</form>", "&amp;", "<b>", "</b>", "<!-- x -->", "word", "<li>"]
    for _ in range(4000):
        page = "".join(draw.choices(pieces, k=draw.randint(1, 30)))
        assert html_tree.tree_text(page) == plain_tree(page), page


@pytest.mark.parametrize("unit", ["<nav>", "<!-- ", "<p ", "<", "</div>", "<div>", "<script>", "&amp;", "<a></b>"])
def test_tree_text_is_linear(unit):
    start = time.perf_counter()
    html_tree.tree_text(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - start < 20


def test_tree_text_is_made_in_small_steps(spark, monkeypatch):
    """A batch of pages is worked through in steps, whose number does not show in the result."""
    pages = [None, "", "no tag"] + [f"<p>page {i}</p><nav>gone</nav><p>end" for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, h string").coalesce(1)
    for held in (1, 7, 64):
        monkeypatch.setattr(html_tree, "HELD_PAGES", held)
        got = dict(frame.select("i", html_tree.main_text_tree(F.col("h")).alias("t")).collect())
        assert [got[i] for i in range(23)] == [None, "", "no tag"] + [f"page {i}\nend" for i in range(20)]
    assert frame.where("i < 0").select(html_tree.main_text_tree(F.col("h"))).collect() == []
