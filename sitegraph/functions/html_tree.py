"""Main text of HTML by a stack of open elements: nested and unclosed blocks are dropped as a tree has them.

The rule of ``functions.html.main_text`` drops a block up to the first end tag of its name, which is wrong for a block inside
one of its like. Here one pass over the page keeps the open elements. It runs in Python over Arrow batches, and reads each character a
fixed number of times, also in pages of unclosed tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.html import BLOCK_TAGS, DROPPED_TAGS, NAMED_ENTITIES, REFERENCE

DROPPED = frozenset(DROPPED_TAGS)
HEADINGS = {f"h{i}" for i in range(1, 7)}
BLOCKS = frozenset({tag for tag in BLOCK_TAGS if "[" not in tag} | HEADINGS)
# Elements without an end tag, and those whose content is text up to their end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset({"script", "style"})
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
AD_CLASS = re.compile(r"""\sclass\s*=\s*(?:"\s*ad\s*"|'\s*ad\s*'|ad(?=[\s/]|$))""", re.IGNORECASE)
REFERENCES = re.compile(REFERENCE)
BLANK_RUN = re.compile(r"\s+")
HELD_PAGES = 64


def decoded(match: re.Match) -> str:
    body = match.group()[1:-1]
    if not body.startswith("#"):
        return NAMED_ENTITIES.get(body, match.group())
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else match.group()


class Page:
    """The text of one page outside of dropped elements, block by block."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []  # name, and whether it is dropped
        self.counts: dict[str, int] = {}  # open elements by name
        self.dropped = 0
        self.parts: list[str] = []

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and not self.dropped:
            self.parts.append("\n")
        if name in VOID or attributes.endswith("/"):
            return
        drop = name in DROPPED or (name == "div" and AD_CLASS.search(attributes) is not None)
        self.open.append((name, drop))
        self.counts[name] = self.counts.get(name, 0) + 1
        self.dropped += drop

    def end(self, name: str) -> None:
        """Closes the innermost open element of the name, with all inside it; without one the tag means nothing but a break."""
        while self.counts.get(name):
            last, drop = self.open.pop()
            self.counts[last] -= 1
            self.dropped -= drop
            if last == name:
                break
        if name in BLOCKS and not self.dropped:
            self.parts.append("\n")

    def text(self, value: str) -> None:
        if not self.dropped:
            self.parts.append(BLANK_RUN.sub(" ", value))

    def lines(self) -> str:
        whole = REFERENCES.sub(decoded, "".join(self.parts))
        found = (BLANK_RUN.sub(" ", line).strip() for line in whole.split("\n"))
        return "\n".join(line for line in found if line)


def tree_text(page: str) -> str:
    """Main text of one page, a line per block."""
    out, at, size = Page(), 0, len(page)
    low = page.lower()
    if len(low) != size:  # a letter whose lower case is longer: only ASCII letters count in tags
        low = page.translate({c: c + 32 for c in range(65, 91)})
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        out.text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        close = page.find(">", start + 1)
        if close < 0:
            at = start
            break
        name = NAME.match(page, start + 1)
        if not name or name.end() > close:
            # A declaration goes, any other "<" is text.
            at = close + 1 if page.startswith("<!", start) else start + 1
            if at == start + 1:
                out.text("<")
            continue
        tag, at = name[1].lower(), close + 1
        if page[start + 1] == "/":
            out.end(tag)
            continue
        out.start(tag, page[name.end() : close])
        if tag in RAW and page[close - 1] != "/":
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else end
    out.text(page[at:])
    return out.lines()


def main_text_tree(html: Column) -> Column:
    """Main text of a column of pages; can stand in wherever an extractor is asked for. Null stays null."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # A few pages are held as text at a time, not a whole batch of them and their results.
            some = [batch.slice(at, HELD_PAGES) for at in range(0, len(batch), HELD_PAGES)]
            yield pa.concat_arrays([pa.array([], pa.string())] + [pa.array([page and tree_text(page) for page in part.to_pylist()], pa.string()) for part in some])

    return extract(html)
