"""Column rules for HTML: main text, title, hrefs and entities. All run JVM-side."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.text import BLANKS, LINE_BLANKS, let, strip

DROPPED_TAGS = ["script", "style", "head", "nav", "footer", "aside", "form", "table"]
BLOCK_TAGS = ["p", "div", "section", "article", "main", "header", "h[1-6]", "ul", "ol", "li", "dl", "dt",
              "dd", "br", "hr", "pre", "blockquote", "figure", "figcaption", "title"]
# The standard library's table of names that end with a semicolon.
NAMED_ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
# One pass drops whichever block starts first, so a comment that mentions a tag cannot open a block.
DROPPED_BLOCKS = "(?is)" + "|".join(
    ["<!--.*?-->"]
    + [rf"<{tag}(?:[\s/][^>]*)?>.*?</{tag}\s*>" for tag in DROPPED_TAGS]
    + [r"<div\s[^>]*class=[\"']ad[\"'][^>]*>.*?</div\s*>"]
)
BLOCK_BREAKS = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?>"
ANY_TAG = r"(?s)</?[a-zA-Z!][^>]*>"
HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"


REFERENCE = r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decode_entities(text: Column) -> Column:
    """Named entities and decimal or hexadecimal references, each decoded once: ``&amp;lt;`` becomes ``&lt;``."""
    return let(text, lambda t: F.when(F.rlike(t, F.lit(REFERENCE)), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    # Each piece after the first starts with a reference: decode it and keep the rest.
    names = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});", 1)
        hexits = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", F.hex(digits.cast("long"))).otherwise(hexits)
        number = F.conv(code, 16, 10).cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        name = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]+);", 1)
        found = F.when(F.startswith(piece, F.lit("&#")), F.when(valid, char)).otherwise(F.try_element_at(names, name))
        rest = F.substring(piece, F.instr(piece, ";") + 1, F.char_length(piece))
        return F.when(F.startswith(piece, F.lit("&")) & found.isNotNull(), F.concat(found, rest)).otherwise(piece)

    return F.array_join(F.transform(F.split(text, f"(?={REFERENCE})"), decoded), "")


def _before_last(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """Changes the text up to its last ``mark``. Behind it no pattern that needs the mark can match, so none has to look."""

    def split(value: Column) -> Column:
        tail = F.substring_index(value, mark, -1)
        size = F.char_length(value) - F.char_length(tail)
        return F.concat(change(F.substring(value, F.lit(1), size)), tail)

    return let(text, lambda value: F.when(F.contains(value, F.lit(mark)), split(value)).otherwise(value))


# A character that no page holds; it stands behind a "<" that opens nothing.
CLOSED = "\uffff"


def _without_blocks(page: Column) -> Column:
    """Drops comments, dropped tags and advertisements with all that is inside.

    An opening tag behind the last closing one of its name opens no block. Such tags are marked first, tag by
    tag, so the one pass over the page never looks for an end that is not there: linear in the page.
    """
    rows = [("<!--", "-->", "(?=!--)")] + [(f"<{tag}", f"</{tag}", rf"(?={tag}[\s/>])") for tag in DROPPED_TAGS] + [("<div", "</div", r"(?=div\s)")]
    # One expression for all tags, so that the plan stays small.
    tags = F.array(*[F.struct(*[F.lit(part).alias(name) for name, part in zip(("start", "end", "ahead"), row)]) for row in rows])
    # Most pages close all they open: one look at the lowered page spares them the marks.
    unclosed = let(F.lower(page), lambda low: F.exists(tags, lambda tag: _is_unclosed(low, tag["start"], tag["end"], tag["ahead"])))
    marked = F.aggregate(tags, page, lambda value, tag: let(value, lambda text: _marked(text, tag["start"], tag["end"], tag["ahead"])))
    dropped = F.regexp_replace(F.when(unclosed, marked).otherwise(page), DROPPED_BLOCKS, "")
    return F.replace(dropped, F.lit(CLOSED), F.lit(""))


def _after_last(text: Column, end: Column) -> Column:
    """What stands behind the last ``end``; the whole text if there is none."""
    return F.call_function("substring_index", text, end, F.lit(-1))


def _is_unclosed(low: Column, start: Column, end: Column, ahead: Column) -> Column:
    """Whether an opening tag stands behind the last closing one of its name."""

    def opens(tail: Column) -> Column:
        return F.contains(tail, start) & F.rlike(tail, F.concat(F.lit("<"), ahead))

    return F.contains(low, start) & let(_after_last(low, end), opens)


def _marked(page: Column, start: Column, end: Column, ahead: Column) -> Column:
    # Only ASCII letters are lowered, so that places stay the same.
    low = F.translate(page, ascii_uppercase, ascii_lowercase)
    # From here on there is no end; a longer name that starts alike only makes the marked part shorter.
    tail = F.char_length(_after_last(low, end))

    def with_marks(size: Column) -> Column:
        behind = F.regexp_replace(F.substring(page, F.char_length(page) - size + 1, size), F.concat(F.lit("(?i)<"), ahead), F.lit(f"<{CLOSED}"))
        return F.concat(F.substring(page, F.lit(1), F.char_length(page) - size), behind)

    return F.when(F.contains(low, start), let(tail, with_marks)).otherwise(page)


def main_text(html: Column) -> Column:
    """Main content, one line per block, without comments, tables, navigation or advertisements."""
    flat = F.regexp_replace(html, f"[{BLANKS}]+", " ")
    kept = let(flat, lambda page: F.when(F.contains(page, F.lit("<")), _without_blocks(page)).otherwise(page))
    broken = _before_last(kept, ">", lambda head: F.regexp_replace(head, BLOCK_BREAKS, "\n"))
    plain = decode_entities(_before_last(broken, ">", lambda head: F.regexp_replace(head, ANY_TAG, "")))
    # Runs of blanks become one space first, so that the blanks around a line end are few.
    spaced = F.regexp_replace(plain, f"[{LINE_BLANKS}]+", " ")
    return strip(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"))


def html_title(html: Column) -> Column:
    """Decoded, trimmed ``<title>``; empty if there is none."""
    raw = F.regexp_replace(F.regexp_extract(html, TITLE, 1), f"[{BLANKS}]+", " ")
    return strip(decode_entities(raw))


def hrefs(html: Column) -> Column:
    """All ``<a href>`` values, quoted or not, with entities decoded."""
    quoted = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(quoted, lambda value: strip(decode_entities(F.regexp_replace(value, "^[\"']|[\"']$", ""))))
