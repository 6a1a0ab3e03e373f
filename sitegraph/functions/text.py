"""Column rules for text: trimming, line filters, markdown to text, volatile content, titles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph import rules

# The characters a regex calls blank in Unicode text, as a class body and as plain characters. The property is one test per
# character; a class of all the ranges would be tried range by range.
BLANKS = r"\p{IsWhite_Space}\x1C-\x1F"
BLANK_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Line blanks: the same without the line feed.
LINE_BLANKS = BLANKS + r"&&[^\n]"
WORD = r"\p{L}\p{N}_"


def to_java(pattern: str) -> str:
    """Spells out Unicode ``\\s``, ``\\d`` and ``\\b`` and lets only the line feed end a line."""
    out = pattern.replace(r"\s", f"[{BLANKS}]").replace(r"\d", r"\p{Nd}")
    if out.startswith(r"\b") and out.endswith(r"\b"):
        out = f"(?<![{WORD}]){out[2:-2]}(?![{WORD}])"
    return "(?dm)" + out.replace("(?i:", "(?iu:")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def replace_all(text: Column, steps: list[tuple[str, ...]]) -> Column:
    """Applies ``(pattern, replacement[, literal of every match])`` steps in order."""
    return reduce(_replace, steps, text)


def _replace(text: Column, step: tuple[str, ...]) -> Column:
    pattern, replacement, *literal = step

    def replaced(value: Column) -> Column:
        plain = F.regexp_replace(value, F.lit(to_java(pattern)), F.lit(replacement.replace("\\1", "$1")))
        if pattern.startswith(r"^\s*"):
            marked = _replace_at_line_starts(value, pattern.removeprefix(r"^\s*"), replacement)
            return F.when(F.rlike(value, F.lit(f"[{BLANKS}]{{{LONG_RUN}}}")), marked).otherwise(plain)
        return plain

    if not literal:
        return let(text, replaced) if pattern.startswith(r"^\s*") else replaced(text)
    return let(text, lambda value: F.when(F.contains(value, F.lit(literal[0])), replaced(value)).otherwise(value))


# Up to so many blanks in a row, reading a run again from each of its lines is still linear in the text, and cheaper than marks.
LONG_RUN = 64

# Two characters that no text holds.
MARK, INDENTED = "\uffff", "\ufffe"


def _replace_at_line_starts(value: Column, pattern: str, replacement: str) -> Column:
    """Replaces ``^\\s*pattern`` and reads each run of blanks a fixed number of times.

    Tried at every line start, a run of blank lines would be read again from each of them. So the places are
    marked first: a run of blanks at a line start is taken whole and gets a mark, or is dropped for one where the
    pattern follows; the mark tells whether the pattern starts its line. Then the pattern is replaced at the marks.
    If it ends in blanks that reach into an indented line, that line's own match is not one any more.
    """
    steps = [
        (rf"^(?:\s*+(?<![^\n])(?={pattern})|(\s++))", "$1" + MARK),
        (rf"(?:\A|(?<!\s)([{LINE_BLANKS}]*+\n))\s++{MARK}(?={pattern})", "$1" + INDENTED),
        (rf"[{MARK}{INDENTED}]{pattern}{INDENTED}?", replacement),
        (f"[{MARK}{INDENTED}]", ""),
    ]
    for found, put in steps:
        value = F.regexp_replace(value, F.lit(to_java(found)), F.lit(put))
    return value


def strip(text: Column) -> Column:
    """Trims Unicode blanks on both sides."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def quality_line_array(text: Column) -> Column:
    """Lines long enough before and after link, image and rule leftovers are removed."""
    long_lines = F.filter(lines(text), lambda line: F.char_length(line) >= rules.MIN_LINE_CHARS)
    cleaned = F.transform(long_lines, lambda line: replace_all(line, rules.LINE_LEFTOVERS))
    return F.filter(cleaned, lambda line: F.char_length(line) >= rules.MIN_LINE_CHARS)


def quality_text(text: Column) -> Column:
    return F.array_join(quality_line_array(text), "\n\n")


def markdown_to_text(markdown: Column) -> Column:
    return replace_all(markdown, rules.MARKDOWN_RULES)


def scrub_volatile(text: Column) -> Column:
    """Removes content that differs between two visits of an unchanged page, and noise lines."""
    scrubbed = replace_all(text, [step for step in rules.VOLATILE_RULES if step[0] not in rules.UNREACHABLE])
    noise = "|".join(f"(?:{pattern})" for pattern in rules.NOISE_LINES)
    return F.array_join(F.filter(lines(scrubbed), lambda line: ~F.rlike(line, F.lit(to_java(noise)))), "\n")


def markdown_heading(markdown: Column) -> Column:
    """Text of the first line that starts with ``# `` after trimming; empty if there is none."""
    pattern = rf"(?:^|\n)[{LINE_BLANKS}]*# ([^\n]*[^\n{BLANKS}])"
    return strip(F.regexp_extract(markdown, pattern, 1))


def words(text: Column) -> Column:
    """Blank-separated tokens; an empty array for blank text."""
    return F.filter(F.split(strip(text), f"[{BLANKS}]+"), lambda word: word != "")


def token_chunks(text: Column, max_tokens: int) -> Column:
    """Consecutive chunks of at most ``max_tokens`` blank-separated tokens."""
    none = F.array().cast("array<string>")
    return let(
        words(text),
        lambda tokens: F.when(
            F.size(tokens) > 0,
            F.transform(
                F.sequence(F.lit(1), F.size(tokens), F.lit(max_tokens)),
                lambda start: F.array_join(F.slice(tokens, start, F.lit(max_tokens)), " "),
            ),
        ).otherwise(none),
    )
