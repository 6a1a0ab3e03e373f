"""Licence scan: sentences are recognised one by one, then sequences of them are matched with rules.

1. A text is cut into sentences: at stops followed by a blank, at bars and at blank lines. Each is normalised, so that the
   lines of a sentence are joined and marks of comments fall away.
2. Known sentences are found in a normalised sentence by one pattern and looked up by their words, with the version taken
   out: an identifier each, in the order of the text. Where a text says what a work is licensed under (or has a licence
   tag), the names that follow, also several of them, give an identifier each: family, version, ``only`` or ``or-later``.
   A sentence without any gets ``?`` if it holds a cue word; others get none and do not interrupt a sequence.
3. The identifier sequence is matched with the ordered rules; sentences used by a rule are taken out.

Everything is a column expression in the scan stage: no shuffle, no Python, work in proportion to the text.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.text import let
from sitegraph.llm.license_rules import CUES, LAST, LEADS, NAMES, PLAIN_NAMES, RULES, SENTENCES

# Applied in this order to the lower-case text, (pattern, replacement with \1): one spelling of licence; a version of its own
# after "gpl"; "+" after a version; no stop after a single letter; a bar for every end of a sentence; a bar or two blanks
# around every word. The patterns mean the same to Java and to DuckDB, which the SQL counterpart relies on.
NORMAL = [
    ("licence", "license"),
    ("gpl[ -]?v?([0-9])", r"gpl \1"),
    ("([0-9])[+]", r"\1 or later "),
    ("((?:^|[^a-z0-9])[a-z])[.][ \t\r\n]", r"\1 "),
    ("[.!?;][ \t\r\n]|\n[ \t\r*#/>-]*\n", "|"),
    ("[^a-z0-9|]+", "  "),
    ("  [|]|[|]  ", "|"),
]
# The same for parts, which are padded by one blank: a word is " w ", so patterns of whole words may stand side by side.
VERSION = "(?:version  |v  )?v?[0-9]+(?:  [0-9])?"
NUMBER = " v?([0-9]+)(?:  ([0-9]))? "
LATER = "or  later|or  newer|or  any  later  version"


def words(text: str) -> str:
    """A known sentence as a part of a pattern."""
    text = text.strip("* ")
    if "*" in text:
        raise ValueError(f"only the ends of a known sentence may be open: {text}")
    return text.replace(" ", "  ")


def longest_first(texts: list[str]) -> list[str]:
    return sorted(set(texts), key=lambda text: (-len(text), text))


def name_pattern() -> str:
    """The names of licences, with version and suffix where the family has them."""
    plain = {name for names in PLAIN_NAMES.values() for name in names}
    every = longest_first([name for names in (*NAMES.values(), *PLAIN_NAMES.values()) for name in names])
    return "(?:" + "|".join(words(name) if name in plain else f"{words(name)}(?:  {VERSION})?(?:  (?:{LATER}|only))?" for name in every) + ")"


def known_pattern(known: list[tuple[str, str]]) -> str:
    """All known sentences, and leads with the names that follow them; the longest sentence is tried first."""
    sentences = "|".join(words(text).replace("#", VERSION) for text in longest_first([text for _, text in known]))
    leads, name = "|".join(map(words, longest_first(LEADS))), name_pattern()
    article = "(?:  (?:either  of|either|both|the  terms  of|your  choice  of))?(?:  (?:the|a|an))?"
    more = f"(?:(?:  and  or|  and|  or)?(?:  under)?(?:  (?:the|a|an))?  {name})*"
    return f" (?:{sentences}{'|' if sentences else ''}(?:{leads}){article}  {name}{more}) "


def sentence_keys(known: list[tuple[str, str]]) -> dict[str, str]:
    """Known sentences as they look when padded and with ``#`` for every version, and their identifiers; the first one counts."""
    keys: dict[str, str] = {}
    for name, text in known:
        keys.setdefault(re.sub(f" (?:{VERSION}) ", " # ", f" {words(text)} "), name)
    return keys


def name_keys() -> dict[str, str]:
    return {f" {words(name)} ": family for family, names in (NAMES | PLAIN_NAMES).items() for name in names}


def cue_pattern(known: list[tuple[str, str]]) -> str:
    """What a text must hold to be looked at: a cue, or the words of a lead or of a known sentence (up to a version) without one."""
    every = [max(text.strip("* ").split("#"), key=len).strip() for text in [*LEADS, *(text for _, text in known)] if not any(cue in text for cue in CUES)]
    return "|".join(text.replace(" ", "[^a-z0-9]+") for text in [*CUES, *longest_first(every)])


def looked_up(keys: dict[str, str], key: Column) -> Column:
    return F.from_json(F.lit(json.dumps(keys)), "map<string, string>")[key]  # folded to a constant by the optimizer


def version_of(part: Column) -> Column:
    """The version in a padded part with a point, empty if there is none."""
    minor = F.regexp_extract(part, NUMBER, 2)
    return F.when(part.rlike(NUMBER), F.concat(F.regexp_extract(part, NUMBER, 1), F.lit("."), F.when(minor == "", "0").otherwise(minor))).otherwise("")


def name_id(name: Column) -> Column:
    """family, version and suffix of one padded name."""
    plain = looked_up({key: family for key, family in name_keys().items() if family in PLAIN_NAMES}, name)
    core = F.regexp_replace(name, f" (?:{LATER}|only) $", "")
    version = version_of(F.regexp_extract(core, f" (?:{VERSION}) $", 0))
    suffix = F.when(name.rlike(f" (?:{LATER}) $"), "-or-later").when(name.rlike(" only $"), "-only").otherwise("")
    family = looked_up(name_keys(), F.regexp_replace(core, f" (?:{VERSION}) $", ""))
    return F.coalesce(plain, F.concat(family, F.when(version == "", "").otherwise(F.concat(F.lit("-"), version)), suffix))


def part_ids(part: Column, known: list[tuple[str, str]]) -> Column:
    """Identifiers of one match of ``known_pattern``."""
    key = looked_up(sentence_keys(known), F.regexp_replace(part, f" (?:{VERSION}) ", " # "))
    names = F.transform(F.regexp_extract_all(part, F.lit(f" {name_pattern()} "), F.lit(0)), name_id)
    return F.when(key.isNotNull(), F.array(F.replace(key, F.lit("#"), version_of(part)))).otherwise(names)


def scan_licenses(
    docs: DataFrame, text: str = "text", known: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES,
) -> DataFrame:
    """``docs`` with ``sentence_ids`` (array, ``?`` for unknown licence-like sentences), ``licenses`` (sorted
    distinct names) and ``n_unmatched`` (known or licence-like sentences that no rule has used).

    ``known`` are (identifier, normalised sentence) pairs, found wherever their words stand in a sentence; ``rules`` are (name,
    identifiers) pairs; names of licences after a lead are always looked for. ``no-licence`` stands only alone.
    Nulls and empty texts, and texts without a cue word, give empty arrays and 0. Texts are read whole;
    repeated rows give repeated results; columns of the input with the result names are replaced.
    """
    empty = F.array().cast("array<string>")
    cue, known_parts = "|".join(c.replace(" ", "  ") for c in CUES), known_pattern(known)

    def sentences_of(low: Column) -> Column:
        for pattern, new in NORMAL:
            low = F.regexp_replace(low, pattern, new.replace("\\", "$"))
        return F.transform(F.split(low, "[|]"), lambda s: F.concat(F.lit(" "), F.trim(s), F.lit(" ")))

    def ids_of(sentence: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(sentence, F.lit(known_parts), F.lit(0)), lambda part: part_ids(part, known))
        return let(F.flatten(parts), lambda ids: F.when(F.size(ids) > 0, ids).when(sentence.rlike(cue), F.array(F.lit("?"))).otherwise(empty))

    low = F.lower(F.col(text))
    out = docs.withColumn("sentence_ids", F.when(low.rlike(cue_pattern(known)), F.flatten(F.transform(sentences_of(low), ids_of))).otherwise(empty))

    # A rule leaves its name between bars where it has matched, so that what stood around it does not become a sequence.
    def padded(sequence: list[str]) -> str:
        return "".join(f" {part} " for part in sequence)

    ordered = F.from_json(F.lit(json.dumps([(padded(sequence), f" |{name}| ") for name, sequence in rules])), "array<array<string>>")
    start = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    matched = F.aggregate(ordered, start, lambda left, rule: F.replace(left, rule[0], rule[1]))
    left = "matched"
    while left in docs.columns:
        left += "_"
    items = F.filter(F.split(F.col(left), " +"), lambda p: p != "")
    found = F.array_distinct(F.transform(F.filter(items, lambda p: p.startswith("|")), lambda p: F.replace(p, F.lit("|"), F.lit(""))))
    return (
        out.withColumn(left, F.when(F.size("sentence_ids") > 0, matched).otherwise(""))
        .withColumn("licenses", F.array_sort(let(found, lambda names: F.when(F.size(names) > 1, F.array_remove(names, LAST)).otherwise(names))))
        .withColumn("n_unmatched", F.size(F.filter(items, lambda p: ~p.startswith("|"))))
        .drop(left)
    )
