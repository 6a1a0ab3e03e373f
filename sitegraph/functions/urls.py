"""Column rules for URLs: canonical form, host, resolution against a base, crawlability.

Everything is a native expression: a URL column of any size is rewritten inside the scan stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions.text import let

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*:"
# scheme with colon, //authority, path, ?query; the fragment is left out
URL = rf"(?s)^({SCHEME})?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"

CONTROL_OR_SPACE = "".join(map(chr, range(33)))

# An absolute URL that is its own canonical form but for a leading "www." and a last slash: lower-case site, plain
# non-empty segments, neither query nor fragment.
PLAIN = r"\Ahttps?://(?:www\.)?+[a-z0-9.:-]++(?:/[A-Za-z0-9._~-]++)*+/?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def clean_url(url: Column) -> Column:
    """Drops tabs and line ends anywhere and control characters or blanks in front."""
    return F.translate(F.ltrim(url, F.lit(CONTROL_OR_SPACE)), "\t\r\n", "")


def host(url: Column) -> Column:
    """Lower-case authority without one leading ``www.``; the key for "same site"."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^//(?:www\.)?", "")


def is_crawlable(url: Column) -> Column:
    tests = [F.startswith(url, F.lit(prefix)) for prefix in rules.CRAWLABLE_PREFIXES]
    return reduce(Column.__or__, tests)


def _decoded(value: Column) -> Column:
    # A percent sign that starts no escape stays as it is.
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column) -> Column:
    """Pairs with a value, ordered by key (order inside a key kept), encoded anew; "" or "?..."."""
    pairs = F.filter(F.split(query, "&"), lambda pair: F.rlike(pair, F.lit(r"(?s)^[^=]*=.")))
    keyed = F.transform(
        pairs,
        lambda pair, place: F.named_struct(
            F.lit("key"), _decoded(F.substring_index(pair, "=", 1)),
            F.lit("place"), place,
            F.lit("value"), _decoded(F.regexp_replace(pair, "(?s)^[^=]*=", "")),
        ),
    )
    encoded = F.transform(
        F.sort_array(keyed), lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))
    )
    return F.regexp_replace(F.array_join(encoded, "&"), "^(?=.)", "?")


def canonical_url(raw: Column) -> Column:
    """One spelling per page: lower-case site without ``www.``, ordered query, no fragment, no
    trailing slash."""
    return let(raw, lambda url: _if_plain(url, let(clean_url(url), _canonical)))


def canonical_target(base: Column, href: Column) -> Column:
    """``canonical_url`` of ``resolve``, which most absolute links do not need."""
    return let(href, lambda ref: _if_plain(ref, let(clean_url(resolve(base, ref)), _canonical)))


def _if_plain(url: Column, otherwise: Column) -> Column:
    """A plain URL without ``www.`` and last slash, found with one pattern; any other takes the long way."""
    plain = F.rlike(url, F.lit(PLAIN))
    short = reduce(
        lambda rest, scheme: F.when(
            F.startswith(url, F.lit(f"{scheme}www.")), F.concat(F.lit(scheme), F.substring(url, len(scheme) + 5, 2**31 - 1))
        ).otherwise(rest),
        rules.CRAWLABLE_PREFIXES,
        url,
    )
    return F.when(plain, F.rtrim(short, F.lit("/"))).otherwise(otherwise)


def _canonical(url: Column) -> Column:
    query = _part(url, 4)
    whole = F.concat(
        F.lower(_part(url, 1)),
        F.regexp_replace(F.lower(_part(url, 2)), r"^//www\.", "//"),
        F.regexp_replace(_part(url, 3), r"((?:^|/)[^/;]*);\z", "$1"),  # an empty parameter of the last segment
        F.when(F.contains(url, F.lit("?")), canonical_query(F.substring(query, 2, 2**31 - 1))).otherwise(F.lit("")),
    )
    # A bare root keeps its slashes.
    return F.regexp_replace(whole, r"^((?:https?:/)?/)\z|/+\z", "$1")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def base_parts(url: Column) -> Column:
    """What ``resolve`` needs of a page's URL, taken apart once per page."""
    return let(
        clean_url(url),
        lambda u: F.named_struct(
            F.lit("scheme"), _part(u, 1),
            F.lit("origin"), F.concat(_part(u, 1), _part(u, 2)),
            F.lit("path"), _part(u, 3),
            F.lit("folder"), F.concat(F.lit("/"), F.regexp_replace(_part(u, 3), "^/|[^/]*$", "")),
            F.lit("query"), _part(u, 4),
        ),
    )


def _walk(path: Column, keep_empty: Column) -> Column:
    """Resolves ``.`` and ``..``; a relative reference also loses its empty inner segments."""
    segments = F.split(path, "/")
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
    last = F.element_at(segments, -1)
    full = F.concat(F.filter(inner, lambda s: keep_empty | (s != "")), F.array(last))
    walked = F.aggregate(
        full,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    folder = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"), folder)
    return F.when(joined == "//", F.lit("/")).otherwise(joined)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of ``href`` (without fragment) found on a page with ``base_parts`` ``base``."""

    def from_path(ref: Column, path: Column) -> Column:
        rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base["folder"], path))
        # Most references need no walk over their segments.
        walked = let(
            rooted,
            lambda p: F.when(F.rlike(p, F.lit(r"//|/\.\.?(?:/|\z)")), _walk(p, F.startswith(path, F.lit("/")))).otherwise(p),
        )
        inherited = F.when(F.contains(ref, F.lit("?")), _part(ref, 4)).otherwise(base["query"])
        return F.when(path == "", F.concat(base["origin"], base["path"], inherited)).otherwise(
            F.concat(base["origin"], walked, _part(ref, 4))
        )

    def absolute(ref: Column) -> Column:
        return (
            F.when(F.rlike(ref, F.lit(f"^{SCHEME}")), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(base["scheme"], ref))
            .otherwise(let(_part(ref, 3), lambda path: from_path(ref, path)))
        )

    return let(clean_url(href), absolute)
