"""Limits, prefixes and ordered text patterns that results depend on.

Patterns are written with ``\\s`` and ``\\d`` meaning the Unicode classes and ``.`` meaning "all but a
line feed"; ``functions.text.to_java`` spells that out for Spark's regex dialect.
"""

# --- fixed values: limits -------------------------------------------------------------------------
MAX_DEPTH = 3
MAX_PAGES = 1000
CHUNK_TOKENS = 500
TOP_K = 5
SNIPPET_CHARS = 300
MIN_LINE_CHARS = 50
DEFAULT_PAGE_TYPE = "other"

# --- fixed values: URLs ---------------------------------------------------------------------------
CRAWLABLE_PREFIXES = ("http://", "https://")
SKIPPED_HREF_PREFIXES = ("#", "javascript:", "mailto:", "tel:")

# --- fixed values: page header --------------------------------------------------------------------
PAGE_HEADER = "Page URL: {url}\nPage Title: {title}\n\n"

# The third value of a step, where there is one, is a literal that every match contains: texts without
# it skip the pattern.

# --- fixed values: leftovers removed from a kept line (pattern, replacement), in this order -------
LINE_LEFTOVERS = [
    (r"\[([^\]]+)\]\([^)]+\)", r"\1", "]("),
    (r"!\[[^\]]*\]\([^)]+\)", "", "]("),
    (r"={3,}|-{3,}", ""),
]

# --- fixed values: markdown to text (pattern, replacement), in this order -------------------------
MARKDOWN_RULES = [
    (r"\r\n", "\n", "\r"),
    (r"\r", "\n", "\r"),
    (r"^#{1,6}\s+", "", "#"),
    (r"\*\*(.*?)\*\*", r"\1", "**"),
    (r"\*(.*?)\*", r"\1", "*"),
    (r"__(.*?)__", r"\1", "__"),
    (r"_(.*?)_", r"\1", "_"),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1", "]("),
    (r"^\s*[-*+]\s+", "• "),
    (r"^\s*\d+\.\s+", "", "."),
    (r"(?s:```.*?```)", "", "```"),
    (r"`([^`]+)`", r"\1", "`"),
    (r"^\s*>\s+", "", ">"),
    (r"^[-*_]{3,}$", ""),
    (r"\t", " ", "\t"),
    (r" +", " ", "  "),  # a single blank stays as it is
    (r"\n\s*\n\s*\n+", "\n\n"),
]

# --- fixed values: content that differs between visits (pattern, replacement), in this order ------
VOLATILE_RULES = [
    (r"What is \d+ [+\-*/] \d+\?", "", "What is "),
    (r"\d{1,2}:\d{2}:\d{2}", "", ":"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "", ":"),
    (r"Last updated:.*?\d{4}", "", "Last updated:"),
    (r"Updated:.*?\d{4}", "", "Updated:"),
    (r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "", "-"),
    (r"[a-f0-9]{32}", ""),
    (r"[a-f0-9]{40}", ""),
    (r"[a-f0-9]{64}", ""),
    (r"\b[a-zA-Z0-9]{16,}\b", ""),
    (r"(?i:session[_-]?id[=:]\s*[a-zA-Z0-9]+)", ""),
    (r"(?i:token[=:]\s*[a-zA-Z0-9]+)", ""),
    (r"javascript:void\(0\)", "", "javascript:void(0)"),
]
# Once every run of 32 hexadecimal digits is gone, no longer run can be left: these never match.
UNREACHABLE = {r"[a-f0-9]{40}", r"[a-f0-9]{64}"}

# --- fixed values: whole lines that are noise -----------------------------------------------------
NOISE_LINES = [
    r"^\d+$",
    r"^[a-zA-Z0-9]{1,3}$",
    r"^[a-f0-9]{8}$",
]
