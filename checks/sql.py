"""The same queries as SQL for DuckDB, built from small text pieces.

The pieces state the rules again in RE2 and SQL; only the fixed values come from the library.
"""

from __future__ import annotations

from sitegraph import rules

BLANKS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
DOCS_SITE = "https://www.docs.example.org"
CUTOFF = "TIMESTAMP '2024-01-16 00:00:00'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)}, 'g')"


def re2(pattern: str) -> str:
    return "(?m)" + pattern.replace(r"\s", f"[{BLANKS}]").replace(r"\d", r"\p{Nd}")


def apply(expr: str, steps) -> str:
    for pattern, replacement, *_ in steps:
        if pattern.startswith(r"\b"):
            # No look-around here: a run between non-word characters, twice because neighbours share one.
            bounded = rf"(^|[^{WORD}]){pattern[2:-2]}($|[^{WORD}])"
            expr = rx(rx(expr, bounded, r"\1\2"), bounded, r"\1\2")
        else:
            expr = rx(expr, re2(pattern), replacement)
    return expr


def strip(expr: str) -> str:
    return rx(expr, f"^[{BLANKS}]+|[{BLANKS}]+$")


def lines(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def quality_lines(expr: str) -> str:
    long = f"list_filter({lines(expr)}, lambda x: length(x) >= {rules.MIN_LINE_CHARS})"
    cleaned = f"list_transform({long}, lambda x: {apply('x', rules.LINE_LEFTOVERS)})"
    return f"list_filter({cleaned}, lambda x: length(x) >= {rules.MIN_LINE_CHARS})"


def markdown(expr: str) -> str:
    return apply(expr, rules.MARKDOWN_RULES)


def scrub(expr: str) -> str:
    noise = re2("|".join(f"(?:{p})" for p in rules.NOISE_LINES))
    scrubbed = apply(expr, rules.VOLATILE_RULES)
    return f"array_to_string(list_filter({lines(scrubbed)}, lambda x: NOT regexp_matches(x, {lit(noise)})), chr(10))"


# --- HTML -----------------------------------------------------------------------------------------

ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]  # those in the data
DROPPED = "(?is)" + "|".join(
    ["<!--.*?-->"]
    + [rf"<{t}(?:[\s/][^>]*)?>.*?</{t}\s*>" for t in "script style head nav footer aside form table".split()]
    + [r"<div\s[^>]*class=[\"']ad[\"'][^>]*>.*?</div\s*>"]
)
BREAKS = (
    r"(?i)</?(?:p|div|section|article|main|header|h[1-6]|ul|ol|li|dl|dt|dd|br|hr|pre|blockquote|figure|figcaption|title)"
    r"(?:[\s/][^>]*)?>"
)


def entities(expr: str) -> str:
    for name, char in ENTITIES:
        expr = f"replace({expr}, {lit(name)}, {lit(char)})"
    return expr


def main_text(expr: str) -> str:
    plain = rx(rx(rx(rx(expr, f"[{BLANKS}]+", " "), DROPPED), BREAKS, "\n"), r"(?s)</?[a-zA-Z!][^>]*>")
    line_blanks = BLANKS.replace(r"\n", "")
    return strip(rx(rx(entities(plain), f"[{line_blanks}]+", " "), r" ?\n[ \n]*", "\n"))


def html_title(expr: str) -> str:
    raw = rf"regexp_extract({expr}, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)"
    return strip(entities(rx(raw, f"[{BLANKS}]+", " ")))


def heading(expr: str) -> str:
    blank = BLANKS.replace(r"\n", "")
    return strip(f"regexp_extract({expr}, {lit(f'(?:^|{chr(92)}n)[{blank}]*# ([^{chr(92)}n]*[^{BLANKS}])')}, 1)")


# --- URLs -----------------------------------------------------------------------------------------

def host(expr: str) -> str:
    return rx(f"lower(regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))", r"^www\.")


def canonical(expr: str) -> str:
    """For absolute URLs whose query needs no escapes, as in the data."""
    pairs = (
        f"list_filter(string_split(regexp_extract({expr}, '^[^?#]*[?]([^#]*)', 1), '&'), "
        "lambda p: regexp_matches(p, '^[^=]*=.'))"
    )
    keyed = f"list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}}))"
    query = f"array_to_string(list_transform({keyed}, lambda s: s.p), '&')"
    path = f"regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return (
        f"rtrim(lower(split_part({expr}, ':', 1)) || '://' || {host(expr)} || {path} || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END, '/')"
    )


# --- vectors --------------------------------------------------------------------------------------

def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(f'[^{BLANKS}]+')})"


def chunk_rows(source: str, size: int, url: str = "url", text: str = "clean_text") -> str:
    return f"""SELECT url AS page_url, CAST(i AS INTEGER) AS chunk_index,
        array_to_string(w[i * {size} + 1 : i * {size} + {size}], ' ') AS text
      FROM (SELECT url, w, unnest(range(0, (len(w) + {size - 1}) // {size})) AS i
            FROM (SELECT {url} AS url, {words(text)} AS w FROM {source}))"""


def hash_vectors(source: str, keys: str, text: str) -> str:
    """Unit bag-of-words vectors, as FLOAT."""
    return f"""SELECT {keys}, CASE WHEN l > 0 THEN list_transform(c, lambda x: CAST(x / l AS FLOAT))
          ELSE list_transform(c, lambda x: CAST(0 AS FLOAT)) END AS vec
      FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS l
        FROM (SELECT {keys}, list_transform(range(64), lambda i: CAST(len(list_filter(b, lambda y: y = i)) AS DOUBLE)) AS c
          FROM (SELECT {keys}, list_transform({words(text)}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS b
                FROM {source})))"""


def micros(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ' ')"


def cosine(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a})) / sqrt(list_inner_product({b}, {b}))"


def top_k(scored: str, keys: str = "", k: int = rules.TOP_K, score: str = "round(score, 6)") -> str:
    return f"""SELECT query_id, rank, page_id{keys}, {score} AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS INTEGER) AS rank
        FROM ({scored})) WHERE rank <= {k}"""


# --- derived tables -------------------------------------------------------------------------------

LANG = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"

CAPTURES = f"""web AS (
  SELECT page_id * 2 AS page_id, url, html, CAST(NULL AS VARCHAR) AS markdown,
    CASE {LANG} WHEN 'en' THEN NULL WHEN 'es' THEN CAST([] AS VARCHAR[])
      ELSE [url, {ORIGIN} || '/about/?b=2&a=1&c=#top', '/relative', 'javascript:void(0)', 'tel:1',
            'https://elsewhere.example.com/x', {ORIGIN} || '/'] END AS links,
    CASE WHEN {LANG} = 'de' THEN '  ' || regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) || ' ' END AS meta_title,
    CASE WHEN {LANG} = 'fr' THEN 'article' END AS meta_type,
    CASE WHEN NOT contains(html, '</body>') THEN 'incomplete document' END AS error,
    TIMESTAMP '2024-02-01' + to_minutes(CAST(page_id AS INTEGER)) AS fetched_at
  FROM pages),
docs AS (
  SELECT doc_id * 2 + 1 AS page_id, '{DOCS_SITE}/d/' || doc_id || '/#text' AS url, CAST(NULL AS VARCHAR) AS html,
    CASE WHEN lang = 'fr' THEN '# ' || source || ' ' || doc_id || chr(10) || chr(10) || text ELSE text END AS markdown,
    list_concat(list_transform(range(1, 11), lambda j: '{DOCS_SITE}/d/' || (doc_id * 10 + j)),
      ['{DOCS_SITE}/', '{DOCS_SITE}/d/' || doc_id, 'mailto:a@b.c', 'https://elsewhere.example.com/x']) AS links,
    CASE WHEN lang = 'de' THEN source || ' ' || doc_id END AS meta_title, CAST(NULL AS VARCHAR) AS meta_type,
    CAST(NULL AS VARCHAR) AS error, TIMESTAMP '2024-03-01' + to_minutes(CAST(doc_id AS INTEGER)) AS fetched_at
  FROM documents),
captures AS (SELECT * FROM web UNION ALL SELECT * FROM docs)"""

FETCHES = f"""{CAPTURES},
fetches AS (
  SELECT page_id, url, CASE WHEN error IS NULL THEN coalesce(html, '') ELSE '' END AS content,
    CAST(CASE WHEN error IS NULL THEN 200 ELSE 500 END AS INTEGER) AS status_code,
    CASE WHEN error IS NULL THEN 'text/html' END AS content_type,
    'scrape failed: ' || error AS error,
    CASE WHEN error IS NULL THEN coalesce(markdown, '') ELSE '' END AS markdown,
    error IS NULL AND links IS NOT NULL AS has_links,
    CASE WHEN error IS NULL THEN coalesce(links, []) ELSE [] END AS links,
    CASE WHEN error IS NULL THEN meta_title END AS meta_title,
    CASE WHEN error IS NULL THEN meta_type END AS meta_type, fetched_at
  FROM captures)"""

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def anchors(expr: str) -> str:
    unquoted = rx("h", "^[\"']|[\"']$")
    return f"list_transform(regexp_extract_all({expr}, {lit(HREF)}, 1), lambda h: split_part({strip(entities(unquoted))}, '#', 1))"


def skipped(expr: str) -> str:
    return " OR ".join([f"{expr} = ''"] + [f"starts_with({expr}, {lit(p)})" for p in rules.SKIPPED_HREF_PREFIXES])


def edge_rows(source: str) -> str:
    """Edges from (url, href); hrefs in the data are absolute URLs or absolute paths."""
    absolute = f"CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE {ORIGIN} || href END"
    return f"""SELECT DISTINCT src, dst FROM (
      SELECT {canonical('url')} AS src, {canonical('target')} AS dst, {host('url')} AS h0, {host('target')} AS h1
      FROM (SELECT url, {absolute} AS target FROM ({source}) WHERE NOT ({skipped('href')}))) WHERE h0 = h1"""


EDGES = f"""{FETCHES},
edges AS ({edge_rows(f'''
    SELECT url, unnest(list_filter(links, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://'))) AS href
    FROM fetches WHERE error IS NULL AND has_links
    UNION ALL
    SELECT url, unnest({anchors('content')}) AS href FROM fetches WHERE error IS NULL AND NOT has_links''')}),
seeds AS (SELECT {canonical('u')} AS seed FROM (SELECT arg_min(url, page_id) AS u FROM captures GROUP BY {host('url')}))"""


# The whole walk: a URL that was reached from a seed is not reached again, so the walk ends by itself.
WHOLE_WALK = f"""{EDGES},
walk(seed, url, depth) USING KEY (seed, url) AS (
  SELECT DISTINCT seed, seed, 0 FROM seeds
  UNION
  SELECT DISTINCT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url
    ANTI JOIN recurring.walk r ON r.seed = w.seed AND r.url = e.dst),
reached AS (SELECT seed, url, CAST(depth AS INTEGER) AS depth FROM walk)"""


def bfs(max_depth: int = rules.MAX_DEPTH, max_pages: int = rules.MAX_PAGES) -> str:
    return f"""{EDGES},
walk(seed, url, depth) AS (
  SELECT DISTINCT seed, seed, 0 FROM seeds
  UNION
  SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < {max_depth}),
least AS (SELECT seed, url, min(depth) AS depth FROM walk GROUP BY ALL),
levels AS (SELECT seed, depth, coalesce(sum(count(*)) OVER (PARTITION BY seed ORDER BY depth
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM least GROUP BY seed, depth),
reached AS (SELECT l.seed, l.url, CAST(l.depth AS INTEGER) AS depth FROM least l JOIN levels v USING (seed, depth)
            WHERE v.before < {max_pages})"""


TITLED = f"""titled AS (SELECT *, {strip("coalesce(meta_title, '')")} AS t1, {heading('markdown')} AS t2, {html_title('content')} AS t3
  FROM fetches),
titles AS (SELECT *, CASE WHEN t1 <> '' THEN t1 WHEN t2 <> '' THEN t2 WHEN t3 <> '' THEN t3 ELSE url END AS title,
    CASE WHEN t1 <> '' THEN 'metadata' WHEN t2 <> '' THEN 'markdown' WHEN t3 <> '' THEN 'html' ELSE 'url' END AS title_source
  FROM titled)"""

PAGE_DOCUMENTS = f"""extracted AS (SELECT *, {main_text('content')} AS extracted FROM titles WHERE error IS NULL),
bodies AS (SELECT *, CASE WHEN extracted <> '' THEN array_to_string({quality_lines('extracted')}, chr(10) || chr(10))
    ELSE {scrub(markdown('markdown'))} END AS body FROM extracted),
page_documents AS (SELECT *, CASE WHEN body <> '' THEN 'Page URL: ' || url || chr(10) || 'Page Title: ' || title ||
    chr(10) || chr(10) || body ELSE '' END AS clean_text,
    coalesce(meta_type, 'other') AS page_type FROM bodies)"""

# One JSON object with the keys that are present.
METADATA = """'{"links":' || CAST(to_json(links) AS VARCHAR) || ',"source":"capture","content_type":"markdown","metadata":{' ||
  array_to_string(list_filter([
    CASE WHEN meta_title IS NOT NULL THEN '"title":' || CAST(to_json(meta_title) AS VARCHAR) END,
    CASE WHEN meta_type IS NOT NULL THEN '"page_type":' || CAST(to_json(meta_type) AS VARCHAR) END],
    lambda x: x IS NOT NULL), ',') || '},"page_type":' || CAST(to_json(page_type) AS VARCHAR) || '}'"""

SHOP = f"""shop_fetches AS (
  SELECT event_id, 'https://shop.example.org/u/' || user_id || '?item=' || json_extract_string(props, '$.k') AS url,
    'Item ' || json_extract_string(props, '$.k') AS title, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS price,
    'Product page of kind ' || event_type AS body, event_type, ts
  FROM events),
shop_texts AS (SELECT *, 'Page URL: ' || url || chr(10) || 'Page Title: ' || title || chr(10) || chr(10) || body AS clean_text
  FROM shop_fetches WHERE event_type <> 'error'),
shop AS (SELECT *, sha256(clean_text) AS checksum,
    sha256('{{"links":[],"source":"capture","content_type":"markdown","metadata":{{"title":"' || title || '","price":"' || price ||
           '"}},"page_type":"other"}}') AS metadata_checksum
  FROM shop_texts)"""


def stored(name: str, condition: str = "true") -> str:
    """The store after the captures that meet a condition."""
    order = "ORDER BY ts, checksum, metadata_checksum"
    return f"""{name} AS (
  SELECT url, first(event_id {order}, event_id) AS page_id, last(body {order}) AS markdown, last(title {order}) AS title, last(clean_text {order}) AS clean_text, last(checksum {order}) AS checksum,
    last(metadata_checksum {order}) AS metadata_checksum,
    max(CASE WHEN prev IS DISTINCT FROM checksum THEN ts END) AS markdown_changed, max(ts) AS last_seen
  FROM (SELECT *, lag(checksum) OVER (PARTITION BY url {order}) AS prev FROM shop WHERE {condition}) GROUP BY url)"""


STORES = f"""{SHOP},
{stored('first_store', f'ts < {CUTOFF}')},
{stored('both_crawls')},
second_store AS (SELECT b.*, CASE WHEN NOT ends_with(f.clean_text, 'signup') THEN f.last_seen + INTERVAL 1 HOUR END AS embedded_at,
    f.clean_text AS first_text
  FROM both_crawls b LEFT JOIN first_store f USING (url))"""

CHANGES = f"""{SHOP},
{stored('old', f'ts < {CUTOFF}')},
{stored('new', f'ts >= {CUTOFF}')},
changes AS (
  SELECT url, content_changed, metadata_changed, CASE WHEN NOT in_new THEN 'not seen' WHEN NOT in_old THEN 'new'
      WHEN content_changed THEN 'content changed' WHEN metadata_changed THEN 'metadata changed' ELSE 'unchanged' END AS status
  FROM (SELECT url, o.url IS NOT NULL AS in_old, n.url IS NOT NULL AS in_new,
      n.url IS NOT NULL AND o.checksum IS DISTINCT FROM n.checksum AS content_changed,
      n.url IS NOT NULL AND o.metadata_checksum IS DISTINCT FROM n.metadata_checksum AS metadata_changed
    FROM old o FULL JOIN new n USING (url)))"""

DOC_PAGES = f"""doc_pages AS (SELECT doc_id AS page_id, '{DOCS_SITE}/d/' || doc_id AS url, text AS clean_text FROM documents)"""

QUESTIONS = f"""questions AS ({hash_vectors("(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')", 'query_id', 'text')})"""
# Queries are encoded in double precision; the cast to FLOAT of pages is part of the stored vectors.
QUESTIONS = QUESTIONS.replace("CAST(x / l AS FLOAT)", "x / l").replace("CAST(0 AS FLOAT)", "0.0::DOUBLE")

DOC_VECTORS = f"""doc_vectors AS (SELECT page_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM ({hash_vectors('doc_pages', 'page_id', 'clean_text')}))"""


def zero_safe(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN list_inner_product({a}, {a}) > 0 AND list_inner_product({b}, {b}) > 0 THEN {cosine(a, b)} END, 0.0)"


BATCH_HITS = f"""{DOC_PAGES}, {DOC_VECTORS}, {QUESTIONS},
hits AS ({top_k(f"SELECT query_id, page_id, {zero_safe('q.vec', 'p.vec')} AS score FROM questions q, doc_vectors p", score="score")})"""

BITS, RADIUS = 8, 3
SELF = f"""vectors AS (SELECT vec_id AS page_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
planes AS (SELECT j, list(CASE WHEN substr(md5(j || ':' || i), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS plane
  FROM range({BITS}) a(j), (SELECT unnest(range(len(vec))) AS i FROM (SELECT vec FROM vectors LIMIT 1)) GROUP BY j),
celled AS (SELECT page_id, any_value(vec) AS vec, CAST(sum(CASE WHEN list_inner_product(vec, plane) > 0 THEN 1 << j ELSE 0 END) AS BIGINT) AS cell
  FROM vectors, planes GROUP BY page_id),
pairs AS (SELECT q.page_id AS query_id, p.page_id, {zero_safe('q.vec', 'p.vec')} AS score,
    bit_count(xor(q.cell, p.cell)) <= {RADIUS} AS near FROM celled q, celled p),
approx AS ({top_k('SELECT * FROM pairs WHERE near')}),
exact AS ({top_k('SELECT * FROM pairs')})"""

def learnt_cells(rounds: int = 6) -> str:
    """k-means in whole numbers, two lists per vector and two cells per query, over the clustered vectors; hits and all pairs' hits."""
    distance = "CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [f"""own AS (SELECT vec_id AS page_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
signed AS (SELECT *, list_transform(vec[1:5], lambda x: x > 0) AS signs FROM own),
centres AS (SELECT signs, arg_min(vec, page_id) AS centre FROM signed GROUP BY signs),
clustered AS MATERIALIZED (SELECT page_id, list_transform(list_zip(vec, centre), lambda z: z[1] + 2 * z[2]) AS vec FROM signed JOIN centres USING (signs)),
size AS (SELECT count(*) AS n, CAST(round(3 * sqrt(count(*))) AS BIGINT) AS k FROM clustered),
points AS MATERIALIZED (SELECT page_id, vec, list_transform(vec, lambda x: CAST(floor(x / sqrt(list_inner_product(vec, vec)) * 1024) AS BIGINT)) AS p,
  CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 AS place FROM clustered),
sample AS MATERIALIZED (SELECT page_id, place, p FROM points, size WHERE place <= k * 256 / n),
c0 AS MATERIALIZED (SELECT r - 1 AS cell, p AS c FROM (SELECT p, row_number() OVER (ORDER BY place, page_id) AS r FROM sample), size WHERE r <= k)"""]
    for i in range(rounds):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT page_id, any_value(p) AS p, min(struct_pack(d := d, cell := cell)).cell AS cell
  FROM (SELECT page_id, p, cell, {distance} AS d FROM sample, c{i}) GROUP BY page_id),
c{i + 1} AS MATERIALIZED (SELECT cell, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT cell, list(m ORDER BY j) AS m FROM (
  SELECT cell, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT cell, unnest(p) AS x, unnest(range(len(p))) AS j FROM n{i}) GROUP BY cell, j) GROUP BY cell) USING (cell))""")
    steps.append(f"""listed AS MATERIALIZED (SELECT page_id, vec, cell FROM (SELECT page_id, vec, cell, {distance} AS d FROM points, c{rounds})
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY d, cell) <= 2),
compared AS (SELECT q.page_id AS query_id, v.page_id, any_value(q.vec) AS q, any_value(v.vec) AS v FROM listed q JOIN listed v USING (cell) GROUP BY ALL),
found AS ({top_k(f"SELECT query_id, page_id, {zero_safe('q', 'v')} AS score FROM compared")}),
exact AS ({top_k(f"SELECT q.page_id AS query_id, v.page_id, {zero_safe('q.vec', 'v.vec')} AS score FROM clustered q, clustered v")})""")
    return ",\n".join(steps)


EMBEDDED_STORE = f"""{STORES},
embedded AS (SELECT *, embedded_at IS NULL OR markdown_changed > embedded_at AS due FROM second_store)"""

STORE_VIEW = "page_id, url, title, clean_text, markdown, checksum, metadata_checksum, markdown_changed, last_seen, embedded_at"


def oracle() -> dict[str, str]:
    small = 100
    doc_chunks = f"{DOC_PAGES}, chunks AS ({chunk_rows('doc_pages', rules.CHUNK_TOKENS)})"
    small_chunks = f"{DOC_PAGES}, chunks AS ({chunk_rows('doc_pages', small)})"
    with_recursive = "WITH RECURSIVE "
    found = {
        "load_fetches": f"""WITH {FETCHES} SELECT page_id, url, status_code, content_type, error, has_links, fetched_at,
            md5(content) AS content_md5, md5(markdown) AS markdown_md5, array_to_string(links, ' ') AS links,
            CAST((meta_title IS NOT NULL)::INT + (meta_type IS NOT NULL)::INT AS INTEGER) AS n_metadata FROM fetches""",
        "failed_fetches": f"""WITH {FETCHES} SELECT {host('url')} AS host, error, count(*) AS failures FROM fetches
            WHERE error IS NOT NULL GROUP BY ALL""",
        "lookup_pages": f"""WITH {EDGES}, stored AS (SELECT {canonical('url')} AS url, min(page_id) AS page_id FROM captures GROUP BY ALL)
            SELECT url, coalesce(page_id, -1) AS page_id, page_id IS NOT NULL AS found FROM (SELECT DISTINCT dst AS url FROM edges) LEFT JOIN stored USING (url)""",
        "replace_chunks": f"""WITH {DOC_PAGES}, relabelled AS (SELECT * FROM doc_pages WHERE page_id IN (SELECT doc_id FROM labels)),
            kept AS (SELECT * FROM doc_pages WHERE page_id NOT IN (SELECT doc_id FROM labels))
            {chunk_rows('kept', rules.CHUNK_TOKENS)} UNION ALL {chunk_rows('relabelled', 200)}""",
        "attach_page_vectors": f"""WITH {DOC_PAGES} SELECT page_id, url, {micros('embedding')} AS vec,
            CASE WHEN vec_id IS NOT NULL THEN TIMESTAMP '2024-05-01 00:00:00' END AS embedded_at
            FROM doc_pages LEFT JOIN embeddings ON vec_id = page_id""",
        "canonical_urls": f"WITH {CAPTURES} SELECT page_id, url, {canonical('url')} AS canonical_url, {host('url')} AS host FROM captures",
        "duplicate_urls": f"""WITH {CAPTURES} SELECT {canonical('url')} AS canonical_url, min(page_id) AS survivor, count(*) AS copies
            FROM captures GROUP BY ALL""",
        "html_links": edge_rows(f"SELECT url, unnest({anchors('html')}) AS href FROM pages"),
        "page_edges": f"WITH {EDGES} SELECT src, dst FROM edges",
        "crawl_bfs": f"{with_recursive}{bfs()} SELECT * FROM reached",
        "crawl_bfs_limited": f"{with_recursive}{bfs(max_pages=100)} SELECT * FROM reached",
        "crawl_bfs_whole": f"{with_recursive}{WHOLE_WALK} SELECT * FROM reached",
        "crawl_resume": f"{with_recursive}{WHOLE_WALK} SELECT * FROM reached",
        "crawl_states": f"""{with_recursive}{bfs()}, outcomes AS (SELECT {canonical('url')} AS url, bool_or(error IS NULL) AS good FROM fetches GROUP BY ALL)
            SELECT seed, r.url, depth, CASE WHEN good THEN 'fetched' WHEN NOT good THEN 'failed' ELSE 'pending' END AS status FROM reached r LEFT JOIN outcomes o ON o.url = r.url""",
        "crawl_frontier": f"{with_recursive}{bfs(max_depth=2)} SELECT * FROM reached WHERE depth = 2",
        "crawl_progress": f"""{with_recursive}{bfs()}, good AS (SELECT DISTINCT {canonical('url')} AS url FROM fetches WHERE error IS NULL),
            counts AS (SELECT depth, count(*) AS reached, count(g.url) AS fetched, count(*) - count(g.url) AS failed
              FROM reached r LEFT JOIN good g ON g.url = r.url GROUP BY depth)
            SELECT *, lead(reached, 1, 0) OVER (ORDER BY depth) AS pending,
              CAST(sum(reached) OVER (ORDER BY depth) AS BIGINT) AS processed FROM counts""",
        "page_titles": f"WITH {FETCHES}, {TITLED} SELECT page_id, url, title, title_source FROM titles",
        "main_text": f"""SELECT page_id, t AS main_text, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS INTEGER) AS n_lines
            FROM (SELECT page_id, {main_text('html')} AS t FROM pages)""",
        "quality_lines": f"""WITH t AS (SELECT doc_id, '[See ' || source || '](https://example.org/' || lang || ') ![](x.png) --- ' || text AS text FROM documents),
            k AS (SELECT doc_id, text, {quality_lines('text')} AS kept FROM t)
            SELECT doc_id, array_to_string(kept, chr(10) || chr(10)) AS quality_text, CAST(len(kept) AS INTEGER) AS kept,
              CAST(len(string_split(text, chr(10))) - len(kept) AS INTEGER) AS dropped FROM k""",
        "markdown_to_text": f"""WITH t AS (SELECT doc_id, '# ' || source || E'\\r\\n\\r\\n\\r\\n\\n- **' || lang || '** __' || source ||
              E'__\\n1. [link ' || lang || E'](https://example.org/)\\n> `' || source || '` *' || lang || E'*\\n```\\ncode of ' || source ||
              E'\\n```\\n---\\n\\t' || text AS markdown FROM documents)
            SELECT doc_id, {markdown('markdown')} AS plain_text FROM t""",
        "scrub_volatile": f"""WITH t AS (SELECT doc_id, E'Last updated: 12 May 2024, 10:11:12\\nWhat is 3 + 4? session_id=' || source || ' Token: ' || lang ||
              chr(10) || md5(text) || ' ' || sha256(source) || E'\\n42\\nabc\\n' || substr(md5(source), 1, 8) || chr(10) || text AS text FROM documents),
            s AS (SELECT doc_id, text, {scrub('text')} AS stable_text FROM t)
            SELECT doc_id, stable_text, CAST(length(text) - length(stable_text) AS INTEGER) AS removed FROM s""",
        "page_documents": f"""WITH {FETCHES}, {TITLED}, {PAGE_DOCUMENTS} SELECT page_id, url, title, page_type, {METADATA} AS metadata,
            sha256(clean_text) AS checksum, sha256(body) AS body_checksum, CAST(length(clean_text) AS INTEGER) AS n_chars, fetched_at
            FROM page_documents""",
        "page_metadata": f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k,
            CASE WHEN event_type = 'click' THEN 'product' ELSE 'other' END AS page_type FROM events""",
        "page_metadata_free": """SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN event_type ELSE 'other' END AS page_type,
            CASE event_type WHEN 'purchase' THEN 'page_type props purchase' WHEN 'click' THEN 'click page_type props' WHEN 'view' THEN 'k' ELSE '' END AS keys,
            CASE WHEN event_type IN ('purchase', 'click') THEN CAST(user_id AS BIGINT) END AS first_of,
            CASE WHEN event_type IN ('purchase', 'click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
        "pages_per_type": "SELECT CASE WHEN event_type = 'click' THEN 'product' ELSE 'other' END AS page_type, count(*) AS pages FROM events GROUP BY ALL",
        "detect_changes": f"WITH {CHANGES} SELECT * FROM changes",
        "upsert_pages": f"WITH {STORES} SELECT {STORE_VIEW} FROM second_store",
        "crawl_report": f"""WITH {CHANGES}, o AS (SELECT CASE WHEN NOT coalesce(good, false) THEN 'fail: fetch' WHEN content_changed IS NULL THEN 'fail: store'
              WHEN content_changed OR metadata_changed THEN 'pass' ELSE 'pass: no changes' END AS outcome
              FROM (SELECT url, bool_or(event_type <> 'error' AND ts >= {CUTOFF}) AS good FROM shop_fetches GROUP BY url)
              LEFT JOIN (SELECT * FROM changes WHERE status <> 'not seen') USING (url))
            SELECT outcome, count(*) AS pages, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM o GROUP BY outcome""",
        "embedding_targets": f"WITH {EMBEDDED_STORE} SELECT url, clean_text, markdown_changed, embedded_at FROM embedded WHERE due",
        "chunk_pages": f"WITH {doc_chunks} SELECT * FROM chunks",
        "embed_chunks": f"""WITH {doc_chunks} SELECT page_url, chunk_index, {micros('vec')} AS vec
            FROM ({hash_vectors('chunks', 'page_url, chunk_index', 'text')})""",
        "embed_pages": f"WITH {DOC_PAGES} SELECT page_id, {micros('vec')} AS vec FROM ({hash_vectors('doc_pages', 'page_id', 'clean_text')})",
        "mean_page_vectors": f"""WITH {small_chunks}, v AS ({hash_vectors('chunks', 'page_url, chunk_index', 'text')}),
            m AS (SELECT page_url, i, avg(x) AS x FROM (SELECT page_url, unnest(range(64)) AS i, CAST(unnest(vec) AS DOUBLE) AS x FROM v) GROUP BY ALL),
            p AS (SELECT page_url, list(x ORDER BY i) AS vec FROM m GROUP BY page_url)
            SELECT page_url, {micros('vec')} AS vec, n_chunks FROM p JOIN (SELECT page_url, count(*) AS n_chunks FROM chunks GROUP BY ALL) USING (page_url)""",
        "unit_vectors": f"""WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
            n AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM d)
            SELECT vec_id, {micros("CASE WHEN l > 0 THEN list_transform(v, lambda x: x / l) ELSE v END")} AS vec, l = 0 AS is_zero FROM n""",
        "search_pages": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)
            SELECT rank, page_id, score FROM ({top_k(f"SELECT 0 AS query_id, p.vec_id AS page_id, {cosine('q.vec', 'p.vec')} AS score FROM v q, v p WHERE q.vec_id = 0 AND p.vec_id <> 0")})""",
        "search_chunks": f"""WITH {small_chunks}, {QUESTIONS}, v AS (SELECT page_id, chunk_index, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS vec
              FROM ({hash_vectors('chunks', 'page_url, chunk_index', 'text')}) JOIN doc_pages ON url = page_url),
            s AS (SELECT query_id, page_id, chunk_index, {zero_safe('q.vec', 'v.vec')} AS score FROM questions q, v),
            b AS (SELECT query_id, page_id, chunk_index, score FROM s
              QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY round(score, 9) DESC, chunk_index) = 1)
            {top_k('SELECT * FROM b', ', CAST(chunk_index AS BIGINT) AS chunk_index')}""",
        "search_batch": f"WITH {BATCH_HITS} SELECT query_id, rank, page_id, round(score, 6) AS score FROM hits",
        "search_approx": f"WITH {SELF} SELECT * FROM approx",
        "search_recall": f"""WITH {SELF} SELECT count(*) AS exact_hits, count(a.page_id) AS found_hits, round(count(a.page_id) / count(*), 6) AS recall
            FROM exact e LEFT JOIN approx a ON a.query_id = e.query_id AND a.page_id = e.page_id""",
        "search_cells": f"WITH {learnt_cells()} SELECT * FROM found",
        "search_cells_recall": f"""WITH {learnt_cells()} SELECT count(*) AS exact_hits, count(f.page_id) AS found_hits, round(count(f.page_id) / count(*), 6) AS recall,
            any_value(pairs) AS compared_pairs, round(any_value(pairs) / any_value(n * n), 6) AS pair_share
            FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.page_id = e.page_id, size,
              (SELECT CAST(sum(m * m) AS BIGINT) AS pairs FROM (SELECT count(*) AS m FROM listed GROUP BY cell))""",
        "format_hits": f"""WITH {BATCH_HITS} SELECT query_id, rank, url, CASE WHEN split_part(url, '/', -1) <> '' THEN split_part(url, '/', -1) ELSE url END AS title,
            substring(clean_text, 1, {rules.SNIPPET_CHARS}) AS snippet, round(score, 3) AS score, count(*) OVER (PARTITION BY query_id) AS total
            FROM hits JOIN doc_pages USING (page_id)""",
        "search_text": f"""WITH {BATCH_HITS} SELECT query_id, rank, url, CASE WHEN split_part(url, '/', -1) <> '' THEN split_part(url, '/', -1) ELSE url END AS title,
            substring(clean_text, 1, {rules.SNIPPET_CHARS}) AS snippet, round(score, 3) AS score, count(*) OVER (PARTITION BY query_id) AS total
            FROM hits JOIN doc_pages USING (page_id)""",
        "response_captures": """WITH r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'broken response' WHEN event_type = 'error' THEN 'timeout'
                WHEN event_type = 'signup' THEN 'no data' WHEN event_type = 'view' THEN 'no url' END AS reason,
                CASE WHEN event_type <> 'view' THEN 'https://r.org/' || user_id END AS url FROM events)
            SELECT url, CASE WHEN reason IS NULL THEN 200 ELSE 500 END AS status_code, 'scrape failed: ' || reason AS error,
              md5(CASE WHEN reason IS NULL THEN '<p>' || event_type || '</p>' ELSE '' END) AS content_md5,
              CASE WHEN reason IS NULL THEN event_type ELSE '' END AS markdown, CASE WHEN reason IS NULL THEN 'https://a.org/x' ELSE '' END AS links,
              CASE WHEN reason IS NULL THEN props ELSE '' END AS title, ts AS fetched_at FROM r""",
        "crawl_rows": f"""{with_recursive}{WHOLE_WALK},
            crawled AS (SELECT * REPLACE ({canonical('url')} AS url) FROM fetches WHERE {canonical('url')} IN (SELECT url FROM reached)),
            {TITLED.replace('FROM fetches', 'FROM crawled')}, {PAGE_DOCUMENTS},
            latest AS (SELECT * REPLACE (first_id AS page_id), sha256(clean_text) AS checksum FROM (SELECT *, first(page_id) OVER (PARTITION BY url ORDER BY fetched_at) AS first_id FROM page_documents)
              QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1),
            vectors AS ({hash_vectors('latest', 'url', 'clean_text')})
            SELECT page_id, url, title, page_type, checksum, CASE WHEN clean_text <> '' THEN {micros('vec')} END AS vec,
              CASE WHEN clean_text <> '' THEN n ELSE 0 END AS n_chunks, CAST(CASE WHEN clean_text <> '' THEN n - 1 ELSE -1 END AS INTEGER) AS last_chunk,
              true AS same_page
            FROM (SELECT *, CAST((len({words('clean_text')}) + {rules.CHUNK_TOKENS - 1}) // {rules.CHUNK_TOKENS} AS BIGINT) AS n FROM latest) JOIN vectors USING (url)""",
        "crawl_run": f"""{with_recursive}{WHOLE_WALK},
            crawled AS (SELECT * REPLACE ({canonical('url')} AS url) FROM fetches WHERE {canonical('url')} IN (SELECT url FROM reached)),
            {TITLED.replace('FROM fetches', 'FROM crawled')}, {PAGE_DOCUMENTS},
            latest AS (SELECT * FROM page_documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1),
            due AS (SELECT * FROM latest WHERE clean_text <> '')
            SELECT 'edges' AS stage, count(*) AS n FROM edges UNION ALL SELECT 'reached', count(*) FROM reached
            UNION ALL SELECT 'fetched', count(*) FROM crawled UNION ALL SELECT 'failed', count(*) FROM crawled WHERE error IS NOT NULL
            UNION ALL SELECT 'pages', count(*) FROM latest UNION ALL SELECT 'embedded', count(*) FROM due
            UNION ALL SELECT 'chunks', CAST(sum((len({words('clean_text')}) + {rules.CHUNK_TOKENS - 1}) // {rules.CHUNK_TOKENS}) AS BIGINT) FROM due""",
        "embed_run": f"""WITH {EMBEDDED_STORE}, texts AS (SELECT url, CASE WHEN due THEN markdown_changed ELSE embedded_at END AS embedded_at,
              CASE WHEN due THEN clean_text ELSE first_text END AS t FROM embedded)
            SELECT url, embedded_at, {micros('vec')} AS vec FROM ({hash_vectors('texts', 'url, embedded_at', 't')})""",
        "stream_pages": f"""WITH {SHOP}, {stored('s')} SELECT page_id, url, title, clean_text, markdown, checksum, metadata_checksum, markdown_changed, last_seen,
            CAST(NULL AS TIMESTAMP) AS embedded_at FROM s""",
        "stream_embeddings": f"""WITH {SHOP}, {stored('s')}, c AS ({chunk_rows('s', rules.CHUNK_TOKENS)})
            SELECT page_url, chunk_index, text, {micros('vec')} AS vec FROM ({hash_vectors('c', 'page_url, chunk_index, text', 'text')})""",
    }
    # The given pages nest no dropped block in one of its like, so both extractors find the same text.
    found["main_text_tree"] = found["main_text"]
    found["stream_state_pages"], found["stream_state_chunks"] = found["stream_pages"], found["stream_embeddings"]
    return found
