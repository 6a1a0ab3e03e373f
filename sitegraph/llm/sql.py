"""The queries of this subpackage as SQL, where SQL can express them."""

from __future__ import annotations

from sitegraph.llm import spaced_seeds as seeds
from sitegraph.llm import license_scan as licenses
from sitegraph.llm.license_rules import CUES, LAST, PLAIN_NAMES, RULES, SENTENCES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    normal = "l"
    for pattern, new in licenses.NORMAL:
        normal = f"regexp_replace({normal}, {quoted(pattern)}, {quoted(new)}, 'g')"
    version, later = f" (?:{licenses.VERSION}) ", f" (?:{licenses.LATER}) $"

    def looked_up(keys: dict[str, str], key: str) -> str:
        return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in keys.items()) + " END"

    def version_of(part: str) -> str:
        major, minor = (f"regexp_extract({part}, {quoted(licenses.NUMBER)}, {i})" for i in (1, 2))
        return f"CASE WHEN {major} = '' THEN '' ELSE {major} || '.' || CASE WHEN {minor} = '' THEN '0' ELSE {minor} END END"

    plain = looked_up({key: family for key, family in licenses.name_keys().items() if family in PLAIN_NAMES}, "n")
    core = f"regexp_replace(n, {quoted(f' (?:{licenses.LATER}|only) $')}, '')"
    family = looked_up(licenses.name_keys(), f"regexp_replace({core}, {quoted(version + '$')}, '')")
    number = version_of(f"regexp_extract({core}, {quoted(version + '$')}, 0)")
    suffix = f"CASE WHEN regexp_matches(n, {quoted(later)}) THEN '-or-later' WHEN regexp_matches(n, ' only $') THEN '-only' ELSE '' END"
    name = f"coalesce({plain}, {family} || CASE WHEN {number} = '' THEN '' ELSE '-' || {number} END || {suffix})"
    key = looked_up(licenses.sentence_keys(SENTENCES), f"regexp_replace(p, {quoted(version)}, ' # ', 'g')")
    part = f"""CASE WHEN {key} IS NOT NULL THEN [replace({key}, '#', {version_of('p')})]
               ELSE list_transform(regexp_extract_all(p, {quoted(f" {licenses.name_pattern()} ")}), lambda n: {name}) END"""
    matched = "' ' || array_to_string(ids, '  ') || ' '"
    for rule, sequence in RULES:
        matched = f"replace({matched}, {quoted(''.join(f' {x} ' for x in sequence))}, {quoted(f' |{rule}| ')})"
    cue = "|".join(c.replace(" ", "  ") for c in CUES)
    return f"""
    WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents),
    sentences AS (
      SELECT doc_id, CASE WHEN regexp_matches(l, {quoted(licenses.cue_pattern(SENTENCES))})
                     THEN list_transform(string_split({normal}, '|'), lambda s: ' ' || trim(s) || ' ') ELSE []::VARCHAR[] END AS ss
      FROM low
    ), parts AS (
      SELECT doc_id, list_transform(ss, lambda s: {{'cue': regexp_matches(s, {quoted(cue)}), 'ps': regexp_extract_all(s, {quoted(licenses.known_pattern(SENTENCES))})}}) AS ss
      FROM sentences
    ), named AS (
      SELECT doc_id, list_transform(ss, lambda s: {{'cue': s.cue, 'ids': flatten(list_transform(s.ps, lambda p: {part}))}}) AS ss FROM parts
    ), ids AS (
      SELECT doc_id, flatten(list_transform(ss, lambda s: CASE WHEN len(s.ids) > 0 THEN s.ids WHEN s.cue THEN ['?'] ELSE []::VARCHAR[] END)) AS ids FROM named
    ), matched AS (
      SELECT doc_id, ids, list_filter(string_split(CASE WHEN len(ids) > 0 THEN {matched} ELSE '' END, ' '), lambda p: p <> '') AS items FROM ids
    ), found AS (
      SELECT *, list_distinct(list_transform(list_filter(items, lambda p: starts_with(p, '|')), lambda p: replace(p, '|', ''))) AS f FROM matched
    )
    SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
           array_to_string(list_sort(list_filter(f, lambda x: len(f) = 1 OR x <> {quoted(LAST)})), ',') AS licenses,
           CAST(len(list_filter(items, lambda p: NOT starts_with(p, '|'))) AS BIGINT) AS n_unmatched
    FROM found
    """


def spaced_seeds() -> str:
    pairs = [(w, m, at) for w in range(seeds.SHORTEST, seeds.WIDTH + 1) for m, at in enumerate(seeds.masks(w))]
    rows = ", ".join(f"({w}, {m}, {at})" for w, m, at in pairs)
    tokens = "regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\\p{L}\\p{M}\\p{N}]+')"
    return f"""
    WITH d AS (SELECT doc_id, {tokens} AS t FROM documents),
    b AS (SELECT item_id, t, len(t) AS n, least(len(t), {seeds.WIDTH}) AS w FROM (SELECT item_id, {tokens} AS t FROM benchmark)),
    masks AS (SELECT * FROM (VALUES {rows}) AS v(w, m, places) WHERE w IN (SELECT w FROM b)),
    bw AS (
      SELECT item_id, n, b.w, m, q, t[q + 1 : q + b.w] AS win, array_to_string(list_transform(places, lambda i: t[q + 1 + i]), ' ') AS key
      FROM (SELECT *, unnest(range(n - w + 1)) AS q FROM b WHERE n >= {seeds.SHORTEST}) b JOIN masks USING (w)
    ), dp AS (SELECT doc_id, t, w, unnest(range(greatest(len(t) - w + 1, 0))) AS p FROM d, (SELECT DISTINCT w FROM masks)),
    dw AS (
      SELECT doc_id, dp.w, m, t[p + 1 : p + dp.w] AS win, array_to_string(list_transform(places, lambda i: t[p + 1 + i]), ' ') AS key
      FROM dp JOIN masks USING (w)
    ), hits AS (
      SELECT doc_id, item_id, n, bw.w, q, len(list_filter(range(bw.w), lambda i: dw.win[i + 1] = bw.win[i + 1])) AS matches
      FROM dw JOIN bw ON dw.w = bw.w AND dw.m = bw.m AND dw.key = bw.key
    ), found AS (SELECT * FROM hits WHERE matches >= w - CASE WHEN w = {seeds.WIDTH} THEN {seeds.SUBSTITUTIONS} ELSE 0 END)
    SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS item_words, CAST(count(DISTINCT q) AS INTEGER) AS n_windows,
           CAST(max(matches) AS INTEGER) AS best_matches,
           CAST(len(list_distinct(flatten(list(range(q, q + w))))) AS INTEGER) AS n_covered
    FROM found GROUP BY doc_id, item_id
    """


URL_LISTS = """
WITH captures AS (
  SELECT row_number() OVER () AS row, page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(url), 1, 4))::INT % 360 AS INT) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages
), named AS (SELECT *, string_split(host, '.') AS labels, host || CASE WHEN len(segs) > 0 THEN '/' || segs[1] ELSE '' END AS section FROM captures),
reports AS (
  SELECT 'block' AS list, 'add' AS action, host AS key, day FROM named WHERE url LIKE '%utm_source=%'
  UNION ALL SELECT 'block', 'remove', host, day FROM named WHERE regexp_matches(url, '#top$')
  UNION ALL SELECT 'block', 'add', section, day FROM named WHERE regexp_matches(url, '[.]html$')
  UNION ALL SELECT 'block', 'remove', section, day FROM named WHERE regexp_matches(url, '/$')
  UNION ALL SELECT 'allow', 'add', section, day FROM named WHERE regexp_matches(url, '[?]page=')
  UNION ALL SELECT 'allow', 'remove', section, day FROM named WHERE regexp_matches(url, '//m[.].*[.]html$')
  UNION ALL SELECT 'allow', 'add', host, day FROM named WHERE regexp_matches(url, '//blog[.].*/$')
  UNION ALL SELECT 'block', 'add', array_to_string(labels[-2:], '.'), day FROM named WHERE regexp_matches(url, '//blog[.].*[.]html$')
), daily AS (SELECT list, key, day, max(action) AS action FROM reports GROUP BY ALL),
intervals AS (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM daily),
keyed AS (
  SELECT row, day, unnest(keys) AS key, generate_subscripts(keys, 1) AS rank
  FROM (SELECT row, day, list_concat(list_transform(range(len(segs), 0, -1), lambda n: host || '/' || array_to_string(segs[1:n], '/')),
                                     list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS keys
        FROM named WHERE host <> '')
), best AS (
  SELECT row, k.key, i.list, i.day AS since
  FROM keyed k JOIN intervals i ON i.key = k.key AND i.action = 'add' AND k.day >= i.day AND (i.until IS NULL OR k.day < i.until)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY rank, i.list DESC) = 1
)
SELECT page_id, url, CAST(c.day AS VARCHAR) AS fetched_on, coalesce(list, 'none') AS verdict, key AS rule_key, CAST(since AS VARCHAR) AS rule_since
FROM captures c LEFT JOIN best USING (row)
"""


def drift_clusters(k: int = 40, rounds: int = 5) -> str:
    """Every round compares all vectors with all centroids."""
    steps = ["""
    points AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    )""", f"""
    c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM points
      QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {k}
    )"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT row, vec_id, v, min(struct_pack(d := d, cluster := cluster)) AS best
      FROM (SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM points, c{i})
      GROUP BY row, vec_id, v
    )""")
        if i < rounds:
            steps.append(f"""
    c{i + 1} AS MATERIALIZED (
      SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
        SELECT cluster, list(m ORDER BY j) AS m FROM (
          SELECT cluster, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
          FROM (SELECT best.cluster AS cluster, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY cluster, j
        ) GROUP BY cluster
      ) USING (cluster)
    )""")
    return f"""
    WITH {",".join(steps)}
    SELECT vec_id, cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM (SELECT *, best.cluster AS cluster FROM a{rounds}) JOIN c{rounds} USING (cluster)
    """


def spelling_variants() -> str:
    """Near words by deleting one character, CRC-32 byte by byte, roots by recursion."""
    letters = "[A-Za-z\u00C0-\u00FF]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE crc_table AS (
      SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
      FROM range(256) r(i)
    ), runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, {quoted(letters)})), '{upper}', '{upper.lower()}') AS run FROM documents WHERE text IS NOT NULL
    ), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
      FROM (SELECT run, n, list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1),
                                          lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM counted), crc_table
    ), words AS MATERIALIZED (
      SELECT word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), less AS MATERIALIZED (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
      SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
      UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
    ), best AS (
      SELECT word, n, count(other) AS n_near, min(struct_pack(less := -other_n, other := encode(other))) AS b FROM words LEFT JOIN near USING (word) GROUP BY word, n
    ), formed AS MATERIALIZED (
      SELECT word, n, n_near, CASE WHEN -b.less >= 10 * n THEN decode(b.other) END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n FROM best
    ), chain AS (
      SELECT word, word AS root FROM formed
      UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
    )
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (
      SELECT chain.word, root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL
    ) c USING (word)
    """


def oracle() -> dict[str, str]:
    return {"op1_spaced_seeds": spaced_seeds(), "op2_url_lists": URL_LISTS, "op3_license_scan": license_scan(),
            "op12_drift_clusters": drift_clusters(), "op13_spelling_variants": spelling_variants()}
