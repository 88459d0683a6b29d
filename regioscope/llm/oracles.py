"""DuckDB twins of the queries that SQL can express, on the same tables."""


def _components(links: str, nodes: str) -> str:
    """CTEs: ``comp`` (id, component) over symmetric ``links`` (a, b)."""
    return f"""
reach(id, root) AS (
  SELECT id, id FROM ({nodes})
  UNION
  SELECT l.b, r.root FROM reach r JOIN ({links}) l ON l.a = r.id WHERE r.root < l.b),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_components('SELECT a, b FROM links', 'SELECT vec_id AS id FROM embeddings').strip()}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id,
       vec_id = component AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

# the pages of these tables hold one article of headings and paragraphs each
OP4 = r"""
WITH b AS (
  SELECT page_id, url, regexp_split_to_array(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
t AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'),
    '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM t
"""

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
           GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{_components('SELECT a, b FROM links', 'SELECT doc_id AS id FROM documents').strip()}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept
FROM documents JOIN comp ON comp.id = doc_id LEFT JOIN n USING (doc_id)
"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

OP7 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
d AS (
  SELECT h, string_agg(substr({_BASE32}, 1 + CAST(
      (CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1),
      '' ORDER BY i) AS digest
  FROM (SELECT DISTINCT h FROM p), range(32) t(i) GROUP BY h)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (html) JOIN d USING (h)
"""

_OP9_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_OP9_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 13) AS width, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, i, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS t
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM dw, (SELECT DISTINCT width FROM win) WHERE len(w) >= width)),
hits AS MATERIALIZED (SELECT doc_id, i, width, item_id FROM dwin JOIN win USING (width, t)),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM hits) GROUP BY 1),
f AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""

OP10 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m
  FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(x) >= 400)),
again AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS fresh
        FROM win SEMI JOIN again USING (m)),
num AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS MATERIALIZED (SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM num GROUP BY ALL),
gap AS (SELECT doc_id, k, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS a, s AS b FROM span
        UNION ALL SELECT doc_id, max(k) + 1, max(e), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY k) AS y
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _rounds(n: int, k: int) -> str:
    """CTEs c0 .. cn: centroids (cluster, c) before and after ``n`` rounds."""
    parts = [f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM v
  ORDER BY sha256('1:' || vec_id) LIMIT {k})"""]
    for i in range(n):
        parts.append(f"""
a{i} AS MATERIALIZED ({_nearest(f'c{i}')}),
s{i} AS (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY cluster, j),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return ",".join(parts)


def _nearest(centroids: str) -> str:
    square = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return (f"SELECT vec_id, any_value(v) AS v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster "
            f"FROM (SELECT vec_id, v, cluster, CAST({square} AS BIGINT) AS d FROM v, {centroids}) GROUP BY vec_id")


OP11 = f"""
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM e),
{_rounds(3, 16).strip()},
f AS MATERIALIZED ({_nearest('c3')}),
h AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM f JOIN h USING (cluster)
"""

_OP12_TERMS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP12 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_OP12_TERMS} AS t FROM documents),
g AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM d),
m AS (SELECT doc_id, CAST(10 + (90 * len(t) * n_docs) // n_terms AS BIGINT) AS m FROM d, g WHERE len(t) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_OP12_TERMS}) AS term FROM benchmark)),
p AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, g GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP13_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_OP13_CHARS = "length(regexp_replace({0}, '[\\x20\\x09-\\x0D]', '', 'g'))"


def _removed(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


# the line rules as line_rules.py states them
OP13 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_OP13_WORDS.format("coalesce(text, '')")} AS w
  FROM documents),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (
    SELECT r, i, list_slice(w, i, i + 2) AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM g WHERE c > 1) GROUP BY r),
l AS (
  SELECT r, line, {_OP13_CHARS.format('line')} AS chars, len({_OP13_WORDS.format('line')}) AS n,
    {_removed('line', '|›»·•→>')} AS seps, {_removed('line', '#*$%&|<>')} AS symbols
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
v AS (
  SELECT r, line, chars,
    NOT (regexp_matches(line, '[.!?:;…。！？]["''“”’»)\]]*[\x20\x09-\x0D]*\z') AND 10 * symbols <= chars)
    OR (seps >= 2 AND 5 * seps >= n)
    OR (n <= 20 AND regexp_matches(line, '(?i)all rights reserved|copyright|©|privacy policy|terms of (use|service)'
      || '|cookie|javascript|lorem ipsum|sign (in|up)|log ?in|subscribe|newsletter|click here|skip to|read more')) AS fails
  FROM l),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS failed,
    coalesce(sum(chars) FILTER (fails), 0) AS lost FROM v GROUP BY r),
o AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_OP13_CHARS.format('t')} AS BIGINT) AS word_chars,
    CAST({_removed('t', '#*$%&|<>')} AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM o
"""
