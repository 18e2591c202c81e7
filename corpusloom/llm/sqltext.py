"""SQL that checks the queries."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (SELECT doc_id, {SPLIT.format(text=LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM both_in i JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)
),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH words AS (SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM windows) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM late),
kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) x
  ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_URL_PARTS = r"""translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS {p}host,
    regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS {p}path, regexp_extract({u}, '^.*?://[^/?#]*[^?#]*([^#]*)', 1, 's') AS {p}query"""
_PLAIN_PATH = r"""('/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace({x}, '/([.][.]?)$', '/\1/'), '/')[2:], lambda s: [s])),
    lambda done, s: CASE WHEN s[1] = '..' THEN done[:greatest(len(done) - 1, 0)] WHEN s[1] = '.' THEN done ELSE done || s END), '/'))"""


def _attribute(tag: str, name: str) -> str:
    form = rf"""'[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>][^\s>]*))'"""
    return "(" + " || ".join(f"regexp_extract({tag}, {form}, {i}, 'is')" for i in (1, 2, 3)) + ")"


def _tags(name: str) -> str:
    return rf"""regexp_extract_all(html, '<{name}\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>', 0, 'is')"""


def _decoded(text: str) -> str:
    for char, names in (('"', "quot|#34|#x22"), ("''", "apos|#39|#x27"), ("<", "lt|#60|#x3c"), (">", "gt|#62|#x3e"), ("&", "amp|#38|#x26")):
        text = f"regexp_replace({text}, '&(?:{names});', '{char}', 'gi')"
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EDGES = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, {_URL_PARTS.format(u="coalesce(url, '')", p='')}, coalesce(html, '') AS html FROM pages
),
pages_at AS (SELECT *, CASE WHEN host <> '' THEN host || {_PLAIN_PATH.format(x='path')} || query ELSE '' END AS address FROM parts),
targets AS (
  SELECT host, path, query, address, unnest(list_concat(
    list_transform(list_filter({_tags('link')}, lambda t: list_contains(string_split_regex(trim(lower({_attribute('t', 'rel')}), {_BLANKS}), '\s+'), 'canonical')),
      lambda t: {_attribute('t', 'href')}),
    list_transform(list_filter({_tags('meta')}, lambda t: trim(lower({_attribute('t', 'http-equiv')}), {_BLANKS}) = 'refresh'),
      lambda t: regexp_extract({_attribute('t', 'content')}, '\burl\s*=\s*["'']?([^"'']*)', 1, 'is')))) AS t
  FROM pages_at
),
decoded AS (SELECT host, path, query, address, {_decoded('t')} AS t FROM targets WHERE address <> ''),
full_targets AS (
  SELECT address AS a, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ''
    WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t WHEN t LIKE '?%' THEN 'http://' || host || path || t
    WHEN t LIKE '#%' THEN 'http://' || host || path || query
    ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS t FROM decoded
),
resolved AS (SELECT a, {_URL_PARTS.format(u='t', p='')} FROM full_targets),
edges AS (SELECT a, CASE WHEN host <> '' THEN host || {_PLAIN_PATH.format(x='path')} || query ELSE '' END AS b FROM resolved),
"""

URL_FILTER = _EDGES + r"""both_ways AS (SELECT a, b FROM edges WHERE b <> '' UNION SELECT b, a FROM edges WHERE b <> ''),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS address, regexp_extract(b, '^([^/?#]*)', 1) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
judged AS (
  SELECT x.host, x.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT host, path FROM pages_at UNION SELECT host, path FROM nodes) x
  JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)
  GROUP BY 1, 2
),
tainted AS (
  SELECT DISTINCT r.a AS address FROM reach r JOIN nodes n ON n.address = r.b JOIN judged j ON j.host = n.host AND j.path = n.path WHERE j.verdict = 'block'
)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, CASE WHEN t.address IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages_at p LEFT JOIN judged j ON j.host = p.host AND j.path = p.path LEFT JOIN tainted t ON t.address = p.address
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    md5(string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'), chr(2)) OVER (w ROWS UNBOUNDED PRECEDING)) AS h
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
),
whole AS (SELECT conv_id, n_turns, h FROM turns WHERE position = n_turns),
kept AS (
  SELECT conv_id FROM whole w WHERE NOT EXISTS (
    SELECT 1 FROM turns t WHERE t.h = w.h AND t.position = w.n_turns
      AND (t.n_turns > w.n_turns OR (t.n_turns = w.n_turns AND t.conv_id < w.conv_id)))
)
SELECT conv_id, position, n_turns, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM turns JOIN kept USING (conv_id)
"""


def _vector_codes() -> str:
    """Each round assigns all parts and moves the entries; the last one only assigns."""

    def near(r: int) -> str:
        return f"""
near{r} AS (
  SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, min(apart * 64 + entry) % 64 AS entry, min(apart) AS apart
  FROM (
    SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS apart
    FROM parts p JOIN book{r} b ON p.part = b.part
  ) GROUP BY vec_id, part
)"""

    def moved(r: int) -> str:
        return f"""
book{r + 1} AS (
  SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS x FROM (
      SELECT part, entry, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS mean
      FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM near{r}) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) m USING (part, entry)
)"""

    steps = ",".join([near(0), moved(0), near(1), moved(1), near(2)])
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT vec_id, label, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM kept, (SELECT unnest(range(16)) AS part)
),
book0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
),{steps},
rows AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(apart) AS error
  FROM near2 GROUP BY vec_id
)
SELECT vec_id, lower(code) AS code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM rows
"""


VECTOR_CODES = _vector_codes()

SOURCE_AUDIT = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
found AS (SELECT d, lang, source, unnest(w) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sources AS (
  SELECT s.lang, s.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) s LEFT JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY s.lang, s.source
),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (s.lang_total + 2 * s.v) AS q
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS one, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) z ON z.lang = a.lang AND z.one = a.source AND z.other = b.source
),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
