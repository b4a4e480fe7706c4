"""Check SQL for DuckDB, over the same tables as the queries."""

_RHO = "CASE WHEN {room} = 0 THEN 1e-4 ELSE least(greatest({excess} / {room}, 1e-4), 0.5) END"


def _level(n: str, bad: str, mean: str) -> str:
    """The overdispersion of a level's children around their parent's rate."""
    excess = f"sum(({bad} - {n} * {mean}) * ({bad} - {n} * {mean}) - {n} * {mean} * (1 - {mean}))"
    return _RHO.format(excess=excess, room=f"sum({n} * ({n} - 1) * {mean} * (1 - {mean}))")


URL_FILTERS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcome AS (
  SELECT p.host, CAST(l.quality = 0 OR l.toxic = 1 AS BIGINT) AS bad
  FROM parsed p LEFT JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.path, '[0-9]+') AS BIGINT)),
hosts AS (
  SELECT host, string_split(host, '.')[-1] AS suffix,
         array_to_string(string_split(host, '.')[-2:], '.') AS domain,
         count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM outcome GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS d_n, sum(bad) AS d_bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(d_n) AS s_n, sum(d_bad) AS s_bad FROM domains GROUP BY ALL),
total AS (SELECT CASE WHEN sum(s_n) > 0 THEN sum(s_bad) / sum(s_n) ELSE 0.0 END AS m FROM suffixes),
w_s AS (SELECT 1 / ({_level('s_n', 's_bad', 'm')}) - 1 AS w FROM suffixes, total),
s_rate AS (SELECT *, CASE WHEN s_n > 0 THEN s_bad / s_n ELSE m END AS raw,
                  (m * w + s_bad) / (w + s_n) AS shrunk FROM suffixes, total, w_s),
w_d AS (SELECT 1 / ({_level('d_n', 'd_bad', 'raw')}) - 1 AS w
        FROM domains JOIN s_rate USING (suffix)),
d_rate AS (SELECT d.*, CASE WHEN d_n > 0 THEN d_bad / d_n ELSE s.m END AS raw,
                  (s.shrunk * w_d.w + d_bad) / (w_d.w + d_n) AS shrunk
           FROM domains d JOIN s_rate s USING (suffix), w_d),
w_h AS (SELECT 1 / ({_level('n', 'bad', 'raw')}) - 1 AS w
        FROM hosts JOIN d_rate USING (suffix, domain)),
ab AS (SELECT host, n, shrunk * w + bad AS a, (1 - shrunk) * w + n - bad AS b
       FROM hosts JOIN d_rate USING (suffix, domain), w_h),
judged AS (
  SELECT host, n, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound
  FROM ab),
listed AS (
  SELECT page_id, host, path,
         host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com,
         host = 'example.org' OR host LIKE '%.example.org' AS example FROM parsed),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN example AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN example AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN com AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN com AND path LIKE '/de/%' THEN 'com/de/'
              WHEN org AND path LIKE '/%' THEN 'org/' END AS rule FROM listed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict, n AS labelled
FROM ruled JOIN judged USING (host)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""
WITH docs AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('1:' || doc_id) AS key, text
              FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
                   3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)
             - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE weight * (
           SELECT max(level) FROM levels WHERE level * weight <= cap) END AS target FROM levels),
parts AS (SELECT *, round(target)::BIGINT AS words,
                 CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole
          FROM aims),
running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, md5(d.text)
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM running
"""

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 AS r
          FROM windows),
covered AS (SELECT doc_id, r OR coalesce(lag(r) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS r
            FROM twice WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (r) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(d.d, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(d.n, 0) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals,
         length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS letters
  FROM docs LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words
         AND 100 * n_symbols <= 40 * n_words AND 100 * n_dup_lines <= 50 * n_lines
         AND 100 * lettered >= 60 * n_words AND 100 * capitals <= 60 * letters AS kept
FROM based
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.replace("text", _LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                                         lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM docs d LEFT JOIN shingles s USING (doc_id) GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
           WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS reached FROM docs
          UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.reached)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(reached) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000
                     THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url FROM m
"""

VECTOR_SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id,
                  list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
           FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_LOWER = ("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

PHRASES = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w[i:i + k - 1] AS p FROM places, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, p, len(p) AS k, array_to_string(p, ' ') AS phrase, count(*) AS a
      FROM grams GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (SELECT lang, p, phrase, a, unnest(range(1, k)) AS c FROM f),
scores AS (
  SELECT x.lang, x.phrase, x.a, x.c, u.a AS l, v.a AS r, n,
         CAST((1000::HUGEINT * x.a * n) // (u.a::HUGEINT * v.a) AS BIGINT) AS score
  FROM cuts AS x JOIN f AS u ON u.lang = x.lang AND u.p = x.p[1:c]
       JOIN f AS v ON v.lang = x.lang AND v.p = x.p[c + 1:] JOIN total AS t ON t.lang = x.lang),
lowest AS (SELECT * FROM scores
           QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
lone AS (SELECT * FROM lowest AS x WHERE NOT EXISTS (
  FROM f AS y WHERE y.lang = x.lang AND 100 * y.a >= 100 * x.a AND length(y.phrase) > length(x.phrase)
    AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score FROM lone QUALIFY rank <= 2000
"""

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS words, least(len(w), 10) AS size
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
found AS (SELECT row, i, size, item FROM (
            SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
            FROM places, sizes WHERE i + size - 1 <= len(w)) JOIN windows USING (words, size)),
hits AS (SELECT row, count(*) AS n_hit FROM (
           SELECT DISTINCT row, unnest(range(i, i + size)) AS at FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """Name of a query to its SQL."""
    return {
        "op1_url_filters": URL_FILTERS,
        "op2_near_dedup": NEAR_DEDUP,
        "op5_mixing": MIXING,
        "op6_warc": WARC,
        "op8_vector_search": VECTOR_SEARCH,
        "op10_quality_rules": QUALITY_RULES,
        "op12_phrases": PHRASES,
        "op13_decontamination": DECONTAMINATION,
    }
