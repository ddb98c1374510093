"""The queries of this subpackage in DuckDB SQL, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op8_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
shared AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON keyed.key = shared.key
GROUP BY doc_id
"""

SQL["op2_quality_rules"] = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
worded AS (
    SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines
),
judged AS (
    SELECT *, length(array_to_string(words, '')) AS chars,
        len(words) > 0 AND (
            100 * length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) > 10 * length(array_to_string(words, ''))
            OR 100 * len(list_filter(words, lambda w: w IN ('|', '>', '<', '/', '-', '»', '«', '•', '·', '›'))) >= 20 * len(words)
            OR (len(words) >= 10 AND len(list_filter(words, lambda w: regexp_matches(w, '[.!?,;:]$'))) = 0)
            OR regexp_matches(lower(line), 'accept cookies|all rights reserved|click here|cookie policy|enable javascript|licensed under|lorem ipsum|privacy policy|released under the|sign up for|subscribe to our|terms of use')
        ) AS fails,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
    FROM worded
),
documents_judged AS (
    SELECT doc_id, sum(len(words)) AS n_words, sum(chars) AS word_chars,
        sum(length(regexp_replace(line, '[^#*$%&|<>]', '', 'g'))) AS n_symbols,
        count(*) FILTER (WHERE len(words) > 0 AND nth > 1) AS n_dup_lines,
        coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost_chars
    FROM judged GROUP BY doc_id
),
word_rows AS (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
),
windows AS (
    SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM word_rows WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
again AS (
    SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM windows
),
covered AS (
    SELECT doc_id, twice OR lag(twice, 1, false) OVER o OR lag(twice, 2, false) OVER o AS inside FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE inside) AS n FROM covered GROUP BY doc_id),
counted AS (SELECT d.*, coalesce(r.n, 0) AS n_repeat_words FROM documents_judged d LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, lost_chars::BIGINT AS lost_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept
FROM counted
"""

SQL["op10_warc"] = r"""
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
coded AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        (strpos('0123456789abcdef', hex[(5 * i) // 4 + 1]) - 1) * 16
        + greatest(strpos('0123456789abcdef', coalesce(nullif(hex[(5 * i) // 4 + 2], ''), '0')) - 1, 0)
    ) >> (3 - (5 * i) % 4)) % 32, 1)), '') AS payload_digest
    FROM payloads
),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM coded)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM largest
"""

SQL["op9_embedding_dedup"] = r"""
WITH RECURSIVE rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
usable AS (
    SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM rows
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
),
reached AS (
    SELECT a AS node, a AS other FROM links
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
),
labels AS (SELECT node, min(other) AS least_id FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least_id, vec_id) AS component_id, coalesce(least_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON vec_id = a LEFT JOIN labels ON vec_id = node
"""

SQL["op1_url_filters"] = r"""
WITH split AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
),
rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    coalesce(arg_max(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id
"""

SQL["op11_periodic_runs"] = r"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(
        list_prepend(n::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t
),
hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        xor(list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda crc, c: xor(crc // 256, t[(xor(crc, c) % 256)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS h
    FROM documents, crc_table
),
placed AS (SELECT *, len(words) AS n, h // 10 AS g, (h // 10) % nullif(len(words), 0) AS a FROM hashed),
spaced AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words
    FROM spaced
),
word_rows AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM texts),
-- A run of period q has at least max(12 - q, q) places whose word comes again q words later. Each such stretch holds
-- a window of six words that comes again q words later.
sixes AS (
    SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4, lead(w, 5) OVER o AS w5
    FROM word_rows WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
starts AS (
    SELECT a.doc_id, a.i, b.i - a.i AS q FROM sixes a JOIN sixes b
        ON a.doc_id = b.doc_id AND a.w = b.w AND a.w1 = b.w1 AND a.w2 = b.w2 AND a.w3 = b.w3 AND a.w4 = b.w4 AND a.w5 = b.w5 AND a.i < b.i
),
islands AS (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM starts
),
stretches AS (
    SELECT doc_id, q, min(i) AS first, count(*) + 5 + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12
),
runs AS (SELECT doc_id, first, length, min(q) AS period FROM stretches GROUP BY doc_id, first, length),
covered AS (SELECT DISTINCT doc_id, unnest(range(first + period, first + length)) AS i FROM runs),
collapsed AS (
    SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS left_text FROM word_rows t LEFT JOIN covered c ON t.doc_id = c.doc_id AND t.i = c.i
    WHERE c.i IS NULL GROUP BY t.doc_id
),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(first || ',' || length || ',' || period || chr(10), '' ORDER BY first, period) AS lines,
        first(first ORDER BY length DESC, first, period) AS start, first(period ORDER BY length DESC, first, period) AS period, max(length) AS length
    FROM runs GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_words, coalesce(l.n_runs, 0) AS n_runs, l.start::BIGINT AS start, l.length::BIGINT AS length, l.period::BIGINT AS period,
    (1000 * l.length // l.period)::BIGINT AS exponent_milli,
    sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(c.left_text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""

SQL["op13_hard_negatives"] = r"""
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER w AS rank, n.other_id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 5
"""


def _license_sql() -> str:
    """The templates are given as rows; all else is stated anew."""
    from spanloom.llm.license_scan import BASE, NOTICES

    templates, keys = [], []
    for t, template in enumerate((*BASE, *NOTICES)):
        templates.append(f"({t}, '{template.label}', {template.base}, '{template.notice}', {template.slack}, {len(template.keys)})")
        keys += [f"({t}, {k}, {begin}, '{' '.join(own)}')" for k, (begin, own) in enumerate(template.key_places())]
    return rf"""
WITH templates(t, label, base, notice, slack, n_keys) AS (VALUES {", ".join(templates)}),
keys(t, k, b, phrase) AS (VALUES {", ".join(keys)}),
texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
template_words AS (
    SELECT t, unnest(string_split(notice, ' ')) AS w, generate_subscripts(string_split(notice, ' '), 1) - 1 AS o FROM templates
),
vocabulary AS (SELECT DISTINCT w FROM template_words),
held AS (SELECT doc_id, unnest(list_distinct(words)) AS w FROM texts),
idf AS (
    SELECT v.w, length(bin(((SELECT count(*) FROM documents) + 1) // (count(h.w) + 1))) AS weight
    FROM vocabulary v LEFT JOIN held h ON v.w = h.w GROUP BY v.w
),
weighted AS (SELECT t, w, o, weight FROM template_words JOIN idf USING (w)),
anchors AS (
    SELECT t, w, o, weight FROM weighted JOIN keys USING (t) WHERE o >= b AND o < b + len(string_split(phrase, ' '))
    QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY weight DESC, o) = 1
),
indexed AS (
    SELECT * FROM (SELECT t, w, o, weight FROM weighted QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, o) <= 8)
    UNION SELECT * FROM anchors
),
totals AS (SELECT t, sum(weight) AS total FROM indexed GROUP BY t),
word_rows AS (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM texts
),
begins AS (
    SELECT r.doc_id, t, k, i AS begin, i - b AS place
    FROM word_rows r JOIN keys ON r.w = string_split(phrase, ' ')[1] JOIN texts x ON r.doc_id = x.doc_id
    WHERE array_to_string(x.words[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase
),
confirmed AS (
    SELECT c.doc_id, t, c.place
    FROM (SELECT DISTINCT doc_id, t, place FROM begins WHERE k = 0) c JOIN templates USING (t) JOIN begins b USING (doc_id, t)
    WHERE abs(b.place - c.place) <= slack GROUP BY c.doc_id, t, c.place, n_keys HAVING count(DISTINCT k) = n_keys
),
matched AS (
    SELECT DISTINCT c.doc_id, t, c.place, x.o, x.weight
    FROM confirmed c JOIN templates USING (t) JOIN indexed x USING (t) JOIN word_rows r ON r.doc_id = c.doc_id AND r.w = x.w
    WHERE abs(r.i - x.o - c.place) <= slack
),
scored AS (
    SELECT doc_id, t, sum(weight)::DOUBLE / any_value(total) AS score FROM matched JOIN totals USING (t) GROUP BY doc_id, t, place
),
told AS (
    SELECT doc_id, max(score) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels
    FROM scored JOIN templates USING (t) GROUP BY doc_id
),
places AS (
    SELECT doc_id, count(*) AS n_base, min(begin) AS first_word, max(begin) AS last_word FROM begins JOIN templates USING (t) WHERE base GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN places USING (doc_id)
"""


SQL["op12_license_scan"] = _license_sql()
