"""What SQL can say of the operators: the same rows, computed plainly."""

from __future__ import annotations

from paperloom.llm import disclosure, licenses, ranking, substrings, tries


def substring_dedup(window: int = substrings.WINDOW) -> str:
    """Every window as a string, the smallest document of each, and the words that no later window covers."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d), x AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS words FROM s),
f AS (SELECT words, min(doc_id) AS least FROM x GROUP BY words), late AS (SELECT doc_id, i FROM x JOIN f USING (words) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM late), each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def license_scan(base: tuple = licenses.BASE, more: tuple = licenses.TEMPLATES) -> str:
    """Every pair of words against every pair of every template, and every stretch of neighbouring diagonals."""
    listed = ", ".join(f"({t}, '{label}', {str(t < len(base)).lower()}, '{text}')" for t, (label, text) in enumerate((*base, *more)))
    return f"""WITH v AS (SELECT *, string_split(phrase, ' ') AS w FROM (VALUES {listed}) AS v(template, label, is_base, phrase)),
t AS (SELECT template, label, is_base, len(w) - 1 AS pairs, w, unnest(range(1, len(w))) AS k FROM v), tp AS (SELECT template, label, is_base, pairs, k - 1 AS spot, w[k] AS a, w[k + 1] AS b FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM d), p AS (SELECT doc_id, k - 1 AS word, w[k] AS a, w[k + 1] AS b FROM i),
h AS (SELECT doc_id, template, label, is_base, pairs, spot, word, word - spot AS diagonal FROM p JOIN tp USING (a, b)),
g AS (SELECT doc_id, template, label, is_base, pairs, diagonal, count(*) AS n FROM h GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER a <= {licenses.GAP} THEN 0 ELSE 1 END AS begins FROM g WINDOW a AS (PARTITION BY doc_id, template ORDER BY diagonal)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT x.doc_id, x.template, x.pairs, x.diagonal AS d0, y.diagonal AS d1 FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.template = y.template AND x.run = y.run AND y.diagonal BETWEEN x.diagonal AND x.diagonal + {licenses.reach(base, more)}),
m AS (SELECT s.doc_id, s.template, s.pairs, d0, d1, count(DISTINCT spot) AS votes, max(word) + 2 - min(word) AS span FROM s JOIN h ON h.doc_id = s.doc_id AND h.template = s.template AND h.diagonal BETWEEN d0 AND d1 GROUP BY ALL),
b AS (SELECT doc_id, template, max(votes) AS most FROM m WHERE d0 = d1 OR span <= (pairs + 1) * {licenses.STRETCH} GROUP BY ALL),
l AS (SELECT b.doc_id, max(most / pairs) AS score, list(DISTINCT label) FILTER (most >= CASE WHEN pairs < {licenses.LONG} THEN pairs ELSE ceil(pairs * {licenses.SHARE}) END AND NOT is_base) AS own FROM b JOIN (SELECT DISTINCT template, label, is_base, pairs FROM tp) USING (template) GROUP BY b.doc_id),
q AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base FROM g WHERE is_base AND n = pairs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id)"""


def ranked_search(most: int = ranking.MOST) -> str:
    """Every term of every document, joined with the items' terms."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{ranking.UPPER}', '{ranking.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS w FROM documents), a AS (SELECT doc_id, w, len(w) AS size FROM d WHERE len(w) > 0), c AS (SELECT count(*) AS N, CAST(sum(size) AS BIGINT) AS L FROM a),
p AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, size, unnest(w) AS word FROM a) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS word FROM benchmark), v AS (SELECT item_id, word, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (word), c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * N) // L)))) AS BIGINT) AS score FROM v JOIN p USING (word), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {most}"""


def conversation_trie(family: int = tries.FAMILY, shared: int = tries.SHARED) -> str:
    """Every prefix of every rebuilt conversation as a string of hashes, and every node met with all nodes above it. CRC-32 goes bit by bit."""
    bits = "flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: {step}), 4294967295)"
    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, {crc} % {shared} AS h, conv_id - conv_id % {family} AS base FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
w AS (SELECT k.conv_id, pos AS depth, digest, bytes FROM k JOIN t ON t.conv_id = k.base AND pos <= taken UNION ALL SELECT k.conv_id, taken + pos - h, digest, bytes FROM k JOIN t ON t.conv_id = k.conv_id AND pos > h),
p AS (SELECT conv_id, depth, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, bytes FROM w UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
r AS (SELECT *, lag(node) OVER a AS parent, lead(node) OVER a IS NULL AS ends FROM p WINDOW a AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM r GROUP BY node),
m AS (SELECT n.*, count(x.node) AS n_children FROM n LEFT JOIN n x ON x.parent = n.node GROUP BY ALL),
u AS (SELECT p.node, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.bytes) AS BIGINT) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.node)
SELECT m.conv_id, m.depth, y.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN u USING (node) LEFT JOIN m y ON y.node = m.parent"""


def personal_data(support: int = disclosure.SUPPORT, share: float = disclosure.SHARE, near: int = disclosure.NEAR) -> str:
    """Matches and what stands between them, from the patterns as they are given; the company of every value; and how much each term tells of it."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    cut = " UNION ALL ".join(f"SELECT key, text, {k} AS kind, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS hits FROM t" for k, p in enumerate(patterns.values()))
    words = disclosure.BETWEEN_WORDS
    terms = lambda text: f"list_distinct(list_filter(string_split_regex(lower({text}), '{words}'), lambda w: length(w) >= {disclosure.LETTERS}))"
    starts = "coalesce(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY {} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece)"
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INT ELSE (substr(reverse(digits), i, 1)::INT * 2) // 10 + (substr(reverse(digits), i, 1)::INT * 2) % 10 END)) % 10 = 0"
    listed = lambda where: f"coalesce(string_agg(name || ':' || start || ':' || until, ',' ORDER BY kind, start) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(patterns))
    return f"""WITH t AS (SELECT md5(text) AS key, text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text), cut AS ({cut}),
e AS (SELECT key, kind, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece, unnest(list_concat(hits, [NULL])) AS hit FROM cut WHERE len(hits) > 0),
p AS (SELECT *, {starts.format('key, kind')} AS start, lead(piece) OVER (PARTITION BY key, kind ORDER BY i) AS next, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM e),
b AS (SELECT key, kind, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS until, CASE kind WHEN 0 THEN lower(hit) WHEN 1 THEN hit ELSE digits END AS value,
CASE WHEN length(piece) > {near} THEN regexp_replace(right(piece, {near}), '^\\p{{L}}+', '') ELSE piece END || ' ' || CASE WHEN length(next) > {near} THEN regexp_replace(left(next, {near}), '\\p{{L}}+$', '') ELSE next END AS company
FROM p WHERE hit IS NOT NULL AND CASE kind WHEN 0 THEN true WHEN 1 THEN list_max(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT)) <= 255 WHEN 2 THEN length(digits) BETWEEN {disclosure.CARD_DIGITS[0]} AND {disclosure.CARD_DIGITS[1]} AND {luhn} ELSE length(digits) BETWEEN {disclosure.PHONE_DIGITS[0]} AND {disclosure.PHONE_DIGITS[1]} END),
c AS (SELECT DISTINCT key, kind, value, unnest({terms('company')}) AS term FROM b), h AS (SELECT kind, value, sum(n) AS n_entity FROM (SELECT DISTINCT key, kind, value FROM b) JOIN t USING (key) GROUP BY ALL), m AS (SELECT kind, value, term, sum(n) AS met FROM c JOIN t USING (key) GROUP BY ALL HAVING count(*) >= {support}),
a AS (SELECT term, count(*) AS n_term FROM (SELECT unnest({terms('text')}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS N FROM documents),
d AS (SELECT kind, value, term FROM m JOIN h USING (kind, value) JOIN a USING (term), n WHERE N > n_entity AND log2(met * N::DOUBLE / (n_entity * n_term)) >= {share} * log2(N::DOUBLE / n_entity)),
k AS (SELECT DISTINCT key, term FROM c JOIN d USING (kind, value, term)), v AS (SELECT key, string_split_regex(text, '{words}') AS pieces, regexp_extract_all(text, '{words}') AS hits FROM t WHERE key IN (SELECT key FROM k)),
w AS (SELECT key, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece, unnest(list_concat(hits, [NULL])) AS hit FROM v), x AS (SELECT key, lower(piece) AS term, {starts.format('key')} AS until, piece FROM w),
y AS (SELECT key, 4 AS kind, CAST(until - length(piece) AS BIGINT) AS start, CAST(until AS BIGINT) AS until FROM x JOIN k USING (key, term)),
f AS (SELECT key, kind, start, until FROM b UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = y.key AND b.start <= y.start AND y.start < b.until)),
g AS (SELECT key, {counts}, sha256({listed('kind < 4')}) AS base_sha256, {listed('true')} AS spans FROM (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] AS name FROM f) GROUP BY key)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in patterns)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g ON g.key = md5(documents.text)"""
