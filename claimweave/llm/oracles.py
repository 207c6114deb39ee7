"""SQL that computes whole results of operators that SQL can state."""

from __future__ import annotations

from claimweave.llm.rules import RULES, STOP_WORDS, WINDOW

WORDS = r"list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _stops() -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()})) + "]"


def _fails() -> str:
    parts = []
    for r in RULES:
        tests = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM p),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS o) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: list_contains({_stops()}, regexp_replace(lower(x), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}\p{{Lu}}+\P{{L}}*$'))) AS n_capital,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) AS n_bullet
  FROM d JOIN l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
r AS (SELECT *, n_repeat_words / NULLIF(n_words, 0) AS repeat_share, word_chars / NULLIF(n_words, 0) AS mean_word_chars, n_symbols / NULLIF(n_words, 0) AS symbols_per_word, n_stop / NULLIF(n_words, 0) AS stop_share,
  n_capital / NULLIF(n_words, 0) AS capital_share, n_doubled / NULLIF(n_words, 0) AS doubled_share, n_dup_lines / NULLIF(n_lines, 0) AS dup_line_share, n_ellipsis / NULLIF(n_lines, 0) AS ellipsis_line_share, n_bullet / NULLIF(n_lines, 0) AS bullet_line_share FROM m),
f AS (SELECT *, {_fails()} AS failed_rules, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND list_filter(string_split(failed_rules, ','), lambda x: x NOT IN ('', 'few_words', 'repeated_windows')) = [] AS kept, failed_rules FROM f
"""

_COMPONENTS = """reach(id, other) AS (SELECT a, a FROM ways UNION SELECT r.id, b.b FROM reach r JOIN ways b ON b.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
classes AS (SELECT min(doc_id) AS doc_id, s FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT doc_id, unnest(s) AS shingle FROM classes),
often AS (SELECT shingle FROM x GROUP BY shingle HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN often USING (shingle)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM y a JOIN y b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN classes p ON p.doc_id = a JOIN classes q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, COALESCE(l.component_id, c.doc_id, s.doc_id) AS component_id, s.doc_id = COALESCE(l.component_id, c.doc_id, s.doc_id) AS kept
FROM s LEFT JOIN classes c ON c.s = s.s LEFT JOIN least l ON l.id = c.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a)
SELECT e.vec_id, COALESCE(c.n, 0) AS n_links, COALESCE(l.component_id, e.vec_id) AS component_id, e.vec_id = COALESCE(l.component_id, e.vec_id) AS kept FROM embeddings e LEFT JOIN counts c ON c.id = e.vec_id LEFT JOIN least l ON l.id = e.vec_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    bits = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _least(*labels: str) -> str:
    """The least of labels (cost, audit) in a list that may hold nulls."""
    return f"list_min(list_filter([{', '.join(labels)}], lambda l: l IS NOT NULL))"


def _plus(label: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {label} IS NOT NULL THEN {{'c': {label}.c + {cost}, 'a': {label}.a || '{letter}'}} END"


def _inserted(n: str, s: str, u: str, a: str) -> str:
    """Labels of the four states (nothing, system, open, answered) with turns inserted, twice."""
    once_u = _least(u, _plus(n, "2", "I"), _plus(s, "2", "I"), _plus(a, "2", "I"))
    return f"SELECT *, {once_u} AS u1, {_least(a, _plus(u, '2', 'I'))} AS a1"


#: The best label of each state after each turn; the four labels are carried through the turns in order.
REPAIR = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {_crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM d),
k AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS twice, trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS o, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS po FROM r),
ids AS (SELECT conv_id, max(i) AS n FROM (SELECT conv_id, 0 AS i FROM conversations UNION ALL SELECT conv_id, i FROM k) GROUP BY conv_id),
w(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) FROM ids
  UNION ALL
  SELECT conv_id, i + 1, {_plus("n", "3", "D")},
    {_least(_plus("s", "3", "D"), f"CASE WHEN NOT gone AND o = 's' THEN {_plus('n', 'late', 'K')} END")},
    {_least(_plus("u2", "3", "D"), f"CASE WHEN NOT gone AND o = 'u' THEN {_least(_plus('n', 'late', 'K'), _plus('s', 'late', 'K'), _plus('a2', 'late', 'K'))} END", f"CASE WHEN NOT gone THEN {_least(_plus('n', '2 + late', 'R'), _plus('s', '2 + late', 'R'), _plus('a2', '2 + late', 'R'))} END")},
    {_least(_plus("a2", "3", "D"), f"CASE WHEN NOT gone AND o = 'a' THEN {_plus('u2', 'late', 'K')} END", f"CASE WHEN NOT gone THEN {_plus('u2', '2 + late', 'R')} END")}
  FROM (SELECT *, {_least("u1", _plus("a1", "2", "I"))} AS u2, {_least("a1", _plus("u1", "2", "I"))} AS a2 FROM ({_inserted("n", "s", "u", "a")} FROM (SELECT w.*, k.o, k.blank OR k.twice AS gone, CAST(k.cut AS BIGINT) AS late FROM w JOIN k ON k.conv_id = w.conv_id AND k.i = w.i + 1)))),
best AS (SELECT conv_id, {_least("n", "a1", _plus("u1", "2", "I"))} AS l FROM ({_inserted("n", "s", "u", "a")} FROM (SELECT w.* FROM w JOIN ids USING (conv_id) WHERE w.i = ids.n))),
e AS (SELECT conv_id, l.a AS audit, unnest(range(1, length(l.a) + 1)) AS p FROM best),
g AS (SELECT *, substr(audit, p, 1) AS letter, CAST(length(replace(left(audit, p), 'I', '')) AS BIGINT) AS i, length(replace(left(audit, p - 1), 'D', '')) AS place FROM e),
h AS (SELECT g.conv_id, p, place, letter, k.o, CASE WHEN letter = 'K' THEN k.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE k.text END AS text FROM g LEFT JOIN k ON k.conv_id = g.conv_id AND k.i = g.i AND letter <> 'I' WHERE letter <> 'D'),
x AS (SELECT *, max(CAST(place = 0 AND letter = 'K' AND o = 's' AS BIGINT)) OVER (PARTITION BY conv_id) AS sys FROM h),
z AS (SELECT conv_id, sha256(string_agg(COALESCE(role, CASE WHEN (place - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM x GROUP BY conv_id),
c AS (SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(sum(CAST(blank AS BIGINT)) AS BIGINT) AS blank, CAST(sum(CAST(twice AS BIGINT)) AS BIGINT) AS duplicate, CAST(sum(CAST(cut AS BIGINT)) AS BIGINT) AS truncated,
  CAST(sum(CAST(i > 1 AND po || o NOT IN ('su', 'ua', 'au') AS BIGINT)) AS BIGINT) AS illegal FROM k GROUP BY conv_id)
SELECT b.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, b.l.c AS cost, b.l.a AS audit, COALESCE(repaired_sha256, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN c USING (conv_id) LEFT JOIN z USING (conv_id)
"""

TRIE = f"""
WITH o AS (SELECT conv_id, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS digest, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM o),
ids AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT i.conv_id, 0 AS part, pos, digest, size FROM ids i JOIN p ON p.conv_id = i.conv_id - i.conv_id % 5 AND p.pos <= i.h UNION ALL SELECT i.conv_id, 1, pos, digest, size FROM ids i JOIN p ON p.conv_id = i.conv_id AND p.pos > i.h),
c AS (SELECT conv_id, size, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, size, depth, path FROM c UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
n AS (SELECT depth, path, left(path, 64 * (depth - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY depth, path),
born AS (SELECT up AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
q AS (SELECT n.*, COALESCE(b.n, 0) AS n_children FROM n LEFT JOIN born b ON b.path = n.path),
under AS (SELECT left(path, 64 * a) AS path, CAST(sum(CAST(n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM q) GROUP BY left(path, 64 * a)),
last AS (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY path)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, COALESCE(ends_sha256, sha256('')) AS ends_sha256
FROM q JOIN under USING (path) LEFT JOIN ends USING (path) LEFT JOIN n u ON q.depth > 0 AND u.path = q.up
"""
