"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licences import BASE, TEMPLATES
from .quality_rules import STOP_WORDS


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOPS = _sql_list(sorted({w for ws in STOP_WORDS.values() for w in ws}))

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least(coalesce(nxt - i, 5), 5)) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(ls, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ell,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_up,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_low
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         array_to_string(list_filter([
           CASE WHEN NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 20) THEN 'mean_word_chars' END,
           CASE WHEN n_symbols / greatest(n_words, 1) > 0.1 THEN 'symbol_ratio' END,
           CASE WHEN (n_stop + 0.5::DOUBLE) / greatest(n_words, 1) < 0.02::DOUBLE THEN 'stop_word_ratio' END,
           CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'dup_line_ratio' END,
           CASE WHEN n_up / greatest(n_up + n_low, 1) > 0.5 THEN 'upper_ratio' END,
           CASE WHEN n_ell / greatest(n_lines, 1) > 0.3 THEN 'ellipsis_line_ratio' END], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, failed_rules
FROM r
"""

def _op4() -> str:
    exact = [(" ".join(t.words), t.label, t in BASE) for t in TEMPLATES if t.exact]
    long = [(n, t.label, t.words) for n, t in enumerate(TEMPLATES) if not t.exact]
    phrases = ", ".join(f"('{p}', '{label}', {str(base).lower()}, {len(p.split())})" for p, label, base in exact)
    grams = ", ".join(f"({n}, '{label}', {i}, '{' '.join(ws[i:i + 4])}', {len(ws) - 3})" for n, label, ws in long for i in range(len(ws) - 3))
    sizes = ", ".join(map(str, sorted({4, *(len(p.split()) for p, _, _ in exact)})))
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
phrases(phrase, label, base, len) AS (VALUES {phrases}),
g AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(ws[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([{sizes}]) AS n))),
places AS (SELECT doc_id, pos, label, base FROM g JOIN phrases p ON g.n = p.len AND g.gram = p.phrase),
grams(template, label, t_at, gram, n_grams) AS (VALUES {grams}),
votes AS (SELECT doc_id, template, t.label, n_grams, t_at, pos - t_at AS diagonal FROM g JOIN grams t ON g.n = 4 AND g.gram = t.gram),
diagonals AS (SELECT doc_id, template, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS gap FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes)),
runs AS (SELECT doc_id, template, diagonal, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM diagonals),
spans AS (
  SELECT doc_id, v.label, count(DISTINCT t_at) / any_value(n_grams) AS cover
  FROM votes v JOIN runs USING (doc_id, template, diagonal) GROUP BY doc_id, template, v.label, run HAVING count(DISTINCT t_at) / any_value(n_grams) >= 0.6),
every AS (
  SELECT doc_id, label, base, pos, 1.0::DOUBLE AS cover FROM places
  UNION ALL SELECT doc_id, label, false, NULL, cover FROM spans),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score
  FROM every GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN found USING (doc_id)
"""


OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
p AS (
  SELECT *, CASE WHEN role = 'assistant' THEN [] ELSE regexp_extract_all(t, '!\[(?:image|audio|document)\]\([^()\s]+\)') END AS found FROM c),
q AS (
  SELECT conv_id, turn, role, t, CASE WHEN role = 'assistant' THEN t ELSE regexp_replace(t, '!\[(?:image|audio|document)\]\([^()\s]+\)', '', 'g') END AS rest, list_transform(found, lambda m: regexp_extract(m, '\[([a-z]+)\]', 1)) AS kinds,
         list_transform(found, lambda m: regexp_extract(m, '\[([a-z]+)\]', 1) || ':' || regexp_extract(m, '\(([^()\s]+)\)', 1)) AS refs FROM p),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS said,
         coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '') AS loss,
         sum(8 + length(role) + 1 + length(rest) + length(rest) - length(replace(replace(rest, chr(92), ''), '<', '')) + coalesce(list_sum(list_transform(kinds, lambda k: length(k) + 8)), 0) + 7) AS formatted_chars,
         sum(len(kinds)) AS n_attachments, coalesce(sum(list_sum(list_transform(kinds, lambda k: CASE k WHEN 'image' THEN 256 WHEN 'audio' THEN 128 ELSE 512 END))), 0) AS n_expanded,
         coalesce(string_agg(array_to_string(refs, ','), ',' ORDER BY turn, role, t) FILTER (len(refs) > 0), '') AS attachments
  FROM q GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, n_attachments::BIGINT AS n_attachments, n_expanded::BIGINT AS n_expanded, attachments
FROM a
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, (d.doc_id = r.c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP12 = r"""
WITH RECURSIVE crc(c, s, i, x) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(s[i // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE i < 8 * length(s))),
h AS (SELECT c, (xor(x, 4294967295) % 4)::INTEGER AS h FROM crc WHERE i = 8 * length(s)),
own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
  SELECT own.c, list_concat(coalesce(base.ts[1:h.h], []), own.ts[h.h + 1:]) AS ts
  FROM own JOIN h USING (c) LEFT JOIN own AS base ON base.c = own.c - own.c % 20),
member AS (SELECT c, d, ts[1:d] AS pre, len(ts) AS n FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
node AS (
  SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM member GROUP BY pre, d),
kids AS (SELECT p.conv_id, p.d, count(*) AS n FROM node p JOIN node k ON k.d = p.d + 1 AND k.pre[1:p.d] = p.pre GROUP BY p.conv_id, p.d),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (conv_id, d)),
up AS (SELECT pre[1:a] AS pre, a AS d, n_convs, words, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_)),
sums AS (SELECT pre, d, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM up GROUP BY pre, d)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums s ON s.d = f.d AND s.pre = f.pre LEFT JOIN node p ON p.d = f.d - 1 AND p.pre = f.pre[1:f.d - 1]
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

SQL: dict[str, str] = {"op10_minhash_near_dedup": OP10, "op12_burst_trie": OP12, "op13_pair_bound_search": OP13, "op4_licence_scan": _op4(), "op5_chat_format": OP5, "op6_quality_rules": OP6}
