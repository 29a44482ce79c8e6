"""DuckDB SQL for the training-data queries that SQL can express."""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS opens FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n_text,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) AS n_role
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN opens THEN 12 + n_role + 1 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (opens) AS BIGINT) AS blocks
FROM e GROUP BY conv_id
"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1 : i + 20], ' ') ORDER BY doc_id, i) AS k FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM f WHERE k > 1),
u AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

QUALITY_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i + 1 : i + 8], ' ')) AS k FROM s),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM f WHERE k > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper,
    list_filter(list_transform(range((len(w) + 99) // 100), lambda k: w[k * 100 + 1 : k * 100 + 100]), lambda x: len(x) >= 50) AS stretches,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…»”"'')]\s*$'))) AS n_ended
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
), h AS (
  SELECT *, coalesce(list_sum(list_transform(stretches, lambda x: len(x))), 0) AS judged,
    coalesce(list_sum(list_transform(stretches, lambda x: len(list_distinct(x)))), 0) AS fresh FROM c
), v AS MATERIALIZED (
  SELECT *, [
    CASE WHEN n_words = 0 THEN 0 WHEN n_symbols * 20 > n_words THEN -1 WHEN n_symbols * 100 <= n_words THEN 1 ELSE 0 END,
    CASE WHEN n_words = 0 THEN 0 WHEN letters * 100 < word_chars * 88 THEN -1 WHEN letters * 100 >= word_chars * 94 THEN 1 ELSE 0 END,
    CASE WHEN letters = 0 THEN 0 WHEN upper * 10 > letters * 3 THEN -1 WHEN upper * 10 < letters THEN 1 ELSE 0 END,
    CASE WHEN judged = 0 THEN 0 WHEN fresh * 100 < judged * 45 THEN -1 WHEN fresh * 100 >= judged * 60 THEN 1 ELSE 0 END,
    CASE WHEN n_words < 50 THEN 0 WHEN n_repeat_words * 100 > n_words * 20 THEN -1 WHEN n_repeat_words * 100 <= n_words * 2 THEN 1 ELSE 0 END,
    CASE WHEN n_lines < 4 THEN 0 WHEN n_dup_lines * 10 > n_lines * 4 THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END,
    CASE WHEN n_lines < 2 THEN 0 WHEN n_ended * 100 < n_lines * 50 THEN -1 WHEN n_ended * 100 >= n_lines * 85 THEN 1 ELSE 0 END,
    CASE WHEN n_words = 0 THEN 0 WHEN word_chars * 10 < n_words * 22 OR word_chars > n_words * 12 THEN -1 WHEN word_chars >= n_words * 3 AND word_chars <= n_words * 8 THEN 1 ELSE 0 END
  ] AS votes FROM h
), p AS MATERIALIZED (SELECT list({'v': votes, 'n': n} ORDER BY votes) AS ps FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes)),
e AS (
  SELECT 0 AS k, 0.8::DOUBLE AS prior, list_transform(range(8), lambda j: 0.999::DOUBLE) AS good, list_transform(range(8), lambda j: 0.9::DOUBLE) AS bad
  UNION ALL
  SELECT k + 1, (list_sum(list_transform(post, lambda x: x.n * x.q)) + 1.6) / (list_sum(list_transform(post, lambda x: x.n)) + 2),
    list_transform(gs, lambda x: (x.passed + (x.given * 0.003 + 4) / 2) / (x.given + x.given * 0.003 + 4)),
    list_transform(bs, lambda x: (x.passed + (x.given * 0.003 + 4) / 2) / (x.given + x.given * 0.003 + 4))
  FROM (SELECT k, post,
    list_transform(range(8), lambda j: {
      'given': list_sum(list_transform(post, lambda x: CASE WHEN x.v[j + 1] <> 0 THEN x.n * x.q ELSE 0 END)),
      'passed': list_sum(list_transform(post, lambda x: CASE WHEN x.v[j + 1] > 0 THEN x.n * x.q ELSE 0 END))}) AS gs,
    list_transform(range(8), lambda j: {
      'given': list_sum(list_transform(post, lambda x: CASE WHEN x.v[j + 1] <> 0 THEN x.n * (1 - x.q) ELSE 0 END)),
      'passed': list_sum(list_transform(post, lambda x: CASE WHEN x.v[j + 1] > 0 THEN x.n * (1 - x.q) ELSE 0 END))}) AS bs
  FROM (SELECT k, list_transform(ps, lambda x: {'v': x.v, 'n': x.n, 'q': 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(8), lambda j:
      CASE WHEN x.v[j + 1] > 0 THEN ln(good[j + 1] / bad[j + 1]) WHEN x.v[j + 1] < 0 THEN ln((1 - good[j + 1]) / (1 - bad[j + 1])) ELSE 0 END)))))}) AS post FROM e, p WHERE k < 40))
), m AS (SELECT prior, good, bad FROM e WHERE k = 40),
q AS (SELECT v.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(8), lambda j:
      CASE WHEN votes[j + 1] > 0 THEN ln(good[j + 1] / bad[j + 1]) WHEN votes[j + 1] < 0 THEN ln((1 - good[j + 1]) / (1 - bad[j + 1])) ELSE 0 END))))) AS p_good,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good FROM q
"""

#: crc32 with its table made from the polynomial; `crc` is the table as a list.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END) AS v FROM range(256) r(i))"


def _crc(characters: str) -> str:
    """Unsigned crc32 of a list of characters up to U+00FF, above ASCII those from U+00C0 only."""
    data = f"flatten(list_transform({characters}, lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"


TRIE_SQL = f"""
WITH crc_table AS ({_CRC_TABLE}),
c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT conv_id, ts, {_crc("string_split(CAST(conv_id AS VARCHAR), '')")} % 4 AS h FROM c, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1 : h], h.ts[h + 1 :]) AS ts FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(ts) AS size, ts[1 : depth] AS path, depth FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM r)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256, max(size) = depth AS leaf
  FROM m GROUP BY path, depth
), s AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n
), a AS (SELECT path[1 : up] AS path, depth, up, saved, leaf FROM (SELECT *, unnest(range(depth + 1)) AS up FROM s)),
t AS (
  SELECT path, count(*) FILTER (depth = up + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM a GROUP BY path
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n_convs, n_children, n_leaves, saved_tokens, s.ends_sha256
FROM s JOIN t ON t.path = s.path LEFT JOIN n p ON s.depth > 0 AND p.path = s.path[1 : s.depth - 1]
"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS most FROM g),
f AS (
  SELECT *, sum(source_size) OVER () AS budget, sum(most) OVER l - most AS ahead, sum(weight) OVER () - (sum(weight) OVER l - weight) AS rest
  FROM w WINDOW l AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), v AS (SELECT max_by(CAST(budget - ahead AS BIGINT), (budget - ahead) / rest) AS got, max_by(CAST(rest AS BIGINT), (budget - ahead) / rest) AS rest FROM f),
s AS (SELECT source, source_size, weight, CAST(budget AS BIGINT) AS budget, least(CAST(most AS DOUBLE), CAST(weight * v.got AS DOUBLE) / v.rest) AS target FROM f, v),
p AS (
  SELECT d.doc_id, d.size, s.*, row_number() OVER q AS place, CAST(sum(d.size) OVER q - d.size AS BIGINT) AS ahead
  FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source
  WINDOW q AS (PARTITION BY d.source ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1 : 16], doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
), e AS (SELECT p.* REPLACE (turn * source_size + ahead AS ahead), turn FROM p, range(3) t(turn)),
x AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - ahead)) AS served FROM e),
k AS (
  SELECT *, unnest(CASE WHEN served > 0 AND served < size THEN [{'part': 0, 'packet': served, 'finish': (ahead + served) / weight}, {'part': 1, 'packet': size - served, 'finish': (ahead + size) / weight}]
    ELSE [{'part': 0, 'packet': size, 'finish': (ahead + size) / weight}] END) AS c FROM x
), o AS (
  SELECT *, greatest(0, least(c.packet, budget - (sum(c.packet) OVER (ORDER BY c.finish, source NULLS LAST, place, turn, c.part ROWS UNBOUNDED PRECEDING) - c.packet))) AS words FROM k
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, round(any_value(target), 6) AS target, CAST(sum(words) AS BIGINT) AS taken
FROM o GROUP BY source, place
"""

SPELLING_SQL = f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run),
h AS (SELECT run, n, {_crc("string_split(id || ':' || run, '')")} AS h FROM g, crc_table),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), x AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS bare FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM x a JOIN x b ON a.bare = b.bare AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.bare
  UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.bare
), b AS (SELECT p.word, count(*) AS n_near, first({{'n': w.n, 'word': w.word}} ORDER BY w.n DESC, w.word) AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.word END AS form, CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word
), c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN e ON e.word = f.word
"""
