"""DuckDB SQL for the operators that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS said FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k + 1, k + n), ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, k, n, item FROM dw JOIN iw USING (n, said)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(found, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k + 1, k + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS seen FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '.\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '.\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
# The three rules, the group that counts, and its least length.
_RULES = (("assign", rf"({_KEY})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16))


def _found(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Findings of a rule: a match starts behind all texts between matches, and all matches, before it."""
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, start_at, start_at + len(said) AS stop FROM (
  SELECT doc_id, said, part, list_sum(list_transform(gaps[:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: len(x))), 0)::BIGINT AS start_at
  FROM (SELECT doc_id, gaps, whole, unnest(whole) AS said, unnest(parts) AS part, generate_subscripts(whole, 1) AS i
    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d)))
  WHERE len(part) >= {least}"""


RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(k, *r) for k, r in enumerate(_RULES))})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start_at || ':' || stop, ',' ORDER BY start_at, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""

# The cyclic redundancy check of a short text, bit by bit.
_BITS = "list_reduce(list_prepend(xor(c, ord(b)::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend({{'c': 4294967295::BIGINT, 'b': ''}}, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: {{'c': 0::BIGINT, 'b': z}})), lambda p, q: {{'c': {_BITS.replace('xor(c, ord(b)::BIGINT)', "xor(p.c, ord(q.b)::BIGINT)")}, 'b': ''}}).c, 4294967295)"

WORDS = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_TOKENS}, chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1.0 * (v + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""

EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, CAST(n - n // 2 AS INTEGER)) || substring(next, 1, CAST(n // 2 AS INTEGER))) AS edited_sha256 FROM n
"""

SQL = {"secret_rules": RULES, "word_scores": WORDS, "edited_texts": EDITED, "op3_decontaminate": OP3, "op5_near_dedup": OP5, "op9_chat_format": OP9}
