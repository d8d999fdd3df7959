"""SQL for the operators it can express, over the driver's tables.

The others use what SQL lacks (XXH64, byte-pair merges, tilings, cuts, best fit), and are tested
against brute force.
"""

from __future__ import annotations

from skyledger.llm.quality import BASE_WINDOW, COVERAGE, LINE_COVERAGE, MAX_REPEAT_PCT, MIN_WORDS
from skyledger.llm.substring import SIZE

WORD = r"[^\x20\x09-\x0D]"

WORDS = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(text, '{WORD}+') AS list FROM docs),
words AS (SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM lists)"""


def _quality() -> str:
    lengths = sorted({*COVERAGE, BASE_WINDOW})
    longest = max(lengths)
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, longest))
    parts = [
        f"ahead AS (SELECT doc_id, i, word, {leads} FROM words"
        " WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
    ]
    for n in lengths:
        gram = ", ".join(["word", *[f"w{k}" for k in range(1, n)]])
        parts.append(f"""
twice{n} AS (SELECT doc_id, i, word, w{n - 1} IS NOT NULL
  AND count(*) OVER (PARTITION BY doc_id, {gram}) > 1 AS twice FROM ahead)""")
        parts.append(f"""
inside{n} AS (SELECT doc_id, i, word, max(twice) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM twice{n})""")
        parts.append(f"""
share{n} AS (SELECT doc_id, count(*) FILTER (inside) AS words,
  coalesce(sum(length(word)) FILTER (inside), 0)::DOUBLE / sum(length(word)) AS share
  FROM inside{n} GROUP BY doc_id)""")
    joins = "".join(f" LEFT JOIN share{n} USING (doc_id)" for n in lengths)
    rules = " AND ".join(f"coalesce(share{n}.share, 0) <= {most}" for n, most in COVERAGE.items())
    repeat = f"coalesce(share{BASE_WINDOW}.words, 0)"
    return f"""
WITH {WORDS}, {','.join(parts)},
sums AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words
  GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line
  FROM docs) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
repeats AS (SELECT doc_id, (sum(n) - count(*))::BIGINT AS n_dup_lines,
  coalesce(sum(length(line) * n) FILTER (n > 1), 0)::DOUBLE / sum(length(line) * n)::DOUBLE AS line_coverage
  FROM lines GROUP BY doc_id),
figures AS (SELECT docs.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, {repeat} AS n_repeat_words,
  coalesce(n_words, 0) < {MIN_WORDS} OR 100 * {repeat} > {MAX_REPEAT_PCT} * n_words AS base_failed,
  coalesce(line_coverage, 0) AS line_coverage, {rules} AS rules
  FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN repeats USING (doc_id){joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules AND line_coverage <= {LINE_COVERAGE} AS kept, line_coverage FROM figures"""


def _substring() -> str:
    return f"""
WITH {WORDS},
windows AS (SELECT doc_id, i, word, count(*) OVER w = {SIZE} AS whole,
  string_agg(word, ' ') OVER w AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN CURRENT ROW AND {SIZE - 1} FOLLOWING)),
later AS (SELECT doc_id, i, word, whole AND min(doc_id) OVER (PARTITION BY whole, gram) < doc_id AS later
  FROM windows),
judged AS (SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS gone FROM later),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


def _crc32(text: str) -> str:
    """Bit by bit: a byte comes in at each eighth step."""
    code = f"hex(encode({text}))"
    byte = f"('0x' || substr({code}, j // 8 * 2 + 1, 2))::UBIGINT"
    steps = (
        f"list_transform(range(8 * strlen({text})),"
        f" lambda j: CASE WHEN j % 8 = 0 THEN {byte} ELSE 0::UBIGINT END)"
    )
    step = "xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))"
    start = "4294967295::UBIGINT"
    return f"xor(list_reduce(list_prepend({start}, {steps}), lambda c, x: {step}), {start})"


def _trie() -> str:
    return f"""
WITH said AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations
  WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(turn ORDER BY i) AS own, {_crc32("conv_id::VARCHAR")} % 4 AS h
  FROM said GROUP BY conv_id),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS turns
  FROM lists a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends
  FROM steps GROUP BY ALL),
below AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
  (n_convs - 1) * len(regexp_extract_all(path[depth].t, '{WORD}+')) END AS saved
  FROM nodes LEFT JOIN below USING (path)),
up AS (SELECT path[1:k] AS path, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM up GROUP BY path)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens,
  sha256(coalesce(a.ends, '')) AS ends_sha256
  FROM full_nodes a JOIN sums USING (path)
  LEFT JOIN nodes b ON a.depth > 0 AND b.path = a.path[1:a.depth - 1]"""


def _spelling() -> str:
    letters = "[A-Za-z\\x{C0}-\\x{FF}]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{letters}')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || translate(run, '{upper}', '{upper.lower()}') AS name,
  translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("name")} AS h FROM counted),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
  || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT rest, word FROM gaps WHERE rest IN (SELECT word FROM words)
  UNION ALL SELECT word, rest FROM gaps WHERE rest IN (SELECT word FROM words))),
best AS (SELECT near.word, count(*) AS n_near, min({{'n': -words.n, 'w': other}}) AS top
  FROM near JOIN words ON words.word = other GROUP BY near.word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.w END AS form,
  CASE WHEN -top.n >= 2 * n THEN -top.n END::BIGINT AS form_n FROM words LEFT JOIN best USING (word)),
ends AS (SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT ends.word, forms.word, forms.form FROM ends JOIN forms ON forms.word = ends.onward)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, root FROM ends WHERE onward IS NULL) USING (word)"""


def _warc() -> str:
    five = "('0x' || substr(code, i // 4 * 5 + 1, 5))::INT"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five} >> (15 - i % 4 * 5)) & 31) + 1, 1)"
    return f"""
WITH told AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS code FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY code, payload_bytes) AS first FROM told)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: {letter}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM grouped"""


ORACLE: dict[str, str] = {
    "op2_substring_dedup": _substring(),
    "op9_quality_rules": _quality(),
    "op11_prefix_trie": _trie(),
    "op12_spelling_variants": _spelling(),
    "op13_warc": _warc(),
}
