"""SQL of the operators' queries that SQL can express, written from the definitions and not from the methods."""

from __future__ import annotations

from tidemark.llm import secret_ledger as secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"


def _kind(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Matches of a pattern with their offsets, by the pieces of text between them."""
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, list_sum(list_transform(p[1:i], lambda v: len(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: len(v))), 0) AS s, m[i] AS x, g[i] AS g
 FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_extract_all(coalesce(text, ''), '{pattern}', {2 if rank == 0 else 0}) AS g,
  string_split_regex(coalesce(text, ''), '{pattern}') AS p FROM documents WHERE doc_id IS NOT NULL)) WHERE {keep}"""


_ASSIGN = "(?i:" + secrets.ASSIGN.split(")")[0] + "))" + secrets.ASSIGN.split(")", 1)[1]
_FOUND = " UNION ALL ".join(
    _kind(*x)
    for x in (
        (0, "assign", _ASSIGN.replace("'", "''"), "len(g[i]) >= 6"),
        (1, "access", secrets.ACCESS, "len(m[i]) >= 20"),
        (2, "hex", secrets.HEX, "len(m[i]) >= 24"),
        (3, "pem", secrets.PEM, "true"),
    )
)
_SPAN = "kind || ':' || s::BIGINT || ':' || (s + len(x))::BIGINT"
OP1 = f"""WITH f AS ({_FOUND}), a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 string_agg({_SPAN}, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({_SPAN}, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id) WHERE d.doc_id IS NOT NULL"""

OP3 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT *, len(h) // 2 AS n_bytes FROM h),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM n WHERE n_bytes >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
o AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r), p AS (SELECT *, sum(CASE WHEN b IS NULL OR i > b + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM o),
s AS (SELECT doc_id, part, min(i) AS a, max(i) + 100 AS z FROM p GROUP BY ALL), t AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM s),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last FROM s GROUP BY ALL),
k AS (SELECT t.doc_id, string_agg(substr(n.h, 2 * t.y + 1, 2 * (t.a - t.y)), '' ORDER BY t.a) AS head FROM t JOIN n USING (doc_id) GROUP BY ALL)
SELECT n.doc_id, n.n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.head, '') || substr(n.h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark), i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
m AS (SELECT x.doc_id, x.n, x.s, q.item_id FROM x JOIN q USING (n, g)), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY ALL)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT *, least(5, len(w)) AS n FROM d),
g AS (SELECT DISTINCT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM n WHERE n > 0)), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.n = b.n AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN z x ON x.doc_id = o.a JOIN z y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, (SELECT min(node) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN z USING (doc_id)"""

_NORM = r"trim(regexp_replace(regexp_replace(lower(raw), '[ \t\x0B\f\r]+', ' ', 'g'), '[0-9]', '0', 'g'))"
OP10 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, source, p, ls[p] AS raw FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM d))), u AS (SELECT doc_id, source, p, raw, {_NORM} AS norm FROM l),
f AS (SELECT source, norm, min(doc_id) AS first_doc FROM u WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 50),
v AS (SELECT u.doc_id, u.p, u.raw, f.norm IS NOT NULL AND u.doc_id <> f.first_doc AS gone FROM u LEFT JOIN f ON u.source IS NOT DISTINCT FROM f.source AND u.norm = f.norm),
x AS (SELECT doc_id, coalesce(sum(len(regexp_extract_all(raw, '{_SPACE}'))) FILTER (gone), 0)::BIGINT AS removed_words, sha256(coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS cleaned_sha256 FROM v GROUP BY ALL),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM e) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS q FROM t) GROUP BY ALL),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: len(v))), 0)::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '{_SPACE}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '{_SPACE}')))))::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, removed_words, cleaned_sha256 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)), y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM y"""

_DRAW = "('0x' || substr(h, {0}, 8))::BIGINT"
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT *, len(u)::BIGINT AS n, {_DRAW.format(1)} % (len(u) + 1) AS a, {_DRAW.format(9)} % (len(u) + 1) AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, {_DRAW.format(25)} % 100 < 50 AS spm FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM x)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN len(p) END AS prefix_chars, CASE WHEN NOT plain THEN len(m) END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _leaf(text: str) -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR END"
    return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# DuckDB has no CRC-32, so a table of 256 entries is made of its polynomial and each digit goes through it.
_CRC_TABLE = "list_reduce(range(8), lambda a, q: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)"
OP13 = f"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, {_CRC_TABLE} AS v FROM (SELECT unnest(range(256)) AS b))),
crc(doc_id, i, c) AS (SELECT DISTINCT doc_id, 1, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, i + 1, xor(c >> 8, tab[(xor(c, ascii(substr(doc_id::VARCHAR, i, 1))) & 255) + 1]) FROM crc, tab WHERE i <= len(doc_id::VARCHAR)),
five AS (SELECT doc_id FROM crc WHERE i = len(doc_id::VARCHAR) + 1 AND xor(c, 4294967295) % 5 = 0),
d AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, doc_id, {_leaf('text')} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM five) THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS second FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up(tree, level, i, digest, n) AS (SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM e
 UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY tree, level, i // 16),
sub AS (SELECT tree, digest AS subroot, max(level) OVER (PARTITION BY tree) AS top, level FROM up QUALIFY level = max(level) OVER (PARTITION BY tree)), places AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS i FROM sub),
over_(level, i, digest, n) AS (SELECT 0, i, subroot, count(*) OVER () FROM places UNION ALL SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM over_ WHERE n > 1 GROUP BY level, i // 16),
steps AS (SELECT u.tree, u.level, u.i AS at, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < u.i), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > u.i), '') AS after
 FROM up u JOIN up s ON s.tree = u.tree AND s.level = u.level AND s.i // 16 = u.i // 16 WHERE u.n > 1 GROUP BY ALL),
high AS (SELECT u.level, u.i AS at, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < u.i), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > u.i), '') AS after
 FROM over_ u JOIN over_ s ON s.level = u.level AND s.i // 16 = u.i // 16 WHERE u.n > 1 GROUP BY ALL),
path AS (SELECT e.tree, e.i, s.level AS level, s.before, s.after FROM e JOIN steps s ON s.tree = e.tree AND s.at = e.i // pow(16, s.level)::BIGINT
 UNION ALL SELECT e.tree, e.i, p.top + h.level, h.before, h.after FROM e JOIN places p USING (tree) JOIN high h ON h.at = p.i // pow(16, h.level)::BIGINT),
whole AS (SELECT tree, i, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a, string_agg(before || after, '' ORDER BY level) AS siblings FROM path GROUP BY ALL),
fold(tree, i, k, acc) AS (SELECT tree, i, 1, coalesce(second, leaf) FROM e UNION ALL SELECT f.tree, f.i, k + 1, sha256(w.b[k] || acc || w.a[k]) FROM fold f JOIN whole w USING (tree, i) WHERE k <= len(w.b)),
done AS (SELECT tree, i, max_by(acc, k) AS folded_root FROM fold GROUP BY ALL), root AS (SELECT max_by(digest, level) AS root FROM over_)
SELECT e.doc_id, e.leaf, sub.subroot, root.root, sha256(coalesce(w.siblings, '')) AS proof_sha256, done.folded_root, done.folded_root = root.root AS verified
FROM e JOIN sub USING (tree) JOIN done USING (tree, i) CROSS JOIN root LEFT JOIN whole w USING (tree, i)"""

BY_OPERATOR = {1: OP1, 3: OP3, 4: OP4, 8: OP8, 10: OP10, 11: OP11, 13: OP13}
