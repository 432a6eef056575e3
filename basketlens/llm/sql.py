"""SQL for the operators' queries, in DuckDB's dialect, from the definitions of their results."""

from __future__ import annotations

from .licenses import BASE, COVER, GRAM, NOTICES, SLACK, TEXTS, template_grams
from .secrets import SCOPE

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNIFORM = "('0x' || substr(md5({}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496"

MIXING = f"""
WITH RECURSIVE mass AS (SELECT source, sum(length(text))::DOUBLE AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 0),
rates AS (
    SELECT source, (SELECT sum(chars) FROM mass) * (sqrt(chars) / (SELECT sum(sqrt(chars)) FROM mass)) / chars AS rate FROM mass),
parts AS (SELECT source, greatest(1, ceil(rate / 16))::INT AS chunks, rate / greatest(1, ceil(rate / 16)) AS mean FROM rates),
cdf AS (
    SELECT source, 0 AS k, mean, exp(-mean) AS p, exp(-mean) AS total FROM parts
    UNION ALL
    SELECT source, k + 1, mean, p * mean / (k + 1), total + p * mean / (k + 1) FROM cdf WHERE k < 96),
draws AS (
    SELECT doc_id, d.source, {_UNIFORM.format("'mix-1|' || doc_id || '|' || c")} AS u
    FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.chunks + 1)) AS t(c)),
counts AS (
    SELECT d.doc_id, d.source, count(*) AS copies
    FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.total <= d.u GROUP BY ALL)
SELECT doc_id, source, copy::INT AS copy, {_UNIFORM.format("'mix-1|order|' || doc_id || '|' || copy")} AS "order"
FROM counts, unnest(range(1, copies + 1)) AS t(copy)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"coalesce({LOWER}, '')")} AS words FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
        ELSE list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) END AS shingles
    FROM w),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""

TOP_K = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vector::DOUBLE[], c.vector::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vector) = len(c.vector)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _covered(length: int) -> str:
    return f"max(CASE WHEN often > 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) IS NOT NULL"


PASSAGES = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
units AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, words FROM w),
windows AS (
    SELECT doc_id, pos, word, CASE WHEN pos + 34 <= len(words) THEN md5(array_to_string(words[pos : pos + 34], ' ')) END AS h FROM units),
counted AS (SELECT doc_id, pos, word, CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY h) END AS often FROM windows),
flags AS (SELECT doc_id, pos, word, {_covered(35)} AS gone FROM counted),
kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM flags GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

SUBSTRINGS = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
units AS (SELECT doc_id, unnest(range(1, length(bytes) // 2 + 1)) AS pos, bytes FROM h),
windows AS (
    SELECT doc_id, pos, CASE WHEN 2 * pos + 798 <= length(bytes) THEN md5_number(substr(bytes, 2 * pos - 1, 800)) END AS h FROM units),
counted AS (SELECT doc_id, pos, CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY h) END AS often FROM windows),
flags AS (SELECT doc_id, pos, {_covered(400)} AS gone FROM counted),
edges AS (SELECT doc_id, pos, gone, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM flags),
kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
        coalesce(string_agg(substr(bytes, 2 * pos - 1, 2), '' ORDER BY pos) FILTER (NOT gone), '') AS kept
    FROM edges JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
    (length(bytes) // 2 - coalesce(n_removed, 0))::BIGINT AS n_kept, coalesce(n_removed, 0) > 0 AS touched
FROM h LEFT JOIN kept USING (doc_id)
"""


def _template_rows() -> str:
    return ", ".join(f"({number}, '{label}', {is_base}, {n}, {place}, '{gram}')" for number, label, is_base, n, place, gram in template_grams(BASE, NOTICES + TEXTS))


LICENSES = rf"""
WITH t(template, label, is_base, n_grams, place, gram) AS (VALUES {_template_rows()}),
w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
grams AS (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - {GRAM - 2}), lambda k: {{'pos': k - 1, 'gram': array_to_string(words[k : k + {GRAM - 1}], ' ')}}), recursive := true) FROM w),
votes AS (
    SELECT doc_id, template, label, is_base, n_grams, pos - place AS diagonal, count(DISTINCT place) AS n, min(pos) AS low, max(pos) AS high,
        list(DISTINCT place) AS places FROM grams JOIN t USING (gram) GROUP BY ALL),
base AS (SELECT doc_id, label, true AS is_base, diagonal AS first, 1.0::DOUBLE AS share FROM votes WHERE is_base AND n = n_grams),
cut AS (
    SELECT *, (coalesce(diagonal - lag(diagonal) OVER d > {SLACK}, true))::INT AS apart FROM votes WHERE NOT is_base
    WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM cut),
merged AS (
    SELECT doc_id, label, n_grams, len(list_distinct(flatten(list(places)))) AS n, min(low) AS first, max(high) + {GRAM - 1} AS last
    FROM numbered GROUP BY doc_id, template, label, n_grams, span),
found AS (
    SELECT doc_id, label, is_base, first, share FROM base
    UNION ALL
    SELECT doc_id, label, false, first, n::DOUBLE / n_grams FROM merged
    WHERE n::DOUBLE / n_grams >= {COVER} AND last - first + 1 <= n_grams + {GRAM - 1} + {SLACK} * (n_grams // 64 + 1))
SELECT doc_id, any_value(len(words))::BIGINT AS n_words, count(*) FILTER (f.is_base)::BIGINT AS n_base,
    min(first) FILTER (f.is_base)::BIGINT AS first_word, max(first) FILTER (f.is_base)::BIGINT AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (f.is_base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM w LEFT JOIN found f USING (doc_id) GROUP BY doc_id
"""


# The patterns, for an engine without look-around; (kind, pattern).
_PATTERNS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
    ("name", r"""(?i:\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,})"""),
    ("weak", r"""(?i:\b(?:pwd|pass|passphrase|auth|bearer|credentials?|private_?key|secret_?key)["']?(?:\x20*[:=]\x20*["']?|\x20+)[A-Za-z0-9+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*)"""),
    ("address", r"""(?i:\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+)"""),
]


def _matches(number: int, kind: str, pattern: str) -> str:
    """Every match with its start: matches are marked, and the text is split at the marks."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {number} AS kind, '{kind}' AS name, start, start + length(match) AS "end", match FROM (
        SELECT doc_id, split_part(part, chr(57345), 1) AS match, place,
            coalesce(sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM (
            SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({quoted})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS parts FROM documents)))
    WHERE place > 1""".replace("\\\\1", "\\1")


def _near(kinds: str) -> str:
    return f"""EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = c.doc_id AND p.name IN ({kinds}) AND p.start < c."end" + {SCOPE} AND p."end" > c.start - {SCOPE})"""


_SECRET, _NAME = "'assign', 'hex', 'weak'", "'name', 'access'"
SECRETS = rf"""
WITH marked AS ({" UNION ALL ".join(_matches(k, *p) for k, p in enumerate(_PATTERNS))}),
spans AS (
    SELECT * FROM marked WHERE CASE name
        WHEN 'assign' THEN length(regexp_extract(match, '[A-Za-z0-9+/_.=-]+$')) >= 12 AND length(regexp_extract(match, '(?i:^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 1)) >= 12
        WHEN 'access' THEN length(match) >= 18 WHEN 'hex' THEN length(match) >= 16 ELSE true END),
kept AS (
    SELECT * FROM spans c WHERE CASE name WHEN 'name' THEN {_near(_SECRET)} WHEN 'weak' THEN {_near(_NAME + ", 'address'")}
        WHEN 'address' THEN {_near(_SECRET)} AND {_near(_NAME)} ELSE true END)
SELECT d.doc_id, count(*) FILTER (kind = 0)::BIGINT AS n_assign, count(*) FILTER (kind = 1)::BIGINT AS n_access, count(*) FILTER (kind = 2)::BIGINT AS n_hex,
    sha256(coalesce(string_agg(name || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
    coalesce(string_agg(name || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind), '') AS spans
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


# The 256 entries of the crc32 table, from its rule.
_CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS crc"


def _crc32(value: str) -> str:
    """Unsigned crc32 of a string; the table ``crc`` must be in scope."""
    octets = f"list_transform(range(0, octet_length(encode({value}))), lambda k: ('0x' || substr(hex(encode({value})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _above(nodes: str) -> str:
    """The parents of a list of nodes."""
    return f"list_transform(range(0, (len({nodes}) + 15) // 16), lambda k: sha256(array_to_string({nodes}[16 * k + 1 : 16 * k + 16], '')))"


MANIFEST = f"""
WITH RECURSIVE table_of AS ({_CRC_TABLE}),
leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(LOWER)} END AS changed
    FROM documents, table_of),
spots AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves),
trees AS (
    SELECT source, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM spots GROUP BY source
    UNION ALL SELECT source, level + 1, {_above("nodes")} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM trees WHERE len(nodes) = 1),
upper AS (
    SELECT 0 AS level, list(subroot ORDER BY spot) AS nodes FROM subroots
    UNION ALL SELECT level + 1, {_above("nodes")} FROM upper WHERE len(nodes) > 1),
steps AS (
    SELECT source, level, nodes, false AS above FROM trees WHERE len(nodes) > 1
    UNION ALL SELECT source, height + level, nodes, true FROM subroots, upper WHERE len(nodes) > 1),
places AS (
    SELECT s.doc_id, s.spot, s.source, s.leaf, level, nodes,
        CASE WHEN above THEN r.spot >> (4 * (level - height)) ELSE s.spot >> (4 * level) END AS place
    FROM spots s JOIN subroots r ON s.source IS NOT DISTINCT FROM r.source JOIN steps t ON s.source IS NOT DISTINCT FROM t.source),
sides AS (
    SELECT source, spot, level, array_to_string(nodes[place // 16 * 16 + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place // 16 * 16 + 16], '') AS after
    FROM places),
proofs AS (SELECT source, spot, string_agg(before || after, '' ORDER BY level) AS proof FROM sides GROUP BY ALL),
folds AS (
    SELECT source, spot, 0 AS level, coalesce(changed, leaf) AS digest FROM spots
    UNION ALL
    SELECT f.source, f.spot, f.level + 1, sha256(before || digest || after) FROM folds f JOIN sides s ON f.source IS NOT DISTINCT FROM s.source AND f.spot = s.spot AND f.level = s.level),
folded AS (SELECT source, spot, max_by(digest, level) AS folded_root FROM folds GROUP BY ALL),
summit AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1)
SELECT s.doc_id, s.leaf, r.subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM summit, spots s JOIN subroots r ON s.source IS NOT DISTINCT FROM r.source
JOIN folded f ON s.source IS NOT DISTINCT FROM f.source AND s.spot = f.spot
LEFT JOIN proofs p ON s.source IS NOT DISTINCT FROM p.source AND s.spot = p.spot
"""

_COMPARED = rf"regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, {_COMPARED} AS words FROM documents),
items AS (SELECT item_id, {_COMPARED} AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: array_to_string(words[k : k + size - 1], ' '))) AS phrase FROM sized),
sizes AS (SELECT DISTINCT size FROM windows),
seen AS (
    SELECT nr, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: {{'pos': k, 'phrase': array_to_string(words[k : k + size - 1], ' ')}}), recursive := true)
    FROM d JOIN sizes ON len(words) >= size),
hits AS (SELECT nr, pos, size, item_id FROM seen JOIN windows USING (size, phrase)),
covered AS (SELECT nr, count(DISTINCT place) AS n FROM (SELECT nr, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT nr, pos, size FROM hits)) GROUP BY nr),
named AS (SELECT nr, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT nr, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY nr)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (nr) LEFT JOIN named m USING (nr)
"""

VARIANTS = f"""
WITH RECURSIVE table_of AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS text FROM documents),
lowered AS (SELECT doc_id, {LOWER} AS run, count(*) AS n FROM runs WHERE length(text) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM lowered, table_of),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
gaps AS (SELECT DISTINCT word, n, left(word, k - 1) AS head, substr(word, k + 1) AS tail, left(word, k - 1) || substr(word, k + 1) AS short FROM cut),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN v b ON a.short = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN v b ON a.short = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
forms AS (
    SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
    FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(root, step) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM forms f
"""
