"""DuckDB text of the queries that SQL can express over whole tables."""

from __future__ import annotations

from voxelweave.functions.draws import PRIME, uniform_sql
from voxelweave.llm.licenses import PARAGRAPH, TELLING, TEMPLATES, THRESHOLD, VOCABULARY, WORD, words_of
from voxelweave.llm.mixing import DIMENSIONS, NONE, POWERS, SHARE

_LIST = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
_TELL = "(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in TELLING) + ")(?:$|[^A-Za-z0-9])"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = ", ".join(
    f"('{name}', {order}, '{w}', {words_of(TEMPLATES[name]).count(w)})"
    for order, name in enumerate(sorted(TEMPLATES)) for w in sorted(set(words_of(TEMPLATES[name])))
)

LICENSES = f"""
WITH files AS MATERIALIZED (SELECT doc_id, concat_ws('/', source, lang, CAST(floor(doc_id / 400) AS BIGINT)) AS dir,
    doc_id % 20 = 0 AS is_file, CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.txt' ELSE doc_id || '.txt' END AS name,
    coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM files),
freq AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all({_LOWER.format('line')}, '{WORD}'),
    lambda x: list_contains({_LIST}, x)))) AS w FROM lines) GROUP BY w),
n AS (SELECT count(*) AS total FROM lines),
idf AS MATERIALIZED (SELECT v AS word, ln((1 + total) / (1 + coalesce(df, 0))) AS idf FROM (SELECT unnest({_LIST}) AS v) LEFT JOIN freq ON w = v, n),
terms AS (SELECT t.name, t.ord, t.word, t.tf * idf AS w FROM (VALUES {_TERMS}) t(name, ord, word, tf) JOIN idf USING (word)),
templates AS (SELECT name, ord, word, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS tw FROM terms),
units AS (SELECT * FROM lines UNION ALL SELECT doc_id, block, -1 - i FROM (SELECT doc_id, unnest(string_split_regex(text, '{PARAGRAPH}')) AS block,
    generate_subscripts(string_split_regex(text, '{PARAGRAPH}'), 1) AS i FROM files) WHERE contains(block, chr(10)) UNION ALL SELECT doc_id, text, 0 FROM files WHERE is_file AND contains(text, chr(10))),
tf AS MATERIALIZED (SELECT doc_id, unit, word, count(*) AS tf FROM (SELECT doc_id, unit,
    unnest(regexp_extract_all({_LOWER.format('line')}, '{WORD}')) AS word FROM units WHERE regexp_matches(line, '{_TELL}')) GROUP BY ALL),
vec AS MATERIALIZED (SELECT doc_id, unit, tf.word, tf * coalesce(idf, ln(1 + total)) AS w FROM tf LEFT JOIN idf USING (word), n),
norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM vec GROUP BY ALL),
scores AS (SELECT doc_id, ord, name, round(dot / norm, 6) AS score FROM (SELECT doc_id, unit, ord, name, sum(w * tw) AS dot
    FROM vec JOIN templates USING (word) GROUP BY ALL) JOIN norms USING (doc_id, unit) WHERE norm > 0),
best AS (SELECT doc_id, name AS lic, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM scores) WHERE r = 1),
scanned AS MATERIALIZED (SELECT f.doc_id, dir, is_file, dir || '/' || name AS path, CASE WHEN score >= {THRESHOLD} THEN split_part(lic, '#', 1) END AS own_license,
    coalesce(score, 0.0e0) AS own_score FROM files f LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS ancestor, own_license AS lic FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path, own_license) AS r
    FROM scanned WHERE is_file AND own_license IS NOT NULL) WHERE r = 1),
ups AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS ancestor FROM (SELECT DISTINCT dir FROM scanned), unnest([1, 2, 3]) u(k)),
nearest AS (SELECT dir, arg_max(ancestor, k) AS from_dir, arg_max(lic, k) AS inherited FROM ups JOIN given USING (ancestor) GROUP BY dir)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS found,
  CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM scanned LEFT JOIN nearest USING (dir)"""


def _mixture(rounds: int = 25) -> str:
    keys = ", ".join(DIMENSIONS)
    targets = "".join(
        f""", t_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {p}) / sum(pow(sum(tokens)::DOUBLE, {p})) OVER () AS t_{d}
  FROM cells WHERE tokens > 0 GROUP BY {d})""" for d, p in POWERS.items())
    steps, last = "", "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"w{i}_{d}"
            steps += f""", {name} AS MATERIALIZED (SELECT * EXCLUDE (weight), weight / sum(weight) OVER (PARTITION BY {d}) * t_{d} AS weight FROM {last})"""
            last = name
    return f"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, 'icense') OR contains(x, 'CC BY') THEN 'notice'
    WHEN contains(x, '@') OR contains(x, '+1 (') THEN 'contact' WHEN contains(x, '!!') THEN 'shout' ELSE 'prose' END AS topic,
  len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
cells AS MATERIALIZED (SELECT {keys}, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL){targets},
w0 AS MATERIALIZED (SELECT cells.*, t_source, t_lang, t_topic, tokens::DOUBLE AS weight FROM cells JOIN t_source USING (source)
  JOIN t_lang USING (lang) JOIN t_topic USING (topic) WHERE tokens > 0){steps},
ratio AS MATERIALIZED (SELECT {keys}, tokens, weight * (SELECT sum(tokens)::DOUBLE FROM cells) / tokens AS multiplier FROM {last}),
-- Cells by falling multiplier: the first so many are kept whole, the others share what is left.
ordered AS (SELECT multiplier, tokens, sum(tokens * multiplier) OVER w AS rest, sum(tokens) OVER () - sum(tokens) OVER w AS kept
  FROM ratio WINDOW w AS (ORDER BY multiplier ROWS UNBOUNDED PRECEDING)),
factors AS (SELECT multiplier, rest, ({SHARE} * (SELECT sum(tokens) FROM ratio) - kept) / rest AS f FROM ordered),
factor AS (SELECT arg_max(f, rest) AS f FROM factors WHERE f > 0 AND multiplier * f <= 1),
cell AS (SELECT {keys}, coalesce(multiplier, 1.0e0) AS multiplier,
  least(1.0e0, coalesce(multiplier, 1.0e0) * (SELECT f FROM factor)) AS probability FROM cells LEFT JOIN ratio USING ({keys}))
SELECT doc_id, topic, tokens, round(multiplier, 6) AS multiplier, round(probability, 6) AS probability,
  {uniform_sql(11, f"((coalesce(doc_id, 0) % {PRIME}) + {PRIME}) % {PRIME}")} < probability AS sampled
FROM docs JOIN cell USING ({keys})"""


EXACT = """
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r"""

TOP_K = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""

def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII or Latin text, byte by byte and bit by bit."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x})) || ':' || {x} END" for x in fields) + ")"


MERKLE = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r FROM (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("CASE WHEN lost THEN replace(text, chr(10), '') ELSE text END")} AS changed
  FROM (SELECT *, coalesce({_crc32('doc_id::VARCHAR')} % 2 = 0, false) AS lost FROM documents))),
groups AS MATERIALIZED (SELECT source, min(r) AS g, row_number() OVER (ORDER BY min(r)) - 1 AS nth FROM docs GROUP BY source),
leaves AS MATERIALIZED (SELECT docs.*, g, r - g AS pos FROM docs JOIN groups ON docs.source IS NOT DISTINCT FROM groups.source),
nodes AS (
  SELECT g, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT g, level + 1 AS level, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM nodes WHERE n > 1 GROUP BY g, level, pos // 3)),
subs AS MATERIALIZED (SELECT g, digest AS subroot, nth FROM nodes JOIN groups USING (g) WHERE n = 1),
tops AS (
  SELECT 0 AS level, nth AS pos, subroot AS digest, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level, pos, digest, count(*) OVER () AS n FROM (
    SELECT level + 1 AS level, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM tops WHERE n > 1 GROUP BY level, pos // 3)),
runs AS MATERIALIZED (SELECT g, level, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, pos // 3, list(digest ORDER BY pos) FROM tops WHERE n > 1 GROUP BY ALL),
up AS (
  SELECT r, g, 0 AS level, pos, changed AS digest, '' AS seen FROM leaves
  UNION ALL
  SELECT r, CASE WHEN kids IS NULL THEN -1 ELSE up.g END, CASE WHEN kids IS NULL THEN 0 ELSE up.level + 1 END, CASE WHEN kids IS NULL THEN nth ELSE pos // 3 END,
    CASE WHEN kids IS NULL THEN digest ELSE sha256(array_to_string(kids[:pos % 3], '') || digest || array_to_string(kids[pos % 3 + 2:], '')) END,
    CASE WHEN kids IS NULL THEN seen ELSE seen || array_to_string(kids[:pos % 3], '') || array_to_string(kids[pos % 3 + 2:], '') END
  FROM up LEFT JOIN runs ON runs.g = up.g AND runs.level = up.level AND runs.run = up.pos // 3 LEFT JOIN groups ON groups.g = up.g
  WHERE kids IS NOT NULL OR up.g >= 0),
ends AS (SELECT r, arg_max(digest, level) AS folded, sha256(arg_max(seen, level)) AS proof FROM up WHERE g = -1 GROUP BY r)
SELECT doc_id, leaf, subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN ends USING (r) JOIN subs USING (g), (SELECT digest AS root FROM tops WHERE n = 1)"""

SPELLING = f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form,
  CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL
  SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)"""

ORACLES = {"op11_merkle_manifest": MERKLE, "op12_spelling_groups": SPELLING, "op1_license_scan": LICENSES, "op2_mixture": _mixture(), "op8_exact_dedup": EXACT, "op10_top_k": TOP_K}
