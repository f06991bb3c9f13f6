"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(15 + 2 * length(role) - length(translate(role, '\#<:', '')) + 2 * length(text) - length(translate(text, '\#<:', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP3 = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 5"""

OP6 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, far) AS (SELECT a, b FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.far = u.a),
c AS (SELECT doc_id, least(doc_id, min(far)) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_COMMON = ("the", "of", "and", "to", "der", "die", "und", "den", "le", "la", "les", "et", "el", "los", "que", "en")
_CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[ \t-\r]+", r"[#*$%&|<>=_~^@{}\[\]/\\+]+")

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS p, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM d),
rep AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
b AS (
  SELECT d.rid, doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, length(text) AS chars,
         [{", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in _CLASSES)}] AS cls,
         [{", ".join(f"len([1 FOR x IN w IF x = '{c}'])" for c in _COMMON)}] AS com
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
h AS (
  SELECT rid, lang, 'c' AS kind, unnest(range(0, {len(_CLASSES) + 1})) AS bin, unnest(list_append(cls, chars - list_sum(cls))) AS n FROM b
  UNION ALL SELECT rid, lang, 'w', unnest(range(0, {len(_COMMON) + 1})), unnest(list_append(com, n_words - list_sum(com))) FROM b),
ref AS (SELECT lang, kind, bin, sum(n) AS n FROM h GROUP BY ALL),
rt AS (SELECT lang, kind, sum(n) AS n FROM ref GROUP BY ALL),
ht AS (SELECT rid, kind, sum(n) AS n FROM h GROUP BY ALL),
pq AS (
  SELECT h.rid, h.kind, CAST(h.n AS DOUBLE) / nullif(ht.n, 0) AS p, CAST(ref.n AS DOUBLE) / nullif(rt.n, 0) AS q
  FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang AND h.kind = ref.kind AND h.bin = ref.bin
  JOIN rt ON h.lang IS NOT DISTINCT FROM rt.lang AND h.kind = rt.kind JOIN ht ON h.rid = ht.rid AND h.kind = ht.kind),
js AS (
  SELECT rid, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS d
  FROM pq WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT (f.base_failed OR (f.chars >= 300 AND coalesce(c.d, 0) > 0.25) OR (f.n_words >= 200 AND coalesce(w.d, 0) > 0.22)) AS kept
FROM f LEFT JOIN js c ON c.rid = f.rid AND c.kind = 'c' LEFT JOIN js w ON w.rid = f.rid AND w.kind = 'w'"""

OP10 = f"""
WITH votes AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT row_number() OVER () AS rid, documents.doc_id, source, CAST(coalesce(len({_WORDS.format(text="text")}), 0) AS BIGINT) AS size,
         pow((CAST('0x' || substr(md5('mix:' || coalesce(CAST(documents.doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5) / pow(16.0, 12),
             1.0 / CASE WHEN quality >= 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END) AS k
  FROM documents LEFT JOIN votes ON documents.doc_id = votes.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 2 * n AS cap, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, n, coalesce(least(w * (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w LIMIT 1), cap), cap) AS target FROM l),
b AS (SELECT *, coalesce(floor(target / nullif(n, 0)), 0) AS epochs FROM t),
o AS (
  SELECT d.*, b.n, b.target, b.epochs, b.target - b.epochs * b.n AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY k DESC, doc_id, size, rid) AS through
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST((epochs + CASE WHEN through - size / 2.0 <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o"""

_FIELD = "coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ord(x) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]
    FOR x IN string_split(CAST({c} AS VARCHAR), '')])), lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
_HEAD = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS tree, sha256({_HEAD} || {_FIELD.format(c="text")}) AS leaf,
         sha256({_HEAD} || {_FIELD.format(c="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed
  FROM documents),
k AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
         CASE WHEN coalesce({_CRC32.format(c="doc_id")} % 3 = 0, false) THEN changed ELSE leaf END AS own FROM d),
t(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM k
  UNION ALL SELECT tree, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 8),
tops AS (SELECT tree, h, level AS top, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM t WHERE n = 1),
u(level, pos, n, h) AS (
  SELECT 0, place, trees, h FROM tops
  UNION ALL SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8),
root AS (SELECT h FROM u WHERE n = 1),
runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT tree, top + l.level, 0, l.hs FROM tops JOIN (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY ALL) l
    ON l.run = place // CAST(pow(8, l.level + 1) AS BIGINT)),
c(rid, tree, level, pos, folded, proof) AS (
  SELECT rid, tree, 0, pos, own, '' FROM k
  UNION ALL
  SELECT rid, c.tree, c.level + 1, pos // 8,
         sha256(array_to_string(hs[1:i], '') || folded || array_to_string(hs[i + 2:], '')), proof || array_to_string(hs[1:i], '') || array_to_string(hs[i + 2:], '')
  FROM (SELECT c.*, hs, CASE WHEN c.level >= top THEN (place // CAST(pow(8, c.level - top) AS BIGINT)) % 8 ELSE c.pos % 8 END AS i
        FROM c JOIN tops USING (tree) JOIN runs ON runs.tree = c.tree AND runs.level = c.level AND runs.run = c.pos // 8) c),
e AS (SELECT rid, folded, proof FROM c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM k JOIN e USING (rid) JOIN tops USING (tree) CROSS JOIN root"""

ORACLE_SQL = {"op2_chat_formatting": OP2, "op3_top_k_search": OP3, "op6_minhash_dedup": OP6, "op7_quality_rules": OP7, "op10_mixing": OP10, "op13_merkle_manifest": OP13}
