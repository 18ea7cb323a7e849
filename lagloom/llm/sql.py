"""DuckDB SQL for the corpus queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH l AS (
  SELECT doc_id, t.line, t.i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
    LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS i) t),
k AS (SELECT doc_id, line, i, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM l),
o AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.doc_id, line, i, coalesce(o.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \t\n\x0B\f\r]+'),
                             lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.dst FROM r JOIN p ON r.c = p.src),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: CRC-32 by its rule: the table of 256 entries, then a fold over the bytes.
_CRC = """
t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                  ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i))
"""

OP5 = f"""
WITH {_CRC},
b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, coalesce('s' || source, 'n') AS part, n + 1 AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)),
            lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]))) AS text_crc32 FROM b, t),
e AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, 'null'), text_crc32, size)), 1, 15))::BIGINT AS k FROM d),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY part ORDER BY k, doc_id, text_crc32, size) - 1) + 1)::DOUBLE
             / (2 * count(*) OVER (PARTITION BY part))::DOUBLE AS f FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY f, part, k, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, pos * 16 // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
       (pos - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

OP7 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw FROM conversations),
n AS (SELECT *, regexp_replace(raw, '<([|\\])', '<\\\1', 'g') AS text, regexp_replace(regexp_replace(role, '<([|\\])', '<\\\1', 'g'), '\|([>\\])', '|\\\1', 'g') AS name FROM r),
q AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
m AS (SELECT n.*, perspective, role = perspective AS own,
        CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
             ELSE '<|user name=' || name || '|>' END || chr(10) AS head FROM n JOIN q ON n.conv_id IS NOT DISTINCT FROM q.conv_id),
o AS (SELECT *, head || text || '<|end|>' || chr(10) AS line,
        row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, raw) AS i FROM m),
c AS (SELECT *, (sum(length(line)) OVER (PARTITION BY conv_id, perspective ORDER BY i))::BIGINT AS stop FROM o)
SELECT conv_id, perspective, 0::BIGINT AS start, count(*) AS n_turns, string_agg(line, '' ORDER BY i) AS rendered,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY i) AS loss_mask,
       coalesce(string_agg((stop - length(line) + length(head)) || '-' || stop, ',' ORDER BY i) FILTER (own), '') AS loss_spans
FROM c GROUP BY conv_id, perspective
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.dst FROM r JOIN p ON r.c = p.src),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT src, count(*) AS n FROM p GROUP BY src)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON n.src = m.vec_id
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1, "op2_minhash": OP2, "op3_topk": OP3, "op5_sharding": OP5, "op7_chat": OP7, "op9_embedding_dedup": OP9,
}
