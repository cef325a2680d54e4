"""DuckDB SQL for the operators' queries.

op1 (a fitted model), op4 (XXH64), op6 (zstandard), op11 and op12 (tokenizers) have
none: SQL can't express them, and tests hold them against brute force.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .secrets import BASE_RULES, MORE_RULES

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || h), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / CASE WHEN quality >= 1 THEN 2.0::DOUBLE WHEN quality < 1 THEN 0.5 ELSE 1 END AS key FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT level FROM l WHERE NOT level * weight > cap ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::INTEGER ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, source_size, target, epochs, greatest(target - epochs * source_size, 0) AS rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS taken FROM p
"""

NEAREST = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_reduce(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), lambda x, y: x + y, 0.0::DOUBLE) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.v) = len(b.v))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

CHAT = """
WITH t0 AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, floor(turn / 64)::BIGINT AS block, (row_number() OVER (PARTITION BY conv_id, floor(turn / 64) ORDER BY turn, role, text) - 1) // 64 AS piece FROM t0),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, perspective, block, piece, turn, role, text, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || translate(replace(replace(role, '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') || '|>' END || chr(10) AS head, text || '<|end|>' AS body FROM t JOIN s USING (conv_id)),
o AS (SELECT *, (coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head))::BIGINT AS start FROM r),
p AS (SELECT conv_id, perspective, block, piece, count(*)::INTEGER AS n_turns, min(start - length(head))::BIGINT AS start, string_agg(head || body, chr(10) ORDER BY turn, role, o.text) AS text, coalesce(string_agg(start::VARCHAR || ':' || (start + length(body))::VARCHAR, ',' ORDER BY start) FILTER (role = perspective), '') AS masks FROM o GROUP BY conv_id, perspective, block, piece)
SELECT conv_id, perspective, (row_number() OVER (PARTITION BY conv_id, perspective ORDER BY block, piece) - 1)::INTEGER AS part, n_turns, start, text, masks FROM p
"""


def secrets_sql() -> str:
    """Matches of each rule, placed by the lengths of what lies before them."""
    parts = []
    for i, r in enumerate(BASE_RULES + MORE_RULES):
        rule = "'" + r.pattern.replace("'", "''") + "'"
        kept = f"regexp_extract_all(text, {rule}, {r.group})" if r.least else "NULL"
        parts.append(f"SELECT rid, {i} AS kind_order, '{r.kind}' AS kind, unnest(m) AS m, unnest(regexp_split_to_array(text, {rule})[1:len(m)]) AS piece, unnest(range(len(m))) AS i, {f'unnest(list_transform({kept}, lambda g: length(g) >= {r.least}))' if r.least else 'true'} AS ok FROM (SELECT rid, text, regexp_extract_all(text, {rule}) AS m FROM d) WHERE len(m) > 0")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, (sum(length(piece) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i))::BIGINT AS stop FROM m),
s AS (SELECT rid, kind, kind_order, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM p WHERE ok),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, kind_order) FILTER (kind_order < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY start, kind_order) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM bl)),
dw AS (SELECT rid, n, i, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT rid, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
h AS (SELECT rid, item_id, n, i FROM dw JOIN bw USING (n, gram)),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS place FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html),
x AS (SELECT page_id, strlen(p.html) AS n, keeper, array_to_string(list_transform(range(0, 40), lambda i: lpad(to_base(('0x' || sha1(p.html)[(i + 1):(i + 1)])::INTEGER, 2), 4, '0')), '') AS bits FROM p JOIN k USING (html))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda t: CASE WHEN substr(bits, 5 * j + t + 1, 1) = '1' THEN (16 >> t::INTEGER)::INTEGER ELSE 0 END))::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN keeper END AS refers_to FROM x
"""

# crc32 byte by byte, with its table worked out from the polynomial.
SHARD = """
WITH tb AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c0 AS MATERIALIZED (SELECT doc_id, source, strlen(text) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, tb),
c AS (SELECT *, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32::VARCHAR), 1, 15))::BIGINT AS h FROM c0),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM c),
r AS (SELECT *, (k * coalesce(list_filter(list_transform([2147483647, 2147483629, 2147483587, 2147483579], lambda s: s % n), lambda s: s * 5 >= n AND s * 5 <= 4 * n)[1], list_filter(list_transform([2147483647, 2147483629, 2147483587, 2147483579], lambda s: s % n), lambda s: s <> 0)[1], 1)) % n AS rk FROM q),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rk + 1) / (2 * n), source NULLS LAST) - 1 AS place, count(*) OVER () AS total FROM r),
e AS (SELECT *, total // 24 + 1 AS big, total % 24 AS longer FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, (CASE WHEN place < big * longer THEN place // big ELSE longer + (place - big * longer) // (total // 24) END)::INTEGER AS shard, CASE WHEN place < big * longer THEN place % big ELSE (place - big * longer) % (total // 24) END AS slot, NULL::INTEGER AS grown_shard FROM e
"""

INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS p, coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m, coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX,
    "op3_nearest_neighbours": NEAREST,
    "op5_chat_perspectives": CHAT,
    "op7_secret_scan": secrets_sql(),
    "op8_decontaminate": DECONTAMINATE,
    "op9_warc_roundtrip": WARC,
    "op10_shard": SHARD,
    "op13_fill_in_middle": INFILL,
}
