"""The registered queries of this subpackage, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from tessera.llm.audio import op2_audio_features
from tessera.llm.filter_audit import op13_filter_audit
from tessera.llm.importance import op5_importance_resampling
from tessera.llm.lexical_search import op12_lexical_search
from tessera.llm.minhash_dedup import op8_minhash_dedup
from tessera.llm.mixing import op7_mixing
from tessera.llm.packing import op9_packing
from tessera.llm.ring_shards import op10_ring_shards
from tessera.llm.suffix_dedup import op1_suffix_dedup
from tessera.llm.token_counts import op4_token_counts
from tessera.llm.token_files import op11_token_files
from tessera.llm.vector_dedup import op6_vector_dedup
from tessera.llm.warc import op3_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_audio_features": op2_audio_features,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_mixing": op7_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_packing": op9_packing,
    "op10_ring_shards": op10_ring_shards,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_filter_audit": op13_filter_audit,
}

_BASE32 = """array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k:
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT) >> k) & 31 AS BIGINT), 1)), '')), '')"""

#: The other operators make choices (audio features, seeded draws, places on a ring, groups of bins) or need what SQL lacks.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM p""",
    "op6_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
 r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE a = vec_id) AS BIGINT) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM embeddings JOIN r ON id = vec_id GROUP BY vec_id""",
    "op8_minhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
 u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN r ON id = s.doc_id GROUP BY s.doc_id, g""",
    "op12_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 q AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
 total AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM t),
 u AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM t),
 tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * total.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, total.n),
 s AS (SELECT item, item_id, row, doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * total.n) // total.l)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
 l AS (SELECT doc_id, CAST(max(CAST(quality = 1 AS INT)) AS BIGINT) AS good, CAST(max(CAST(toxic = 1 AS INT)) AS BIGINT) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
  + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first_id, false) AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
 o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, step, o[step] AS i, 1 << o[step] AS bit, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 x AS (SELECT *, mask & bit > 0 AS fails, mask & before > 0 AS gone FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
 CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step""",
}
