"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

#: Words, in RE2's spelling.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), grams AS (
    SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3
), hit AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM grams
), repeats AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY rid
), m AS (
    SELECT d.rid, doc_id, source, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN repeats r ON r.rid = d.rid
), f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), host AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::BIGINT)::DOUBLE AS failed FROM f GROUP BY source
), a AS (
    SELECT count(*) AS h, sum(n) AS docs, sum(failed) AS bad, sum(failed * failed / n) AS squares FROM host
), b AS (
    SELECT *, (bad + 0.5) / (docs + 1) AS mean FROM a
), c AS (
    SELECT *, mean * (1 - mean) AS within, squares / docs - 2 * mean * bad / docs + mean * mean - mean * (1 - mean) * h / docs AS between_ FROM b
), prior AS (
    SELECT mean, CASE WHEN between_ <= within / 1000001 THEN 1e6 ELSE least(greatest(within / between_ - 1, 1.0), 1e6) END AS strength FROM c
), verdict AS (
    SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
"""

#: Blocks are taken in the order of their source's shuffle, so a source's taken words are whole passes and a stretch from its start.
OP4 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mixed FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM s
), l AS (
    SELECT *, row_number() OVER o AS nth,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM w WINDOW o AS (ORDER BY most / w, encode(source) NULLS LAST)
), o AS (
    SELECT *, min(CASE WHEN most > level * w THEN nth END) OVER () AS first_open FROM l
), t AS (
    SELECT source, source_size, CASE WHEN first_open IS NULL OR nth < first_open THEN most ELSE least(w * max(CASE WHEN nth = first_open THEN level END) OVER (), most) END AS target FROM o
), p AS (
    SELECT *, greatest(1, least(256, source_size // 64)) AS step FROM t
), q AS (
    SELECT *, ceil(source_size / step)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM p
), r AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(2 * blocks, passes * blocks + floor((target - passes * source_size) / step + 0.5)::BIGINT) ELSE 0 END AS quota FROM q
), laid AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mixed, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d
)
SELECT doc_id, size, r.source_size, round(target, 3) AS target,
    CASE WHEN size = 0 THEN 0 ELSE (quota // blocks) * size + greatest(0, least(pos + size, (quota % blocks) * step) - pos) END::BIGINT AS taken
FROM laid JOIN r ON laid.source IS NOT DISTINCT FROM r.source
"""

OP7 = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, text, source, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), l AS (
    SELECT rid, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 AS long_enough FROM l
), b AS (
    SELECT line, min(doc_id) AS first_doc FROM k WHERE long_enough GROUP BY line HAVING count(DISTINCT site) >= 10
), j AS (
    SELECT k.rid, k.i, k.line, b.line IS NOT NULL AND k.doc_id IS DISTINCT FROM b.first_doc AS gone FROM k LEFT JOIN b ON k.long_enough AND k.line = b.line
), kept AS (
    SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed FROM j GROUP BY rid
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(kept.text, '')) AS kept_md5
FROM d LEFT JOIN kept ON kept.rid = d.rid
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op1_quality_rules": OP1, "op4_mix_sources": OP4, "op7_line_dedup": OP7, "op10_exact_top_k": OP10}
