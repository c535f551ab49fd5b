"""DuckDB SQL for the corpus queries that SQL can express."""

OP1 = """
WITH docs AS (
    SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS most FROM sources),
levels AS (
    SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE
            - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
),
targets AS (
    SELECT source, source_size, CASE WHEN most <= weight * level THEN most ELSE weight *
        (SELECT level FROM levels WHERE most > weight * level ORDER BY most / weight, place LIMIT 1) END AS target
    FROM levels
),
expected AS (
    SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS step,
        ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 6))::BIGINT AS draw
    FROM targets
),
running AS (
    SELECT d.doc_id, d.size, e.source_size, e.target, e.step,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(d.doc_id % 64, 0), d.doc_id) * e.step + e.draw AS after
    FROM docs d JOIN expected e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * ((after >> 24) - ((after - step) >> 24)))::BIGINT AS taken FROM running
"""

OP8 = """
WITH docs AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM docs WINDOW w AS (PARTITION BY text_sha256)
"""

OP12 = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_inner_product(a.x, r.x)::BIGINT AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0
),
positives AS (
    SELECT * FROM scored WHERE label = anchor_label AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
        AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

ORACLE_SQL = {"op1_mix_sources": OP1, "op8_bloom_exact_dedup": OP8, "op12_hard_negatives": OP12}
