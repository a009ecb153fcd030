"""SQL for the queries that it can express over whole tables."""

from __future__ import annotations

# Usable vectors, one an id; equal similarities go to the smaller id, compared by bytes.
P1_EXACT = """
WITH good AS (SELECT id, min(vector) AS v FROM train_vectors
    WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
    GROUP BY id),
pairs AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS s FROM good a JOIN good b ON a.id <> b.id)
SELECT id, other FROM pairs WHERE s >= 0.85
QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 10
"""

# A profession in one spelling; records are one row an id, the one loaded last.
_P = "replace(replace(lower(trim(profession)), ' ', '_'), '-', '_')"
_RECORDS = f"""(SELECT id, batch_id, profession, gender FROM (
    SELECT id, batch_id, {_P} AS profession, gender, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS n
    FROM source_rows WHERE id IS NOT NULL) WHERE n = 1)"""

P4_FOUND = f"""
WITH have AS (SELECT batch_id, profession, gender, count(*) AS available FROM {_RECORDS} GROUP BY ALL)
SELECT t.request_id, t.profession, t.gender
FROM sample_targets t JOIN sample_requests r USING (request_id)
LEFT JOIN have h ON h.batch_id = r.batch_id AND h.profession = t.profession AND h.gender = t.gender
WHERE coalesce(h.available, 0) < greatest(t.min_rows, round(r.sample_size * t.target_share))
"""

# Of the report the columns that hang on counts; what is taken of each cell is a fitted number (tests/llm).
P4_NEEDS = f"""
WITH have AS (SELECT batch_id, profession, gender, count(*) AS available FROM {_RECORDS} GROUP BY ALL)
SELECT t.request_id, t.profession, t.gender, CAST(round(r.sample_size * t.target_share) AS BIGINT) AS target_rows,
    CAST(t.min_rows AS BIGINT) AS min_rows, coalesce(h.available, 0) AS available,
    coalesce(h.available, 0) >= greatest(t.min_rows, round(r.sample_size * t.target_share)) AS met
FROM sample_targets t JOIN sample_requests r USING (request_id)
LEFT JOIN have h ON h.batch_id = r.batch_id AND h.profession = t.profession AND h.gender = t.gender
"""

P6_FOUND = """
SELECT d.doc_id, w.window_name
FROM documents d JOIN context_windows w ON octet_length(encode(d.text)) > w.max_tokens - w.reserved_tokens
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_exact": P1_EXACT, "p4_found": P4_FOUND, "p4_needs": P4_NEEDS, "p6_found": P6_FOUND}
