"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import licences
from textloom.llm.bpe import op1_byte_bpe
from textloom.llm.fmindex import op4_fm_decontamination
from textloom.llm.jaccard import op6_signature_trees
from textloom.llm.licences import op7_licence_digests
from textloom.llm.lm import op8_attention_lm
from textloom.llm.pii import op5_surrogates
from textloom.llm.quality import op3_additive_quality
from textloom.llm.shards import op9_minimax_shards
from textloom.llm.topk import op2_tiled_topk
from textloom.llm.wavelet import op10_wavelet_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_tiled_topk, op3_additive_quality, op4_fm_decontamination, op5_surrogates,
        op6_signature_trees, op7_licence_digests, op8_attention_lm, op9_minimax_shards, op10_wavelet_ids,
    )
}
#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_tiled_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op4_fm_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, k, k + least(len(w), 10) - 1) AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS k FROM i WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op7_licence_digests": licences.sql(),
}
