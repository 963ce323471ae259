"""Registered queries of the operators in this folder and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import align, bestfit, codes, embedding, jaccard, licenses, merges, packing, pii, quality, rules, toxicity, wordpiece
from tallyspark.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str) -> str:
    """The installed public tokenizer file of that name."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.Settings(tokenizer_file("word_bpe_49k.json")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece length of every document."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), wordpiece.Settings(tokenizer_file("piece_bpe_32k.model")))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.93."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans and those that the field adds."""
    return pii.find(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and n-gram likelihood ratio of every document."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout, with checksums of ids and of the decoded text."""
    return merges.digests(table(spark, sf_dir, "documents"), merges.Settings(tokenizer_file("piece_bpe_32k.model")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every document by 4-word shingles at 0.85."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and quantisation error of every vector, from 16 codebooks of 64 entries."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return align.digests(table(spark, sf_dir, "documents"), align.Settings(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed whole into sequences of 2048 tokens."""
    return bestfit.pack(table(spark, sf_dir, "documents"), bestfit.Settings(tokenizer_file("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_token_counts": op5_token_counts,
    "op6_embedding": op6_embedding,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_merge_dropout": op9_merge_dropout,
    "op10_jaccard": op10_jaccard,
    "op11_codes": op11_codes,
    "op12_alignment": op12_alignment,
    "op13_best_fit": op13_best_fit,
}

def _codes_sql() -> str:
    """op11: integer parts, two rounds of nearest entries and floored means, final codes."""
    def nearest(k: int) -> str:
        return f"""a{k} AS (
            SELECT p.vec_id, p.j, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * 64 + b.k) AS m
            FROM p JOIN b{k} b ON b.j = p.j GROUP BY p.vec_id, p.j)"""

    def means(k: int) -> str:
        return f"""u{k} AS (
            SELECT p.j, (m % 64)::BIGINT AS k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.j = p.j),
        s{k} AS (SELECT j, k, i, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM u{k} GROUP BY j, k, i),
        t{k} AS (SELECT j, k, list(y ORDER BY i) AS c FROM s{k} GROUP BY j, k),
        b{k + 1} AS (SELECT b.j, b.k, coalesce(t.c, b.c) AS c FROM b{k} b LEFT JOIN t{k} t ON t.j = b.j AND t.k = b.k)"""
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id, len(e) // 16 AS d, e, unnest(range(16)) AS j FROM v),
        p AS (SELECT vec_id, j, e[j * d + 1:j * d + d] AS x FROM q),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 64),
        b0 AS (SELECT p.j, f.k, p.x AS c FROM p JOIN f ON f.vec_id = p.vec_id),
        {nearest(0)}, {means(0)}, {nearest(1)}, {means(1)}, {nearest(2)},
        z AS (SELECT vec_id, string_agg(format('{{:02x}}', (m % 64)::BIGINT), '' ORDER BY j) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM b2)
        SELECT z.vec_id, z.code, z.error, sum(z.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.codebooks_sha256
        FROM z JOIN v ON v.vec_id = z.vec_id CROSS JOIN h"""


SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op6_embedding": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(u, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.c = l.u),
        m AS (SELECT u, min(c) AS c FROM r GROUP BY u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
        FROM embeddings e JOIN m ON m.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op10_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
                END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT o.u, o.w FROM o JOIN n x ON x.doc_id = o.u JOIN n y ON y.doc_id = o.w WHERE 100 * o.k >= 85 * (x.n + y.n - o.k)),
        r(u, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.w FROM r JOIN l ON r.c = l.u),
        m AS (SELECT u, min(c) AS c FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
        FROM documents d JOIN m ON m.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
