"""The corpus operators as named queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers

from . import byte_bpe, cross_polytope, matroska, mixing, ppm_language, simhash, suffix_array, suffix_tree, token_index, toxicity
from .common import table


def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark, sf_dir):
    return suffix_array.remove(table(spark, sf_dir, "documents"))


def op3_suffix_tree(spark, sf_dir):
    return suffix_tree.remove(table(spark, sf_dir, "documents"))


def op4_ppm_language(spark, sf_dir):
    return ppm_language.detect(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_matroska(spark, sf_dir):
    return matroska.text_media(table(spark, sf_dir, "documents"))


def mixing_targets(spark, sf_dir):
    """What of op 1 SQL can express: sizes and targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "round(target, 4) AS target")


def media_payload(spark, sf_dir):
    """What of op 6 SQL can express: the payload that is read back."""
    return matroska.text_media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def media_packets(spark, sf_dir):
    return matroska.packet_table(matroska.files(table(spark, sf_dir, "documents")))


def op7_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op8_cross_polytope(spark, sf_dir):
    return cross_polytope.groups(table(spark, sf_dir, "embeddings"))


def op9_token_index(spark, sf_dir):
    return token_index.encode_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_suffix_array": op2_suffix_array,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_ppm_language": op4_ppm_language,
    "op5_toxicity": op5_toxicity,
    "op6_matroska": op6_matroska,
    "op7_simhash": op7_simhash,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_token_index": op9_token_index,
    "op10_byte_bpe": op10_byte_bpe,
    "media_packets": media_packets,
    "media_payload": media_payload,
    "mixing_targets": mixing_targets,
}
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "mixing_targets": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
        -- All sources up to a certain ratio of words to weight are full; the level of the others follows. The right one fills exactly those.
        l AS (SELECT a.source, ((SELECT sum(n) FROM w) - 3 * coalesce(sum(b.n), 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(b.w), 0)) AS level, any_value(a.n / a.w) AS ratio
            FROM w a LEFT JOIN w b ON b.n / b.w < a.n / a.w GROUP BY 1),
        o AS (SELECT min_by(level, ratio) AS level FROM l WHERE 3 * ratio >= level)
        SELECT doc_id, size, n AS source_size, round(CAST(least(3 * n, coalesce(level * w, 3 * n)) AS DOUBLE), 4) AS target
        FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source CROSS JOIN o
    """,
    "media_payload": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
        p AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad, t FROM d)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256 FROM p
    """,
    "op2_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS p FROM d),
        w AS (SELECT doc_id, p, n, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN p + 100 <= n THEN md5_number(substr(h, 2 * p + 1, 200)) END AS k FROM b),
        r AS (SELECT doc_id, p, byte, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM w),
        c AS (SELECT doc_id, p, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM c),
        a AS (SELECT doc_id, count(*) FILTER (gone) AS removed, count(*) FILTER (first) AS spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY 1)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN a ON a.doc_id = d.doc_id
    """,
    "op3_suffix_tree": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p, ws FROM d),
        k AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= n THEN md5_number(array_to_string(ws[p:p + 19], ' ')) END AS k FROM w),
        r AS (SELECT doc_id, p, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM k),
        c AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
        a AS (SELECT doc_id, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
    """,
    "op8_cross_polytope": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id WHERE c.root < l.b),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
        m AS (SELECT id, min(root) AS root FROM c GROUP BY 1)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN m ON m.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """,
}
