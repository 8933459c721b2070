"""Queries over the tables of a folder, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, lines, media, neardup, quality, secrets, toxicity, warc
from .common import bucket_of, shared_dir, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def _held_out(modulus: int, remainder: int):
    return F.coalesce(bucket_of(F.col("doc_id"), modulus) == remainder, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~_held_out(5, 0)))
    return quality.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(~_held_out(3, 1)))
    return toxicity.score(docs, machine).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record for each page, then read the archive back."""
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path, pages.schema["page_id"].dataType.simpleString())


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as baseline JPEG, read it back, compute features."""
    return media.store_texts(table(spark, sf_dir, "documents"), keep_media=False)


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Encode and decode every text by the ranks of a public vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_column(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, keep_ids=False)


#: A conversation whose texts contain the template's own control strings.
ADVERSE = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and an adverse one; digests of what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", ADVERSE), (-7, 1, "assistant", ADVERSE)], "conv_id long, turn long, role string, text string")
    extra = extra.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))
    return chat.read_back(chat.format_conversations(rows.union(extra)))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of repeated runs."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all documents."""
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_media": op5_media,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_lines": op8_lines,
    "op9_neardup": op9_neardup,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {
    "op10_decontamination": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM documents
        ), i AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM benchmark
        ), iw AS (
          SELECT DISTINCT item_id, least(10, len(ws)) AS l, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g
          FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)
        ), ls AS (SELECT DISTINCT l FROM iw),
        dw AS (
          SELECT doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') AS g
          FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, ls WHERE len(ws) >= l)
        ), h AS (SELECT doc_id, dw.p, dw.l, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
        k AS (
          SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
    """,
    "op9_neardup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') AS ws
          FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
          FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x),
        m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
               coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id
    """,
    "op4_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN m IS NOT NULL AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m <> page_id THEN m END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op7_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
          SELECT *, 14 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c'))
                 + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) AS n
          FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
