"""The queries of this package, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _common, bytebpe, fingerprint, langid, neardup, packing, pii, quality, suffix, tokenfile, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def clean(spark: SparkSession) -> None:
    """Removes the tables and files that operators wrote so far."""
    _common.clean(spark)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids along walks over related ones."""
    return packing.pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2, 4096)


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in byte-plane files, written and read back."""
    return tokenfile.write_and_read(_docs(spark, sf_dir).select("doc_id", "text"), vocabulary("word_bpe_49k.json"), 2)


def op3_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of whole texts, and their decoding."""
    import public_tokenizers

    return bytebpe.encode_decode(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole texts."""
    return pii.scan(_docs(spark, sf_dir))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of whole texts and of their edited texts."""
    return fingerprint.fingerprints(_docs(spark, sf_dir), width=5, k=256)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole texts by weak supervision."""
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and compression bands over whole texts."""
    return quality.rules(_docs(spark, sf_dir))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 4-word shingles; the columns of its SQL."""
    return neardup.near_duplicates(_docs(spark, sf_dir), words=4, percent=80).drop("first")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier too."""
    return suffix.dedup(_docs(spark, sf_dir), length=100)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of whole texts by character models."""
    return langid.identify(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY 1),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS to_ FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_),
    c AS (SELECT id, min(to_) AS component_id FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(d.doc_id) OVER (PARTITION BY coalesce(n.k, d.doc_id::VARCHAR)), d.doc_id) AS class_id, component_id, component_id = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id"""
_SUFFIX = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    q AS (SELECT doc_id, list_transform(range(0, greatest(length(h) // 2 - 99, 0)), lambda i: md5_number_lower(substr(h, 2 * i + 1, 200))) AS m FROM h),
    p AS (SELECT doc_id, unnest(range(0, len(m))) AS i, unnest(m) AS m FROM q),
    k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM p),
    s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM k WHERE r > 1),
    g AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s) GROUP BY doc_id, g),
    o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
    t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM o GROUP BY 1),
    u AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM o JOIN h USING (doc_id) GROUP BY 1)
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express whole; the others are tested against brute force."""
    return {"op5_suffix": _SUFFIX, "op9_neardup": _NEAR}
