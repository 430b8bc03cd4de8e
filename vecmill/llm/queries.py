"""Queries over the corpus tables: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Boilerplate is on more than a twentieth of a host's pages; a line on one page only is none, however few pages its host has.
LINE_RATIO, LINE_PAGES = 0.05, 2

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All pairs of a label, for tables of the size on which queries are compared.
EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT u.vec_id, min(w.vec_id) AS class_id, count(*) AS class_size FROM u JOIN u AS w ON u.label = w.label AND u.e = w.e GROUP BY u.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept,
  coalesce(k.class_id, vec_id) AS class_id, coalesce(k.class_size, 1) AS class_size FROM c LEFT JOIN k USING (vec_id)"""


#: All pairs of classes of equal sets that share a shingle, for tables of the size on which queries are compared.
JACCARD_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d),
c AS MATERIALIZED (SELECT g, min(doc_id) AS class_id, count(*) AS class_size FROM s WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY g),
t AS MATERIALIZED (SELECT class_id, len(g) AS n, unnest(g) AS x FROM c),
p AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM t AS a JOIN t AS b ON a.x = b.x AND a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(c.class_id, doc_id) AS class_id, coalesce(class_size, 1) AS class_size
FROM s LEFT JOIN c ON s.g = c.g AND doc_id IS NOT NULL LEFT JOIN m USING (class_id)"""


def byte_vocabulary() -> str:
    """The byte-level tokenizer file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, posterior and acceptance of all pages."""
    from .langid import identify_pages

    return identify_pages(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    from .line_dedup import drop_boilerplate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings of a label: cosine 0.98."""
    from .embed_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all pages' URLs."""
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: 3-word shingles, Jaccard 0.9."""
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, against all documents."""
    from .bm25 import search

    docs = _table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 20 = 0"), k=10, cluster="lang")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, and of what their tokens decode to."""
    from .bpe import bpe_roundtrip

    return bpe_roundtrip(_table(spark, sf_dir, "documents"), byte_vocabulary())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    from .licenses import license_digest, license_scan

    return license_digest(license_scan(_table(spark, sf_dir, "documents")))


#: A conversation whose texts are control strings of another template.
_EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one made of control strings."""
    from .chat import digest_conversations

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(_EXTRA, "conv_id long, turn long, role string, text string")
    return digest_conversations(rows.unionByName(extra))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), byte_vocabulary(), window=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_language_id, op2_embedding_dedup, op3_jaccard_join, op4_url_filter, op5_bm25_topk, op6_bpe, op7_license_scan, op8_line_dedup, op9_chat_format, op10_packing, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .bm25 import search_sql
    from .chat import digest_sql
    from .licenses import license_sql
    from .line_dedup import line_dedup_sql
    from .url_filter import filter_urls_sql

    extra = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in _EXTRA)
    return {
        "op2_embedding_dedup": EMBEDDINGS_SQL,
        "op3_jaccard_join": JACCARD_SQL,
        "op4_url_filter": filter_urls_sql(),
        "op5_bm25_topk": search_sql(),
        "op7_license_scan": license_sql(),
        "op8_line_dedup": line_dedup_sql(LINE_RATIO, LINE_PAGES),
        "op9_chat_format": digest_sql(extra),
    }
