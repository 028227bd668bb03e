"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, html_extract, language_id, license_scan, lm_scoring, ngram_join, packing, quality, topk
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs, depth=lm_scoring.DEEP))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_classes(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors).withColumn("score", F.round("score", 6))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_bpe": op2_bpe,
        "op3_ngram_join": op3_ngram_join,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_html_extract": op5_html_extract,
        "op6_embed_dedup": op6_embed_dedup,
        "op7_packing": op7_packing,
        "op8_license_scan": op8_license_scan,
        "op9_quality": op9_quality,
        "op10_topk": op10_topk,
        "pipeline": pipeline,
    }


_TOPK_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: ``sym`` (a, b) are links in both directions, ``ids`` (id) all rows: classes by reachability.
_CLASSES = """r(id, root) AS (SELECT id, id FROM ids UNION SELECT sym.b, r.root FROM r JOIN sym ON r.id = sym.a),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT c.id AS {id}, c.class_id, coalesce(n.n, 0)::BIGINT AS n_links FROM c LEFT JOIN n ON n.a = c.id"""
_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LETTERS}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE same / (x.n + y.n - same)::DOUBLE >= 0.7e0),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), ids AS (SELECT DISTINCT doc_id AS id FROM documents),
""" + _CLASSES.format(id="doc_id")

_EMBED_SQL = """
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
sym AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id WHERE list_inner_product(x.e, y.e) / (x.l * y.l) >= 0.9e0), ids AS (SELECT id FROM u),
""" + _CLASSES.format(id="vec_id")


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": _JACCARD_SQL, "op6_embed_dedup": _EMBED_SQL, "op10_topk": _TOPK_SQL}
