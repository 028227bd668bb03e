"""An index as Parquet tables: postings by language and first letter, sorted by term."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .index import TABLES, FieldDef, LexicalIndex

_MANIFEST = "manifest"


def save(index: LexicalIndex, path: str) -> None:
    """Write all tables below ``path``, the manifest last.

    Postings are partitioned by (lang, prefix1) and sorted by term within files,
    so that a query reads the row groups of its terms only; the ranges end in the
    document's id, so the postings of one frequent term are dealt among tasks. The
    rest is ranged by document or field.
    """
    index.postings.repartitionByRange("lang", "prefix1", "term", "doc_id").sortWithinPartitions("lang", "prefix1", "term", "doc_id").write.mode("overwrite").partitionBy("lang", "prefix1").parquet(f"{path}/postings")
    index.doc_store.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/doc_store")
    for name in TABLES:
        df = getattr(index, name)
        if name not in ("postings", "doc_store") and df is not None:
            (df.repartitionByRange("lang", "deletion") if name == "deletions" else df).write.mode("overwrite").parquet(f"{path}/{name}")
    known = {"fields": {k: asdict(v) for k, v in index.fields.items()}, "default_language": index.default_language, "synonyms": index.synonyms, "separators": index.separators, "buckets": index.buckets, "max_edits": index.max_edits, "normalise": index.normalise}
    spark = index.postings.sparkSession
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_MANIFEST}")


def load(spark: SparkSession, path: str) -> LexicalIndex:
    known = json.loads(spark.read.text(f"{path}/{_MANIFEST}").collect()[0][0])
    # the letters are text even where they look like numbers
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES if n not in ("postings", "deletions")}
    postings = spark.read.schema("term string, doc_id long, boost double, fields array<struct<field:string,tf:int,pos:array<int>,len:int>>, df long, lang string, prefix1 string").parquet(f"{path}/postings")
    return LexicalIndex(
        **tables,
        postings=postings,
        fields={k: FieldDef(**v) for k, v in known["fields"].items()},
        default_language=known["default_language"],
        synonyms=[tuple(s) for s in known["synonyms"]],
        separators=known["separators"],
        buckets=known["buckets"],
        max_edits=known["max_edits"],
        deletions=spark.read.parquet(f"{path}/deletions").select(F.col("lang"), "deletion", "term") if known["max_edits"] else None,
        normalise=known["normalise"],
    )
