"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexispark import catalog  # noqa: E402
from lexispark.functions import profiles  # noqa: E402
from lexispark.operators.batch import batch_search  # noqa: E402
from lexispark.operators.search import Options, Searcher  # noqa: E402
from lexispark.plans import index as ix  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 4)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    docs = catalog.table(spark, sf_dir, "documents")
    n = docs.count()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()

    def spread(df):
        # the tables are single small files: without this one task would read and analyse all
        return df.repartition(2 * int(cpus))

    # the product's build: all languages with their stems, validation, document store with content hashes, facets
    documents = spread(catalog.documents(spark, sf_dir).drop("lang").join(docs.select("doc_id", "lang"), "doc_id")).persist()
    noop(documents)  # the documents are in memory when the build begins, as the baseline's are

    def build():
        index = ix.build_documents(documents, catalog.FIELDS, on_unsupported_language="fallback")
        noop(index.postings)
        noop(index.doc_store)
        noop(index.facet_values)
        return index

    def opened():
        held = index.cache()
        for t in (held.postings, held.doc_store, held.facet_values):
            noop(t)
        return Searcher(held)

    index = timed("index_build", build)
    searcher = timed("open_index", opened)
    asked = catalog.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    english = profiles.PROFILES["en"]
    timed("batch_or_top10", lambda: noop(batch_search(searcher, asked, english, operator="or")))
    many = timed("batch_and_top10", lambda: batch_search(searcher, asked, english, operator="and").count())
    classes = {
        "single_term": ("tionble", {}),
        "multi_term": ("er ha ea", {}),
        "prefix": ("tionb*", {}),
        "no_match": ("zzzznomatch", {}),
        "filtered": ("ha", {"filters": {"source": "src4"}}),
        "faceted": ("ha", {"facets": ("source",)}),
        "phrase": ('"ha er"', {}),
    }
    for name, (q, o) in classes.items():
        searcher.search(q, Options(**o))  # the first one compiles
        timed(f"query_{name}", lambda q=q, o=o: searcher.search(q, Options(**o)))
    total = round(sum(took.values()), 4)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"), "docs": n, "docs_per_sec": round(n / took["index_build"], 1), "batch_queries_per_sec": round(asked.count() / took["batch_or_top10"], 1), "batch_hits": many}))
    spark.stop()


if __name__ == "__main__":
    main()
