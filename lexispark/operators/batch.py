"""Many queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.profiles import Profile
from ..plans.scratch import sendable
from .score import posting_score
from .search import Searcher

#: Up to so many first characters of query terms prune the postings' partitions.
MOST_LETTERS = 1000


def batch_search(searcher: Searcher, queries: DataFrame, profile: Profile, limit: int = 10, operator: str = "and", decimals: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best documents of each (query_id, text).

    Bare terms only. Postings of other terms go before anything is computed; one
    join of the query terms with the scored rest, one aggregation by query and
    document, one ranking by query. Scores are summed to 18 decimals, the same on
    every run; sums of 10**20 and more are an error.
    """
    index = searcher.index
    lang = profile.code
    terms = queries.select("query_id", F.array_distinct(text.terms(F.col("text"), profile, index.normalise)).alias("terms"))
    asked = terms.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    wanted = asked.select("term").distinct()
    rows = index.postings.where(F.col("lang") == lang)
    letters = [r[0] for r in wanted.select(F.substring("term", 1, 1)).distinct().limit(MOST_LETTERS + 1).collect()]
    if len(letters) <= MOST_LETTERS:
        rows = rows.where(F.col("prefix1").isin(*letters) if letters else F.lit(False))
    boosts = {k: f.boost for k, f in index.fields.items()}
    # a posting is scored once, however many queries ask for its term
    found = rows.join(sendable(wanted, F.octet_length("term")), "term", "left_semi")
    scored = found.select("term", "doc_id", (posting_score(F.col("fields"), F.col("df"), searcher.counts.get(lang, 0), searcher.means.get(lang, {}), boosts) * F.coalesce("boost", F.lit(1.0))).alias("s"))
    # decimals add up to the same sum in any order, and in part before the shuffle
    exact = scored.withColumn("s", F.col("s").cast("decimal(38,18)"))
    hits = exact.join(sendable(asked, F.octet_length("term")), "term").groupBy("query_id", "doc_id").agg(F.sum("s").cast("double").alias("score"), F.count(F.lit(1)).alias("met"), F.max("n").alias("n"))
    if operator == "and":
        hits = hits.where("met = n")
    if decimals is not None:
        hits = hits.withColumn("score", F.round("score", decimals))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")
