"""BM25F as a row expression over a posting's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(doc_count: Column | float, df: Column) -> Column:
    n = doc_count if isinstance(doc_count, Column) else F.lit(float(doc_count))
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturate(weighted_tf: Column) -> Column:
    return weighted_tf / (weighted_tf + F.lit(K1))


def weighted_tf(tf: Column, length: Column, mean: Column | float, boost: Column | float = 1.0) -> Column:
    """tf of one field, normalised by its length; a mean length of 0 counts as 1."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    return F.lit(boost) * tf / (F.lit(1 - B) + F.lit(B) * length / F.when(mean == 0, F.lit(1.0)).otherwise(mean))


def _map(values: dict[str, float]) -> Column:
    flat = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.create_map(*flat) if flat else F.lit(None).cast("map<string,double>")


def posting_score(fields: Column, df: Column, doc_count: float, means: dict[str, float], boosts: dict[str, float]) -> Column:
    """Score of one posting: fields add up in name order, so the sum is the same on every run."""
    mean, boost = _map(means), _map(boosts)

    def add(acc: Column, f: Column) -> Column:
        m = F.coalesce(mean[f["field"]], f["len"].cast("double"))
        return acc + weighted_tf(f["tf"], f["len"], m, F.coalesce(boost[f["field"]], F.lit(1.0)))

    return idf(doc_count, df) * saturate(F.aggregate(fields, F.lit(0.0), add))
