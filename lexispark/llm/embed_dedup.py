"""Near-duplicate embeddings by a pivot-permutation index.

Some of the vectors, chosen by a hash, serve as pivots. A vector is described
by its nearest pivots in order. An inverted list for each pivot holds the
vectors that have it among their first; vectors that meet in a list, share
enough of their nearest pivots and have the cosine are linked. Lists are worked
through in blocks of a bounded size, and a pair that meets in several lists
counts in the least of them, so no pair is ever written or shuffled: what leaves
a block is how many links each vector has there, and what they connect.

Equal vectors are one node throughout, however many rows hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_names, class_rows, components, sampled, sendable, stored, united

THRESHOLD = 0.9
#: Pivots a square root of the number of vectors; lists then grow with the root as well.
PIVOTS_PER_ROOT = 8
#: Nearest pivots that describe a vector, and how many two vectors must share.
NEAREST = 16
SHARED = 3
#: A vector is in the lists of so many of its nearest pivots.
LISTED = 8
#: A block pairs about this many vectors of a list with as many.
BLOCK = 1000


def unit(rows) -> np.ndarray:
    v = np.asarray(rows, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(id_col: str, vec_col: str):
    v = F.col(vec_col)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (square > 0) & (square < float("inf")), F.lit(False))


def describe(v: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The ``nearest`` pivots of each vector in order; of equal ones the first."""
    near = v @ pivots.T
    n = min(nearest, pivots.shape[0])
    part = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < pivots.shape[0] else np.tile(np.arange(n), (len(v), 1))
    by = np.take_along_axis(near, part, 1)
    return np.take_along_axis(part, np.lexsort((part, -by), axis=1), 1)


def _block_links(pivot: int, side: np.ndarray, v: np.ndarray, listed: np.ndarray, near: np.ndarray, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places in the block) that meet in no lesser list than ``pivot``'s.

    ``side`` is 0 or 1 where the block pairs one part of a list with another, and
    -1 where it pairs all with all. The cheapest test comes first: cosines in
    single precision rule out most pairs, then shared pivots are counted, and
    what is left has its cosine in double precision.
    """
    u = unit(v)
    u4 = u.astype(np.float32)
    if side[0] < 0:
        a = b = np.arange(len(u))
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rough = u4[a] @ u4[b].T >= threshold - 1e-5
    if side[0] < 0:
        rough = np.triu(rough, 1)
    i, j = np.nonzero(rough)
    x, y = a[i], b[j]
    found_x, found_y = [x[:0]], [y[:0]]
    for at in range(0, len(x), 50_000):  # the tests of so many pairs at once
        p, q = x[at : at + 50_000], y[at : at + 50_000]
        both = (near[p][:, :, None] == near[q][:, None, :]).any(2).sum(1)
        first = np.where((listed[p][:, :, None] == listed[q][:, None, :]).any(2), listed[p], np.iinfo(np.int32).max).min(1)
        keep = (both >= shared) & (first == pivot)
        p, q = p[keep], q[keep]
        keep = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
        found_x.append(p[keep])
        found_y.append(q[keep])
    return np.concatenate(found_x), np.concatenate(found_y)


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, pivots_per_root: int = PIVOTS_PER_ROOT, nearest: int = NEAREST, shared: int = SHARED, listed: int = LISTED, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links), a row for each id.

    Two vectors are linked where they are equal or have at least the threshold
    for cosine; cosines are exact, and linked pairs are found with a recall of
    over 0.9. ``n_links`` counts a vector's links, and a class is what links
    connect, named by its least id. Vectors of different lengths are searched
    apart. All vectors are in the index; its pivots, ``pivots_per_root`` times
    the root of their number, are a sample by hash and are sent to every task
    (8 bytes times the root of the number of vectors, times their length, times
    ``pivots_per_root`` / 2).

    A vector that is null, empty, all zero or holds a null, NaN or infinite
    number has no links. Rows with a null id are left out; repeated rows count
    once; an id with several vectors has one row, with the least class of them
    and the sum of their links. Other columns are not used. An empty table
    gives no rows.
    """
    check_names(id_col, "class_id", "n_links")
    spark = vectors.sparkSession
    v = F.when(_usable(id_col, vec_col), F.col(vec_col).cast("array<float>"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), F.when(v.isNotNull(), F.xxhash64(v)).alias("s")).distinct()
    rows = stored(rows, "vectors")
    nodes = stored(rows.where("v is not null").groupBy("s").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")).withColumn("d", F.size("v")), "nodes")
    pivots = {}
    for d, n in sorted((r["d"], r["n"]) for r in nodes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()):
        want = max(2 * nearest, int(pivots_per_root * n**0.5))
        chosen = sampled(nodes.where(F.col("d") == d).select("s", "v"), want, n, "s").toArrow()
        pivots[d] = unit(chosen["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)).astype(np.float32)
    sent = spark.sparkContext.broadcast(pivots)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.array(batch.column(3))
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                for lo in range(0, len(at), 2000):
                    some = at[lo : lo + 2000]
                    part = batch.take(pa.array(some))
                    u = unit(np.asarray(part.column(2).flatten()).reshape(len(some), size))
                    order = describe(u.astype(np.float32), sent.value[size], nearest).astype(np.int32)
                    m, few = order.shape[1], min(listed, order.shape[1])
                    near = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * m), pa.array(order.reshape(-1)))
                    first = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * few), pa.array(order[:, :few].reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(3), first, part.column(0), part.column(1), part.column(2), near], names=["d", "pivots", "s", "mult", "v", "near"])

    form = "d int, pivots array<int>, s long, mult long, v array<float>, near array<int>"
    described = stored(nodes.select("s", "mult", "v", "d").mapInArrow(lists, form), "lists")
    entries = described.select("d", F.explode("pivots").alias("pivot"), "s", "mult", "v", "near")
    # long lists are cut into parts, and each pair of parts is a block
    long = entries.groupBy("d", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    own = F.coalesce(F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"), F.lit(0))
    dealt = entries.join(sendable(long), ["d", "pivot"], "left").withColumn("p", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("p") == F.col("o"), -1).otherwise((F.col("p") > F.col("o")).cast("int"))
    dealt = dealt.select("d", "pivot", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), F.struct("s", "mult", side.alias("side"), "v", "near").alias("e"))
    work = dealt.groupBy("d", "pivot", "i", "j").agg(F.collect_list("e").alias("es")).where(F.size("es") > 1).select("d", "pivot", "es")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, pivot, es = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values
                s, mult = es.field("s").to_numpy(), es.field("mult").to_numpy()
                near = np.asarray(es.field("near").flatten()).reshape(len(s), -1)
                vs = np.asarray(es.field("v").flatten()).reshape(len(s), d)
                x, y = _block_links(pivot, es.field("side").to_numpy(), vs, near[:, :listed], near, threshold, min(shared, near.shape[1]))
                if not len(x):
                    continue
                n = np.bincount(x, mult[y], len(s)) + np.bincount(y, mult[x], len(s))
                linked, root = united(s[x], s[y])
                order = np.argsort(s)
                yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(root), pa.array(n[order[np.searchsorted(s[order], linked)]].astype(np.int64))], names=["s", "root", "n"])

    linked = stored(work.mapInArrow(link, "s long, root long, n long"), "links")
    joined = components(linked, "s", "root").withColumnRenamed("node", "s")
    links = stored(joined.join(linked.groupBy("s").agg(F.sum("n").alias("n")), "s"), "linked")
    return class_rows(rows.select("id", "s"), nodes.select("s", "rep", "mult"), links, id_col)
