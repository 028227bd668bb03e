"""Exact top-k search by inner product with the threshold algorithm.

Vectors lie in shards. Each dimension of a shard has a list of its vectors in
the order of their value there; a shard's lists are a file in the shared folder.
For a query, all lists are read in step, from the end that its sign favours;
every vector met is scored in full, and reading stops when the bound - the sum
over dimensions of the query's number times the last value read - can't beat
the kth best score. Depths grow by half, so a list is read at most half as deep
again as the bound asks. The shards' best k are merged to the best k of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import check_names, scratch_path, stored

TOP = 10
SHARD_ROWS = 65_536
BLOCK_QUERIES = 128


class Lists:
    """One shard's sorted lists; ``ids`` and ``vectors`` in the order of the ids, which
    is that of equal scores. ``rising``: for each dimension the rows by rising value."""

    def __init__(self, vectors: np.ndarray, rising: np.ndarray | None = None):
        self.v = np.ascontiguousarray(vectors)
        self.rising = np.argsort(self.v, axis=0, kind="stable").astype(np.int32) if rising is None else rising
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", self.v, self.v, dtype=np.float64).max())) if len(self.v) else 0.0

    def top(self, q: np.ndarray, k: int, own: int = -1, first: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, depth read) of the ``k`` best by score, then row; row ``own`` is left out."""
        n, dims = self.v.shape
        q = q.astype(np.float64)
        used = np.flatnonzero(q)
        up = q > 0
        seen = np.zeros(n, bool)
        if own >= 0:
            seen[own] = True
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        depth = 0
        while depth < n:
            last, depth = depth, min(n, max(first, depth + depth // 2))
            mark = np.zeros(n, bool)
            for d in used:
                mark[self.rising[n - depth : n - last, d] if up[d] else self.rising[last:depth, d]] = True
            if depth == n:
                mark[:] = True  # where the query is zero everywhere no list says anything
            fresh = np.flatnonzero(mark & ~seen)
            seen[fresh] = True
            if len(fresh):
                if len(fresh) > 16 * k and np.isfinite(single := q.astype(np.float32)).all():
                    # single precision first; only what its rounding can't rule out is scored exactly
                    rough = (self.v @ single)[fresh] if 4 * len(fresh) > n else self.v[fresh] @ single
                    slip = 2e-6 * dims * self.longest * float(np.linalg.norm(q))
                    fresh = fresh[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slip]
                i = np.concatenate([best_i, fresh])
                s = np.concatenate([best_s, exact_scores(self.v[fresh], q)])
                if len(i) > k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    keep = s >= cut
                    i, s = i[keep], s[keep]
                order = np.lexsort((i, -s))[:k]
                best_i, best_s = i[order], s[order]
            if depth < n and len(best_i) == k:
                at = np.where(up, self.rising[n - depth], self.rising[depth - 1])[used]
                bound = float(np.dot(self.v[at, used].astype(np.float64), q[used]))
                # an unmet vector may still tie with the kth, and rounding may hide that
                if bound < best_s[-1] - 1e-9 * (1 + abs(bound)):
                    break
        return best_i, best_s, depth


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same way whatever
    the other rows are, so that equal vectors tie exactly."""
    return np.einsum("ij,j->i", v.astype(np.float64), q)


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(ok).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("v"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", skip_own: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's ``k`` vectors of greatest inner
    product, rank 1 first; of equal scores the lesser id comes first.

    Every usable row of ``queries`` is a query. With ``skip_own`` a vector of the
    query's own id is left out. A vector is compared only with queries of its
    length. Queries with fewer than ``k`` vectors to find have as many rows.

    Rows with a null id or whose vector is null, empty or holds a null, NaN or
    infinite number are not used. Repeated rows count once; of several vectors
    under one id the least (number by number) is used. Other columns are not
    used; an empty table gives no rows.
    """
    check_names(id_col, "query_id", "score", "rank")
    spark = vectors.sparkSession
    kind, of_query = vectors.schema[id_col].dataType, queries.schema[id_col].dataType.simpleString()
    held = stored(_usable(vectors, id_col, vec_col), "vectors")
    asked = stored(_usable(queries, id_col, vec_col), "queries")
    shards = max(1, -(-held.count() // shard_rows))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def dealt(rows: DataFrame, parts: int) -> DataFrame:
        d = F.size("v").alias("d")
        return rows.select(d, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v").groupBy("d", "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("v"))

    folder = scratch_path(spark, "lists")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, shard = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = batch.column(2)[i].values
                order = pc.sort_indices(ids).to_numpy()
                v = np.asarray(batch.column(3)[i].values).reshape(-1, d)[order]
                lists = Lists(v)
                made = pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), d), pa.FixedSizeListArray.from_arrays(pa.array(lists.rising.reshape(-1)), d)], names=["id", "v", "rising"])
                fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                fs.create_dir(path)
                part = f"{path}/{d}-{shard}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f, pa.ipc.new_file(f, made.schema) as out:
                    out.write_batch(made)
                fs.move(part, f"{path}/{d}-{shard}")  # a repeated task writes the same
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([shard], pa.int32())], names=["vd", "shard"])

    places = stored(dealt(held, shards).mapInArrow(sort, "vd int, shard int"), "shards")
    # each block of queries meets each shard once: what any exact search of all
    # queries must do. The blocks are dealt in turn, so that no task gets many
    left = dealt(asked, blocks).select("d", F.col("ids").alias("qi"), F.col("v").alias("qv"))
    tasks = max(1, min(blocks * shards, 20_000))
    both = left.join(places, F.col("d") == F.col("vd")).select("d", "shard", "qi", "qv").repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lists = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, shard = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                asked_ids = batch.column(2)[i].values
                qv = np.asarray(batch.column(3)[i].values).reshape(-1, d)
                if now != (d, shard):
                    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                    file = f"{path}/{d}-{shard}"
                    with pa.memory_map(file) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(file) as f:
                        table = pa.ipc.open_file(f).get_batch(0)
                    ids = table.column(0)
                    lists = Lists(*(table.column(c).flatten().to_numpy().reshape(-1, d) for c in (1, 2)))
                    now = d, shard
                own = pc.fill_null(pc.index_in(asked_ids, ids), -1).to_pylist() if skip_own else [-1] * len(asked_ids)
                found = [lists.top(q, k, o) for q, o in zip(qv, own)]
                yield pa.RecordBatch.from_arrays(
                    [asked_ids.take(pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))), ids.take(pa.array(np.concatenate([x[0] for x in found]))), pa.array(np.concatenate([x[1] for x in found]))],
                    names=["query_id", "id", "score"],
                )

    found = both.mapInArrow(run, f"query_id {of_query}, id {kind.simpleString()}, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)
