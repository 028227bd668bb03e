"""Packing of documents into training sequences by a grouping genetic algorithm.

Documents are dealt into shards by a hash, of about ``SHARD_ITEMS`` each, so
that shards don't grow with the corpus. Several islands evolve packings of a
shard apart from each other. Crossover injects whole well-filled bins of one
parent into the other, dissolves the bins in which injected documents lay, and
puts what was displaced back by best fit; between epochs each island's best
packing moves to the next island of its shard. The best packing of a shard's
islands is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_names, stored

CAPACITY = 2048
SHARD_ITEMS = 4096


def best_fit(sizes: np.ndarray, order: np.ndarray, assign: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put the items of ``order``, one after the other, where the least room is
    left over, opening a bin where none has room. Changes ``assign`` and ``fill``."""
    open_by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, f in enumerate(fill):
        if f < capacity:
            r = capacity - f
            open_by_room.setdefault(r, []).append(b)
            rooms |= 1 << r
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        enough = rooms >> s
        if enough:
            r = s + (enough & -enough).bit_length() - 1
            at = open_by_room[r]
            b = at.pop()
            if not at:
                rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        assign[i] = b
        r -= s
        if r:
            at = open_by_room.setdefault(r, [])
            if not at:
                rooms |= 1 << r
            at.append(b)


def _tidy(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins; fewer and fuller bins are better."""
    if not len(assign):
        return 1.0
    return float(((np.bincount(assign, sizes) / capacity) ** 2).mean())


def start(sizes: np.ndarray, n: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``n`` packings by best fit: by falling size, then by size with some noise."""
    out = []
    for k in range(n):
        noise = 1 if k == 0 else rng.uniform(0.7, 1.3, len(sizes))
        assign, fill = np.zeros(len(sizes), np.int32), []
        best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), assign, fill, capacity)
        out.append(_tidy(assign))
    return out


def cross(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` that holds some of ``b``'s fullest bins whole."""
    full = np.bincount(b, sizes)
    best = np.argsort(-full, kind="stable")[: max(1, len(full) // 2)]
    taken = best[rng.random(len(best)) < 0.3]
    if not len(taken):
        taken = best[:1]
    inject = np.isin(b, taken)
    fill_a = np.bincount(a, sizes)
    dissolved = np.zeros(len(fill_a), bool)
    dissolved[a[inject]] = True
    dissolved[np.argsort(fill_a, kind="stable")[: 1 + len(fill_a) // 20]] = True
    displaced = np.flatnonzero(dissolved[a] & ~inject)
    child = np.full(len(sizes), -1, np.int32)
    child[inject] = b[inject]
    stays = ~inject & ~dissolved[a]
    child[stays] = a[stays] + len(full)
    placed = child >= 0
    child[placed] = _tidy(child[placed])
    fill = np.bincount(child[placed], sizes[placed]).astype(int).tolist() if placed.any() else []
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], child, fill, capacity)
    return _tidy(child)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after ``generations`` children, best first; a child takes
    the worst one's place where it is better."""
    pool = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    serial = len(pool)
    for _ in range(generations):
        if len(pool) < 2 or len(sizes) < 2:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        child = cross(sizes, pool[i][2], pool[j][2], capacity, rng)
        f = fitness(sizes, child, capacity)
        if f > pool[-1][0]:
            pool[-1] = (f, serial, child)
            serial += 1
            pool.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in pool]


def words(text: Column) -> Column:
    """Length of a text in white-space-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = 3, epochs: int = 2, generations: int = 10, population: int = 4, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(bin_id, doc_id, piece, start, n_tokens): what each bin holds.

    A document longer than ``capacity`` tokens is cut into pieces of that
    length, each a bin of its own, and the rest is packed with the other
    documents; pieces count from 0 and ``start`` is their first token. Each
    token of each row is in exactly one bin and no bin exceeds the capacity.

    ``length`` is a column of token counts (by default the words of the text).
    A row of no tokens - a null or empty text - is listed once, with a null bin
    and 0 tokens. Repeated rows are packed one by one, rows with a null id like
    any other. Other columns are not used; an empty table gives no rows. The
    result is the same for the same rows, whatever their order.
    """
    check_names(id_col, "bin_id", "piece", "start", "n_tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    items = docs.select(F.col(id_col).alias("id"), (words(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0))).cast("int").alias("n"))
    count = docs.count()
    shards = max(1, -(-count // shard_items))
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(shards * islands, max(2 * parallel, shards * islands // 4)))
    # rows alike in id and length are numbered, so that however many they are they are
    # dealt among all shards; thousands at a time, so that no long array is made
    alike = items.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c"))
    blocks = alike.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 1000))))
    items = blocks.withColumn("k", F.explode(F.sequence(F.col("b") * 1000, F.least(F.col("b") * 1000 + 999, F.col("c") - 1))))
    at = F.pmod(F.xxhash64("id", "n", "k"), F.lit(shards))
    held = stored(items.groupBy(at.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("n", "id")), asc=False).alias("items")), "items")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, island, lengths = (c.to_pylist() for c in batch.columns)
            for s, k, n in zip(shard, island, lengths):
                rest = np.array(n, np.int64) % capacity
                rest = rest[rest > 0]
                pool = start(rest, population, capacity, np.random.default_rng([s, k, 0]))
                yield _row(s, k, rest.astype(np.int32), evolve(rest, pool, capacity, generations, np.random.default_rng([s, k, 1])), capacity)

    def later(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rest = np.frombuffer(r["rest"], np.int32).astype(np.int64)
                    pool = [np.frombuffer(p, np.int32) for p in r["pool"]]
                    if r["guest"] is not None:
                        pool = pool[: population - 1] + [np.frombuffer(r["guest"], np.int32)]
                    pool = evolve(rest, pool, capacity, generations, np.random.default_rng([r["shard"], r["island"], epoch]))
                    yield _row(r["shard"], r["island"], rest.astype(np.int32), pool, capacity)

        return run

    def _row(s, k, rest, pool, cap):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s], pa.int64()),
                pa.array([k], pa.int32()),
                pa.array([rest.tobytes()], pa.binary()),
                pa.array([[p.astype(np.int32).tobytes() for p in pool]], pa.list_(pa.binary())),
                pa.array([fitness(rest, pool[0], cap)]),
            ],
            names=["shard", "island", "rest", "pool", "fitness"],
        )

    form = "shard long, island int, rest binary, pool array<binary>, fitness double"
    state = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.n").alias("n"))
    state = stored(state.repartition(tasks, "shard", "island").mapInArrow(first, form), "islands")
    for epoch in range(1, epochs):
        guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("pool")[0].alias("guest"))
        moved = state.join(guests, ["shard", "island"], "left").select("shard", "island", "rest", "pool", "guest")
        state = stored(moved.repartition(tasks, "shard", "island").mapInArrow(later(epoch + 1), form), "islands")
    best = state.groupBy("shard").agg(F.max_by(F.col("pool")[0], F.struct("fitness", -F.col("island"))).alias("best"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                assign = np.frombuffer(batch.column(2)[i].as_py(), np.int32)
                items_ = batch.column(1)[i].values
                ids, n = items_.field("id"), np.asarray(items_.field("n")).astype(np.int64)
                whole, rest = n // capacity, n % capacity
                pieces = whole + (rest > 0)
                row = np.repeat(np.arange(len(n)), np.maximum(pieces, 1))
                piece = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(pieces, 1)) - np.maximum(pieces, 1), np.maximum(pieces, 1))
                tail = piece == whole[row]
                bins = np.full(len(row), -1, np.int64)
                bins[tail & (rest[row] > 0)] = assign
                own = ~tail
                bins[own] = (assign.max() + 1 if len(assign) else 0) + np.arange(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((shard << 24) + bins, mask=bins < 0),
                        ids.take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array((piece * capacity).astype(np.int32)),
                        pa.array(np.where(own, capacity, rest[row]).astype(np.int32)),
                    ],
                    names=["bin_id", "id", "piece", "start", "n_tokens"],
                )

    laid = held.join(best, "shard").select("shard", "items", "best").repartition(max(1, min(shards, tasks)), "shard")
    return laid.mapInArrow(lay, f"bin_id long, id {kind}, piece int, start int, n_tokens int").withColumnRenamed("id", id_col)
