"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import drop, fresh, scratch_path, sendable, shared_dir, stored

__all__ = ["bounded", "byte_view", "check_names", "class_rows", "components", "drop", "fresh", "grams_of", "lean", "list_array", "mix", "read_file", "sampled", "scratch_path", "sendable", "shared_dir", "stored", "table", "united", "words_of", "write_file"]

#: Edges up to this many (16 bytes each) are united in one task, and by rounds of joins beyond.
ONE_TASK_EDGES = 1_000_000
#: Nodes that stand for so many rows are few enough to be sent to every task.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_names(id_col: str, *made: str) -> None:
    """The id keeps its name in the result, so it can't be that of another result column."""
    if id_col.lower() in made:
        raise ValueError(f"the id column can't be called {id_col!r}, as the result has a column of that name")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of an Arrow string array and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def bounded(batches, rows: int = 2000, size: int = 3 << 20):
    """Cut record batches so that none holds more than ``rows`` rows or, but for
    a single longer text, about ``size`` bytes."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).get_total_buffer_size and batch.slice(start, n).nbytes > size:
                n = max(1, n // 2)
            yield batch.slice(start, n)
            start += n


def lean(run):
    """``run``, a function for mapInArrow, that gives the memory its task has freed back to
    the system when it begins and ends. Workers are used again, and what their allocators
    keep would add up with what the next task takes, beside the JVM's whole heap."""

    def give_back() -> None:
        if len(_POWERS.get("up", ())) > _SMALL:  # of an operator with larger batches
            _POWERS.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    def wrapped(batches):
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_MULT = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_SMALL = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is not None and len(have) >= n:
        return have[:n], _POWERS["down"][:n]
    size = max(_SMALL, 1 << (n - 1).bit_length())  # no more than the batches at hand need
    made = []
    with np.errstate(over="ignore"):
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            made.append(np.multiply.accumulate(step, out=step))
    if size <= 1 << 22:  # what a single longer text needs isn't kept
        _POWERS["up"], _POWERS["down"] = made
    return made[0][:n], made[1][:n]


# A byte that belongs to a word: ASCII letters and digits, and every byte of a
# character beyond ASCII. ASCII capitals count as small letters.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: (hash, start, end, words before each text).

    ``start`` and ``end`` count bytes from the first text's start. The last
    array has n + 1 entries. A word never spans two texts.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(ends), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((_FOLD[data] + np.uint64(1)) * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    return h, start, end, np.searchsorted(start, ends)


def grams_of(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and each one's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            g = mix(g) * np.uint64(3) + h[i : len(h) - k + 1 + i]
    text = np.searchsorted(before, np.arange(len(h)), side="right")
    at = np.flatnonzero(text[: len(g)] == text[k - 1 :])
    return mix(g[at]), at


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def sampled(df: DataFrame, n: int, expected: int, *by: str, seed: int = 7) -> DataFrame:
    """The ``n`` of ``expected`` rows that come first by a hash of the columns ``by``, then
    by these: the same on every run, and never more than ``n``, however often rows repeat."""
    h = F.xxhash64(*by, F.lit(seed))
    if expected > 2 * n:
        # twice as many as needed, so that no more of them are sorted; the hash takes
        # all 64 bits, so no share is too small to be told from none
        df = df.where(h < F.lit((2 * n << 64) // expected - (1 << 63)))
    return df.orderBy(h, *by).limit(n)


def write_file(folder: str, name: str, parts: list[np.ndarray]) -> None:
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(path)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    fs.move(part, f"{path}/{name}")  # a repeated task writes the same


def read_file(folder: str, name: str) -> pa.Buffer | None:
    """What the file holds, None where there is none."""
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    file = f"{path}/{name}"
    if fs.get_file_info(file).type == pa.fs.FileType.NotFound:
        return None
    with fs.open_input_file(file) as f:
        return f.read_buffer()


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each is linked to) of edges, by hooking and halving paths."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        apart = lo != hi
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def components(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root): every node (a long) of a pair, with the least node it is linked to.

    Up to ONE_TASK_EDGES edges one task unites them; beyond that rounds of
    joins, each written out, hook every root to its least neighbour until none
    changes. Both give the same.
    """
    edges = stored(pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    if edges.count() <= ONE_TASK_EDGES:

        def run(batches):
            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if held:
                nodes, root = united(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                for at in range(0, len(nodes), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(root[at : at + 100_000])], names=["node", "root"])

        return edges.coalesce(1).mapInArrow(run, "node long, root long")
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
    roots = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "roots")
    while True:
        seen = both.join(roots.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(seen, "node").select("node", F.least("root", "near").alias("next"), "root")
        # follow the new root one step further
        jump = step.join(roots.select(F.col("node").alias("next"), F.col("root").alias("far")), "next", "left")
        new = stored(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")), "roots")
        changed = new.where("root <> old").limit(1).count()
        drop(roots)
        roots = new.select("node", "root")
        roots._scratch = new._scratch
        if not changed:
            drop(edges)
            return roots


def class_rows(members: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, n_links), a row for each id of ``members``.

    ``members``: (id, s), an id's content as a node, null where it has none.
    ``nodes``: (s, rep, mult), the least id of a node and how many ids it stands for.
    ``links``: (s, root, n) of linked nodes: their component, and the ids they are linked to.
    A class has the least of its ids for a name. Ids of one content are linked
    to each other. An id with several contents has the least class of them and
    the sum of their links.
    """
    own = nodes.select("s", "rep").join(links, "s")
    named = own.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = sendable(stored(named, "classes"))
    info = own.join(named, "root").select("s", "class_id", "n")
    full = nodes.join(info, "s", "left").where((F.col("mult") > 1) | F.col("n").isNotNull())
    full = stored(full.select("s", "mult", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links")), "nodes")
    # a node of very many ids would be one task of a join: there are few of them, so they are sent
    hot, cold = full.where(F.col("mult") >= HOT), full.where(F.col("mult") < HOT)
    none = members.where(F.col("s").isNull()).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    known = members.where(F.col("s").isNotNull())
    rest = known.join(F.broadcast(hot.select("s")), "s", "left_anti").join(cold, "s", "left")
    rows = none.unionByName(known.join(F.broadcast(hot), "s").select("id", "class_id", "n_links"))
    rows = rows.unionByName(rest.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return rows.groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")).withColumnRenamed("id", id_col)
