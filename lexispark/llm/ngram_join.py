"""Jaccard self-join of documents on word n-grams, by rarest grams and parity sketches.

A document is the set of its word n-grams. In any one order of all grams, two
sets of at least the threshold share one of the first grams of each, the prefix:
all but the threshold's share of the set, and one. The order is by how often a
gram's bucket occurs in a sample, rarest first; what the sample misses costs time
only, for the guarantee holds in every order. The join is on the grams of the
prefixes. A pair is left out where sizes differ too much, or where too little
of a set follows the first shared gram. Of the rest a pair whose 64-bit SimHashes
are close is a tie, and ties are united as they are found, so what travels is in
proportion to the documents; other pairs are listed, and become ties unless
their 512-bit parity sketches are further apart than the greatest allowed
difference. (Dealing the grams of a set to bits and flipping a bit for each makes
a parity sketch: the Hamming distance of two is at most the size of the sets'
symmetric difference, for a shared gram flips the same bit in both. Sets of over _DEEP grams
have a second one, of at least two bits a gram, for 512 bits fill up.) So every
pair of the result lies in a group that ties link. Within the groups all pairs
are candidates: the sketches' distance is tested, then the exact Jaccard
coefficient of the gram sets.

Equal sets are one node throughout, so a text that a third of all documents
hold is compared once, however many they are. The sets of a group of several
blocks are written once, and read for every two blocks that are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_view, check_names, class_rows, components, drop, fresh, grams_of, lean, mix, read_file, scratch_path, sendable, stored, united, words_of, write_file

N = 2
THRESHOLD = 0.7
_WIDE = 8
#: The order of grams comes from so many documents, by 2 ** _BUCKETS buckets of the grams' hashes.
SAMPLE = 12_000
_BUCKETS = 22
#: Two sets look alike where so many of the 64 bits of their SimHashes differ at most.
_ALIKE = 6
#: A prefix gram that more sets share is hot: they are tied to leaders first, and
#: only those of different leaders are compared.
HOT_SAMPLED = 64
#: A task joins about so many prefix grams.
_SHARD = 1 << 19
#: Sets of more grams have a sketch that grows with them.
_DEEP = 128
#: About so many sets' sketches in a file.
_FILE_SETS = 100_000
#: Bytes of text whose grams are taken at a time: their arrays take some 40 times as many.
_TEXT = 1 << 20
#: Pairs listed before a task gives them out.
_LISTED = 1 << 19
#: A block of the last test holds about this many documents of a side.
BLOCK = 2000


def gram_sets(data: np.ndarray, ends: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of every text, sorted: (hashes, where each text's begin, n + 1 entries).

    A text of fewer than ``n`` words, but some, has the one gram of all of them.
    """
    h, _, _, before = words_of(data, ends)
    g, at = grams_of(h, before, n)
    of = np.searchsorted(before, at, side="right") - 1
    count = np.diff(before)
    for few in np.flatnonzero((count > 0) & (count < n)):
        part = h[before[few] : before[few + 1]]
        with np.errstate(over="ignore"):
            one = part[0]
            for x in part[1:]:
                one = mix(np.array([one]))[0] * np.uint64(3) + x
            g, of = np.append(g, mix(np.array([one + np.uint64(n)]))), np.append(of, few)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    if len(g):
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
        g, of = g[fresh], of[fresh]
    return g, np.searchsorted(of, np.arange(len(ends)))


def _prefixes(g: np.ndarray, first: np.ndarray, threshold: float, often: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of gram sets laid end to end: (grams in order, where each set's begin)."""
    size = np.diff(first)
    of = np.repeat(np.arange(len(size)), size)
    if often is not None:
        rank = often[(g >> np.uint64(64 - _BUCKETS)).astype(np.int64)].astype(np.int64)
        g = g[np.argsort(of * 256 + rank, kind="stable")]  # sets were in order of their hashes
    length = np.where(size > 0, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)
    length = np.minimum(length, size)
    return g[np.arange(len(g)) - first[of] < length[of]], np.concatenate([[0], np.cumsum(length)])


def _simhash(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each gram set, each what most of its grams have there."""
    size, out = np.diff(first), np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(size)
    step = 1 << 17  # grams at a time, but for longer sets
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(first[some + 1], first[some[at]] + step, side="right")))
        mine = some[at:to]
        lo, hi = first[mine[0]], first[mine[-1] + 1]
        bits = np.unpackbits(mix(g[lo:hi] + np.uint64(9)).view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, first[mine] - lo, axis=0, dtype=np.int32)
        out[mine] = np.packbits(2 * votes > size[mine, None], axis=1).view(np.uint64)[:, 0]
        at = to
    return out


def sketch_hash(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each of the gram sets laid end to end, 0 for an empty one."""
    size = np.diff(first)
    whole, some = np.zeros(len(size), np.uint64), size > 0
    if some.any():
        start = first[:-1][some]
        with np.errstate(over="ignore"):
            one, two = (np.add.reduceat(x, start) for x in (mix(g + np.uint64(1)), mix(g ^ np.uint64(0xABCDEF0123456789))))
            whole[some] = mix(mix(one) * np.uint64(3) + two + size[some].astype(np.uint64))
    return whole


def sketch(data: np.ndarray, ends: np.ndarray, n: int, threshold: float, *_, often: np.ndarray | None = None):
    """For each text: set size, set hash, wide sketch (texts x 8 words), SimHash, its prefix
    as (grams, where each text's begin), and the deep sketch of a large set. ``often`` ranks the buckets of grams."""
    g, first = gram_sets(data, ends, n)
    deep = [_deep(g[a:b]).tobytes() if b - a > _DEEP else None for a, b in zip(first[:-1], first[1:])]
    return np.diff(first), sketch_hash(g, first), _wide(g, first), _simhash(g, first), *_prefixes(g, first, threshold, often), deep


def gram_ranks(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """A rank, 0 for the rarest, of each bucket of grams, from at most SAMPLE documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000, _TEXT):
            g, _ = gram_sets(*byte_view(batch.column(0)), n)
            bucket, count = np.unique(g >> np.uint64(64 - _BUCKETS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64))], names=["bucket", "n"])

    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("id"), F.col(text_col).alias("t"))
    # rows by a hash of their id, no sort: the order need not be the same on every run
    rows = known.count()
    if rows > SAMPLE:
        known = known.where(F.col("id") < F.lit((SAMPLE << 64) // rows - (1 << 63)))
    found = known.select("t").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    often = np.zeros(1 << _BUCKETS, np.uint8)
    count = found["n"].to_numpy().astype(float)
    often[found["bucket"].to_numpy()] = np.minimum(255, np.round(16 * np.log2(np.maximum(count, 1))))
    return often


def sketches(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s, size, wide, sim, keys, deep) of each row with an id; ``s`` tells gram sets apart and
    is null where there is no word. ``keys`` are the grams of the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(gram_ranks(docs, n, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000, _TEXT):
            size, whole, wide, sim, key, first, deep = sketch(*byte_view(batch.column(1)), n, threshold, often=sent.value)
            texts = len(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(whole.view(np.int64), mask=size == 0),
                    pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * _WIDE), pa.array(wide.reshape(-1).view(np.int64))),
                    pa.array(sim.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(key.view(np.int64))),
                    pa.array(deep, pa.binary()),
                ],
                names=["id", "s", "size", "wide", "sim", "keys", "deep"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    form = f"id {kind}, s long, size int, wide array<long>, sim long, keys array<long>, deep binary"
    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(lean(run), form)


def _candidates(key: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, sim: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(one, other, whether they look alike) of documents that share a prefix gram and may
    reach the threshold; a pair may be missing where others that look alike tie it.

    ``key``, ``doc``, ``at``: grams, whose they are and their places in the prefix.
    """
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.append(same, False) | np.append(False, same)]  # what one document has pairs nothing
    if not len(order):
        return
    order = order[np.lexsort((size[doc[order]], key[order]))]
    key, doc, at = key[order], doc[order], at[order]
    size, sim = size[doc], sim[doc]
    rest = size - at
    share = threshold / (1 + threshold)

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        may = np.minimum(rest[i], rest[j]) >= (size[i] + size[j]) * share - 1e-6
        i, j = i[may], j[may]
        return doc[i], doc[j], np.bitwise_count(sim[i] ^ sim[j]) <= _ALIKE

    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(first, len(key)))
    i, d = np.flatnonzero(np.repeat(many <= HOT_SAMPLED, many)), 1
    while True:
        i = i[i + d < len(key)]
        i = i[(key[i] == key[np.minimum(i + d, len(key) - 1)])]
        i = i[size[i] >= threshold * size[i + d] - 1e-6]
        if not len(i):
            break
        yield kept(i, i + d)
        d += 1
    for lo, n in zip(first[many > HOT_SAMPLED], many[many > HOT_SAMPLED]):
        own, left = np.full(n, -1), np.arange(n)
        while len(left):
            lead = left[0]
            like = (np.bitwise_count(sim[lo + left] ^ sim[lo + lead]) <= _ALIKE) & (size[lo + lead] >= threshold * size[lo + left] - 1e-6)
            own[left[like]] = lead
            tied = lo + left[like]
            yield doc[np.full(len(tied), lo + lead)], doc[tied], np.ones(len(tied), bool)
            left = left[~like]
        # the pairs of different leaders: each but those of the most followed against all
        most = np.bincount(own).argmax()
        for x in np.flatnonzero(own != most):
            a, b = np.searchsorted(size[lo : lo + n], [threshold * size[lo + x] - 1e-6, size[lo + x] / threshold + 1e-6], side="left")
            y = np.arange(a, b)
            y = y[(own[y] != own[x]) & ((y > x) | (own[y] == most))]
            yield kept(np.full(len(y), lo + x), lo + y)


def _deep(g: np.ndarray) -> np.ndarray:
    """A parity sketch of one set with at least two bits a gram. Its words laid in rows of
    half as many, and the rows' parity taken, are the sketch of half the size."""
    words = _WIDE << max(0, math.ceil(math.log2(len(g) / (32 * _WIDE))))
    out = np.zeros(words, np.uint64)
    word = (g >> np.uint64(61)) + np.uint64(_WIDE) * (g & np.uint64(words // _WIDE - 1))
    np.bitwise_xor.at(out, word.astype(np.int64), np.uint64(1) << ((g >> np.uint64(55)) & np.uint64(63)))
    return out


def _near(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Of the pairs (u, v) of sets those whose sketches (s, size, wide, deep) are not too far
    apart. Sketches are written once, in ``parts`` files, and two of these read at a time, so
    that what a pair moves is its two names."""
    spark = pairs.sparkSession
    folder = scratch_path(spark, "sketches")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            write_file(folder, str(whole["part"][0].as_py()), [np.frombuffer(sink.getvalue(), np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.array([whole.num_rows], pa.int64())], names=["n"])

    def part(c: str):
        return F.pmod(F.col(c), F.lit(parts)).cast("int")

    # ranges of one part each, so that a task has one file
    sets.select(part("s").alias("part"), "s", "size", "wide", "deep").repartitionById(parts, "part").mapInArrow(lean(write), "n long").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple] = {}

        def of(p: int):
            if p not in have:
                while len(have) > 1:
                    have.pop(next(iter(have)))
                with pa.ipc.open_stream(read_file(folder, str(p))) as f:
                    whole = f.read_all().combine_chunks()
                s = whole["s"].to_numpy()
                order = np.argsort(s, kind="stable")
                wide = whole["wide"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _WIDE)
                have[p] = s[order], order, whole["size"].to_numpy(), wide, whole["deep"].combine_chunks()
            return have[p]

        for batch in batches:
            u, v, pu, pv = (batch.column(j).to_numpy() for j in range(4))
            take = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))  # equal pairs stand together
            cut = np.append(np.flatnonzero(np.append(True, (pu[1:] != pu[:-1]) | (pv[1:] != pv[:-1]))), len(u)) if len(u) else []
            for a, b in zip(cut, cut[1:]):
                (sx, ox, nx, wx, dx), (sy, oy, ny, wy, dy) = (of(int(p)) for p in (pu[a], pv[a]))
                i, j = ox[np.searchsorted(sx, u[a:b])], oy[np.searchsorted(sy, v[a:b])]
                na, nb = nx[i], ny[j]
                most = (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9
                take[a:b] &= np.bitwise_count(wx[i] ^ wy[j]).sum(1, dtype=np.int64) <= most
                for k in np.flatnonzero(take[a:b] & (np.minimum(na, nb) > _DEEP)):
                    x, y = np.frombuffer(dx[int(i[k])].as_buffer(), np.uint64), np.frombuffer(dy[int(j[k])].as_buffer(), np.uint64)
                    while len(x) > len(y):
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                    while len(y) > len(x):
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                    take[a + k] = np.bitwise_count(x ^ y).sum(dtype=np.int64) <= most[k]
            yield batch.select([0, 1]).filter(pa.array(take[: len(u)]))

    turned = part("u") > part("v")
    dealt = pairs.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"))
    # a task has few pairs of files, and a pair of files as many tasks as there are too few of them
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("u", "v"), F.lit(math.ceil(2 * tasks / (parts * (parts + 1)))))
    dealt = dealt.select("u", "v", part("u").alias("pu"), part("v").alias("pv")).repartition("pu", "pv", slot).sortWithinPartitions("pu", "pv", "u", "v")
    return dealt.mapInArrow(lean(run), "u long, v long")


def _ties(entries: DataFrame, threshold: float, shards: int) -> DataFrame:
    """(u, v, sure) of sets by (s, size, sim, keys): ``sure`` ties of sets that look alike,
    united, and all other pairs that may reach the threshold."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000):
            lists = batch.column(3)
            key, first = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(first)), first)
            at = np.arange(len(of)) - np.repeat(np.cumsum(first) - first, first)
            to = (mix(key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            info = [batch.column(j).to_numpy() for j in range(3)]
            out: list[list[bytes]] = [[] for _ in range(6)]
            for i in some:  # one row a shard, not one a gram: what travels is arrays
                mine = order[cut[i] : cut[i + 1]]
                docs, local = np.unique(of[mine], return_inverse=True)
                for held, x in zip(out, (key[mine], local.astype(np.uint16), at[mine].astype(np.uint32), *(x[docs] for x in info))):
                    held.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)], names=["shard", "k", "d", "a", "s", "size", "sim"])

    kinds = (np.uint64, np.uint16, np.uint32, np.int64, np.int32, np.int64)

    def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, _, at, s, size, sim = (np.concatenate(x) for x in zip(*held))
        before = np.cumsum([0] + [len(x[3]) for x in held[:-1]])
        doc = np.concatenate([x[1].astype(np.int64) + b for x, b in zip(held, before)])
        s, back = np.unique(s, return_inverse=True)  # a document comes once a batch
        doc, whole, bits = back[doc], np.zeros(len(s), np.int64), np.zeros(len(s), np.uint64)
        whole[back], bits[back] = size, sim.view(np.uint64)
        root, pairs, n = np.arange(len(s)), [], 0

        def listed() -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            code = np.unique(np.minimum(i, j) * len(s) + np.maximum(i, j))
            i, j = code // len(s), code % len(s)
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            return pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[j]), pa.array(np.zeros(len(i), bool))], names=["u", "v", "sure"])

        ties = []
        for i, j, alike in _candidates(key, doc, at.astype(np.int64), whole, bits, threshold):
            ties.append((i[alike], j[alike]))
            pairs.append((i[~alike], j[~alike]))
            n += len(i)
            if n > _LISTED:
                root = _rooted(root, ties)
                ties = []
                yield listed()
                pairs, n = [], 0
        root = _rooted(root, ties)
        if pairs:
            yield listed()
        tied = np.flatnonzero(root != np.arange(len(s)))
        yield pa.RecordBatch.from_arrays([pa.array(s[tied]), pa.array(s[root[tied]]), pa.array(np.ones(len(tied), bool))], names=["u", "v", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for shard, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if shard != now and held:
                    yield from found(held)
                    held = []
                now = shard
                held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds)])
        if held:
            yield from found(held)

    dealt = entries.select("s", "size", "sim", "keys").mapInArrow(lean(deal), "shard int, k binary, d binary, a binary, s binary, size binary, sim binary")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(run), "u long, v long, sure boolean")


def _rooted(root: np.ndarray, ties: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``root``, the least document each is tied to, with more ties."""
    if not ties:
        return root
    u, v = (np.concatenate(x) for x in zip(*ties))
    if not len(u):
        return root
    nodes, least = united(root[u], root[v])
    step = np.arange(len(root))
    step[nodes] = least
    return step[root]


def _wide(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """512-bit parity sketches (sets x 8 words) of gram sets laid end to end."""
    sets = len(first) - 1
    wide = np.zeros(sets * _WIDE, np.uint64)
    of = np.repeat(np.arange(sets), np.diff(first))
    np.bitwise_xor.at(wide, of * _WIDE + (g >> np.uint64(61)).astype(np.int64), np.uint64(1) << ((g >> np.uint64(55)) & np.uint64(63)))
    return wide.reshape(sets, _WIDE)


def _verify_block(side: list, raw: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in the block, coefficient) whose exact coefficient reaches the threshold.

    ``side`` is 0 or 1 where the block pairs one part of a group with another,
    and None where it pairs all with all. Sets go by size, so that those too
    small for a set come before it; the sketches' distance rules out most of
    the rest, and the sets themselves decide.
    """
    sets = [np.frombuffer(x, np.uint64) for x in raw]
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.concatenate([sets[i] for i in order])
    first = np.concatenate([[0], np.cumsum(size)])
    wide = _wide(flat, first)
    words, code = np.unique(flat, return_inverse=True)
    part = np.array([-1 if side[i] is None else side[i] for i in order])
    mark = np.zeros(len(words), bool)
    found_x, found_y, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(1, len(order)):
        lo = int(np.searchsorted(size, threshold * size[i] - 1e-9))
        if lo >= i:
            continue
        apart = np.bitwise_count(wide[lo:i] ^ wide[i]).sum(1, dtype=np.int64)
        near = apart <= (size[lo:i] + size[i]) * ((1 - threshold) / (1 + threshold)) + 1e-9
        if part[i] >= 0:
            near &= part[lo:i] != part[i]
        if not near.any():
            continue
        mark[code[first[i] : first[i + 1]]] = True
        both = np.add.reduceat(mark[code[first[lo] : first[i]]], first[lo:i] - first[lo], dtype=np.int64)
        mark[code[first[i] : first[i + 1]]] = False
        j = both / (size[lo:i] + size[i] - both)
        at = np.flatnonzero(near & (j >= threshold))
        found_x.append(np.full(len(at), order[i]))
        found_y.append(order[lo + at])
        found_j.append(j[at])
    return np.concatenate(found_x), np.concatenate(found_y), np.concatenate(found_j)


class _Plan:
    """The join up to its blocks: ``base`` (sketches), ``nodes`` (s, rep, mult) and
    ``work``, a row a block of sets to be compared."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str):
        spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
        self.base = base = stored(sketches(docs, n, threshold, id_col, text_col), "sketches")
        # one row a set: its least id, and how many ids have it
        by_id = base.where("s is not null").groupBy("s", "id").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        self.nodes = nodes = stored(by_id.groupBy("s").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("size").alias("size"), F.max("rows").alias("rows"), F.sum("rows").alias("held")), "sets")
        # a set of several rows gives its grams once
        again = sendable(nodes.where("held > 1").select("s"), fixed=24)
        grams = base.where("s is not null").select("s", "size", "sim", "keys")
        once = grams.join(again, "s", "left_semi").groupBy("s").agg(*[F.first(c).alias(c) for c in ("size", "sim", "keys")])
        entries = grams.join(again, "s", "left_anti").unionByName(once)
        much, many = nodes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).collect()[0]
        ties = stored(_ties(entries, threshold, max(1, math.ceil(much * (1 - threshold) / _SHARD))), "ties")
        # a listed pair of two sketches too far apart would link strangers' groups
        sketched = base.where("s is not null").select("s", "size", "wide", "deep")
        one = sketched.join(again, "s", "left_semi").groupBy("s").agg(*[F.first(c).alias(c) for c in ("size", "wide", "deep")])
        sketched = sketched.join(again, "s", "left_anti").unionByName(one)
        ends = _near(ties.where("not sure").select("u", "v"), sketched, threshold, max(1, math.ceil(many / _FILE_SETS)))
        ends = ends.unionByName(ties.where("sure").select("u", "v"))
        root = stored(components(ends), "roots").withColumnRenamed("node", "s")
        drop(ties)
        # all pairs of a linked group are verified, in blocks of a bounded size
        parts = root.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        parts = stored(parts.where("parts > 1"), "parts")
        own = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
        places = root.join(sendable(parts), "root", "left").select("s", "root", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce(own, F.lit(0)).alias("p"))
        places = stored(places.join(nodes.select("s", "rep", "mult"), "s"), "places")
        # a set's text is that of its least id; an id may have other texts besides
        texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("t"))
        side = sendable(places)
        if side is places:
            texts = _marked(texts, places.select("rep"), kind)  # only they are moved
        texts = texts.join(side, "rep").select("rep", "s", "mult", "root", "parts", "p", "t")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, 4000, _TEXT):
                data, ends_ = byte_view(batch.column(6))
                g, first = gram_sets(data, ends_, n)
                whole = sketch_hash(g, first)
                raw = [g[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                made = pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(raw, pa.binary())], names=["rep", "s", "mult", "root", "parts", "p", "grams"])
                yield made.filter(pa.array(whole.view(np.int64) == batch.column(1).to_numpy()))

        held = texts.mapInArrow(lean(sets), f"rep {kind}, s long, mult long, root long, parts int, p int, grams binary")
        self.members = base.select("id", "s")
        if nodes.where("rows > 1").limit(1).count():  # repeated rows
            held, self.members = held.dropDuplicates(["s"]), self.members.distinct()
        self.kind, self.threshold = kind, threshold
        whole = held.groupBy("root", "parts", "p").agg(F.collect_list(F.struct("s", "rep", "mult", "grams")).alias("sets"))
        if not parts.limit(1).count():
            self.work = whole.where(F.size("sets") > 1).selectExpr("root", "parts", "sets", "cast(null as string) folder", "cast(null as int) i", "cast(null as int) j")
            return
        # the sets of a split group are written once, a file a part; blocks are pairs of files
        folder = scratch_path(spark, "parts")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    if row.column(1)[0].as_py() == 1:
                        yield row
                        continue
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, row.schema) as out:
                        out.write_batch(row)
                    write_file(folder, f"{row.column(0)[0].as_py()}_{row.column(2)[0].as_py()}", [np.frombuffer(sink.getvalue(), np.uint8)])

        whole = whole.mapInArrow(lean(write), whole.schema)
        whole = stored(whole, "blocks")
        some = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        pairs = parts.select("root", "parts", some.alias("i")).select("root", "parts", "i", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)).alias("j"))
        pairs = pairs.repartition(F.col("root"), F.col("i"), F.col("j")).select("root", "parts", F.lit(None).cast(whole.schema["sets"].dataType).alias("sets"), F.lit(folder).alias("folder"), "i", "j")
        self.work = whole.where(F.size("sets") > 1).selectExpr("root", "parts", "sets", "cast(null as string) folder", "cast(null as int) i", "cast(null as int) j").unionByName(pairs)


def _marked(rows: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """``rows`` (rep, t) whose id is one of ``ids``, and few others: told by a bit for its hash."""
    size = 1 << min(28, max(16, math.ceil(math.log2(16 * ids.count() + 1))))
    spot = F.pmod(F.xxhash64("rep"), F.lit(size))
    marks = ids.select(spot.alias("x")).groupBy(F.shiftright("x", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 31 as int)))").alias("b")).toArrow()
    bits = np.zeros(size >> 5, np.uint32)
    bits[marks["w"].to_numpy()] = marks["b"].to_numpy().astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).to_numpy()
            take = (sent.value[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.select([0, 1]).filter(pa.array(take.astype(bool)))

    return rows.where("rep is not null").select("rep", "t", spot.alias("x")).mapInArrow(lean(run), f"rep {kind}, t string")


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float):
    """Of every block of ``work``: its sets, parts of its group, and the pairs in it."""
    for batch in batches:
        for i in range(batch.num_rows):
            root, parts = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if batch.column(3)[i].as_py() is None:
                block, side = batch.column(2)[i].values, None
            else:
                folder, *both = (batch.column(j)[i].as_py() for j in (3, 4, 5))
                read = []
                for p in dict.fromkeys(both):
                    whole = read_file(folder, f"{root}_{p}")
                    if whole is not None:  # a hash may leave a part empty
                        with pa.ipc.open_stream(whole) as f:
                            read.append((p != both[0], f.read_next_batch().column(3)[0].values))
                if not read or (len(read) == 1 and both[0] != both[1]):
                    continue
                block = pa.concat_arrays([x for _, x in read])
                side = np.repeat([int(k) for k, _ in read], [len(x) for _, x in read]).tolist() if len(read) > 1 else None
            raw = block.field("grams").to_pylist()
            yield block, parts, *_verify_block(side or [None] * len(raw), raw, threshold)


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b, of documents whose gram sets differ and are that similar.

    Documents with equal sets are one: the least id of them stands for all;
    ``jaccard_classes`` has their number. No pair that meets the threshold is left out,
    and what is listed has its exact coefficient. Words are runs of ASCII letters and digits and of
    characters beyond ASCII, capitals folded in ASCII.

    Rows with a null id, a null text or no word are in no pair. Repeated rows
    count once; where one id has several texts a pair has the greatest of their
    coefficients. Other columns are not used. An empty table gives no pairs.
    """
    plan = _Plan(docs, n, threshold, id_col, text_col)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, x, y, j in _blocks(batches, threshold):
            if len(x):
                rep = block.field("rep")
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(x)), rep.take(pa.array(y)), pa.array(j)], names=["x", "y", "jaccard"])

    near = plan.work.mapInArrow(lean(verify), f"x {plan.kind}, y {plan.kind}, jaccard double").where("x <> y")
    return near.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("jaccard").alias("jaccard"))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links), a row for each id.

    Two documents are linked where their gram sets are equal or have at least
    the threshold for Jaccard coefficient (found as ``jaccard_pairs`` says);
    ``n_links`` counts a document's links, and a class is what links connect,
    named by its least id. A document without links is its own class.

    A null or empty text, or one without words, has no links. Rows with a null
    id are left out; repeated rows count once; an id with several texts has one
    row, with the least class of its texts and the sum of their links. Other
    columns are not used. An empty table gives no rows.
    """
    check_names(id_col, "class_id", "n_links")
    plan = _Plan(docs, n, threshold, id_col, text_col)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts, x, y, _ in _blocks(batches, threshold):
            if not len(x):
                continue
            s, mult = block.field("s").to_numpy(), block.field("mult").to_numpy()
            n_links = np.bincount(x, mult[y], len(s)) + np.bincount(y, mult[x], len(s))
            nodes, root = united(s[x], s[y])
            order = np.argsort(s)
            own = order[np.searchsorted(s[order], nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.array(n_links[own].astype(np.int64)), pa.array(np.full(len(nodes), parts > 1))], names=["s", "root", "n", "split"])

    linked = stored(plan.work.mapInArrow(lean(verify), "s long, root long, n long, split boolean"), "links")
    # a group in one block has its components; those of split groups are put together
    joined = components(linked.where("split"), "s", "root")
    whole = linked.where("not split").select("s", "root").unionByName(joined.select(F.col("node").alias("s"), "root"))
    count = linked.groupBy("s").agg(F.sum("n").alias("n"))
    links = stored(whole.join(count, "s"), "linked")
    drop(linked)
    return class_rows(plan.members, plan.nodes.select("s", "rep", "mult"), links, id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns as they were, without near copies: of each
    class of linked documents the one with the least id stays.

    Rows with a null id stay, as do documents without words. Of rows that share
    one id the one with the least text stays (nulls first). An empty table
    stays empty.
    """
    n = fresh("n", docs)
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(id_col), "repeated")
    if again.limit(1).count():
        left = docs.join(again, id_col, "left_anti").select(*docs.columns)
        # the least text of an id is found by a partial aggregation, so a hot id is no one task
        by = F.struct(F.col(text_col).isNotNull().alias("known"), F.col(text_col).alias("text"))
        some = docs.join(again, id_col, "left_semi").groupBy(F.col(id_col).alias("id")).agg(F.min_by(F.struct(*docs.columns), by).alias("row")).select("row.*")
        docs = left.unionByName(some)
    found = jaccard_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col="id", text_col="text", **how)
    gone = stored(found.where("id <> class_id").select(F.col("id").alias(id_col)), "copies")
    return docs.join(sendable(gone), id_col, "left_anti").select(*docs.columns)
