"""Language-model scores from a probabilistic suffix tree over bytes.

All documents' bytes are counted, each with the ``depth`` bytes before it. A
context is a candidate where at least ``COUNT`` positions follow it, whatever
the corpus, so more text gives more contexts; of these the tree retains those
whose next-byte distribution diverges from that of their longest retained
suffix. Distributions are smoothed by their suffix's.

Contexts that end alike lie in one subtree. Those of up to ``HEAD`` bytes, 2 **
24 pairs of context and next byte at most, are grown on the driver; the longer
ones by shards of their last HEAD + 1 bytes, each a file of sorted arrays in the
shared folder that scoring maps into memory. ``grow`` and ``Tree`` hold a
small tree in one piece.

A context of ``LONG`` bytes is a candidate too, at every position, once two
positions follow it. It tells a passage that occurs twice from one that occurs
once, which no count of short contexts does. ``anchor`` above 1 looks only at
positions where the hash of the bytes before is 0 modulo it.

Long contexts are counted where those with the same minimizer lie: the least hash
among their runs of ``GRAM`` bytes. Most contexts share it with the one before, so
what travels is spans of text, about 5 bytes a position before they are compressed,
and what a span holds needn't be looked up or hashed before it has arrived.
"""

from __future__ import annotations

import gc
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_view, check_names, drop, lean, mix, scratch_path, stored

DEPTH = 5
DEEP = 6
COUNT = 4
HEAD = 2
LONG = 20
GRAM = 10
ANCHOR = 1
REPEATED = 2
DIVERGENCE = 0.01
SMOOTH = 4.0
_WINDOW = 256
_LANES = 4096
_HELD = 12_000_000
_SHARD = 1 << 20
_SLICE = 1 << 22
_SPREAD = 2654435761
_LONG_SHARD = 1 << 21
_STEP = 0x9E3779B97F4A7C15
#: Long contexts are counted in up to so many rounds, each of at least so many positions, so that
#: what is moved at a time is a share of the spans. Every round reads the texts again.
_ROUNDS = 3
_ROUND = 4 << 20
#: Bytes of text whose spans a task deals at once, and positions of a shard that it sorts at once.
_DEALT = 6 << 20
_PART = 4 << 20
#: Positions hashed at a time, so that what is reckoned with stays in a processor's cache.
_BLOCK = 1 << 14



def padded(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``depth`` zero bytes before each, and where each text's own bytes begin there."""
    texts, size = len(ends) - 1, np.diff(ends)
    out = np.zeros(len(data) + depth * texts, np.uint8)
    begin = ends[:-1] + depth * np.arange(1, texts + 1)
    out[np.arange(len(data)) + np.repeat(begin - ends[:-1], size)] = data
    return out, begin


def grams(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For every byte of every text the code of its ``depth`` predecessors and itself."""
    if not len(data):
        return np.zeros(0, np.uint64)
    full, begin = padded(data, ends, depth)
    code = np.zeros(len(full) - depth, np.uint64)
    for i in range(depth + 1):
        code <<= np.uint64(8)
        code |= full[i : len(full) - depth + i]
    own = np.repeat(begin - ends[:-1] - depth, np.diff(ends)) + np.arange(len(data))
    return code[own]


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    return c[first], np.add.reduceat(n, first) if len(c) else n


def gram_counts(docs: DataFrame, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """(code, n) over all documents: each task counts its own texts, a chunk at a time, and
    deals what it counted among buckets of codes, an array for each; these are added up."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def deal():
            c = np.concatenate(held)
            held.clear()
            c.sort()
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            n, c = np.diff(np.append(first, len(c))), c[first]
            mine = (mix(c) % np.uint64(buckets)).astype(np.int64)
            order = _by_shard(mine, buckets)
            cut = np.searchsorted(mine[order], np.arange(buckets + 1))
            c, n, rows = c[order], n[order], []
            for i in np.flatnonzero(np.diff(cut)):
                part = slice(cut[i], cut[i + 1])
                whole = np.diff(c[part], prepend=np.uint64(0)).astype("<u8").tobytes() + n[part].astype("<i8").tobytes()
                rows.append((i, cut[i + 1] - cut[i], pa.compress(whole, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "n", "counts"])

        for batch in bounded(batches, 4000):
            c = grams(*byte_view(batch.column(0)), depth)
            if size and size + len(c) > _HELD:  # what a task holds stays bounded
                yield from deal()
                size = 0
            held.append(c)
            size += len(c)
        if size:
            yield from deal()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts = -1, [], []

        def done():
            if codes:
                c, n = _merge(codes, counts)
                for at in range(0, len(c), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000].astype(np.int64)), pa.array(n[at : at + 200_000])], names=["code", "n"])

        for batch in batches:
            for bucket, n, x in zip(*(batch.column(j).to_pylist() for j in range(2)), batch.column(2)):
                if bucket != now:
                    yield from done()
                    now, codes, counts = bucket, [], []
                whole = pa.decompress(x.as_buffer(), 16 * n, "zstd")
                codes.append(np.cumsum(np.frombuffer(whole, "<u8", n), dtype=np.uint64))
                counts.append(np.frombuffer(whole, "<i8", n, 8 * n))
        yield from done()

    dealt = docs.where(F.length(text_col) > 0).select(text_col).mapInArrow(lean(collect), "bucket int, n long, counts binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(add), "code long, n long")


@dataclass
class Tree:
    """Retained contexts, each a byte string, with smoothed log probabilities by
    symbol; ``symbol`` maps a byte to a column, unseen ones to the last."""

    depth: int
    symbol: np.ndarray
    contexts: list[bytes]
    log_p: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log probability), both (states x symbols), flattened; state 0 is the empty context."""
        nodes: dict[bytes, int] = {b"": 0}
        for c in sorted(self.contexts, key=len):
            for n in range(1, len(c) + 1):
                nodes.setdefault(c[:n], len(nodes))
        kept = {c: i for i, c in enumerate(self.contexts)}
        K = self.log_p.shape[1]
        step = np.zeros((len(nodes), K), np.int32)
        fall = np.zeros(len(nodes), np.int64)
        emit = np.zeros(len(nodes), np.int64)
        emit[0] = kept[b""]
        order = sorted(nodes, key=len)
        children: dict[int, list[bytes]] = {}
        for u in order[1:]:
            children.setdefault(nodes[u[:-1]], []).append(u)
        for u in order:
            at = nodes[u]
            if u:
                # step[parent of u] was full when u's turn came, as shorter nodes go first
                fall[at] = nodes[u[1:]] if u[1:] in nodes else self._longest(u[1:], nodes)
                step[at] = step[fall[at]]
                emit[at] = kept[u] if u in kept else emit[fall[at]]
            for v in children.get(at, ()):
                step[at, self.symbol[v[-1]]] = nodes[v]
        return step.reshape(-1), self.log_p[emit].astype(np.float32).reshape(-1)

    @staticmethod
    def _longest(u: bytes, nodes: dict[bytes, int]) -> int:
        while u not in nodes:
            u = u[1:]
        return nodes[u]

    def score(self, data: np.ndarray, ends: np.ndarray, tables=None) -> np.ndarray:
        """Natural-log probability of every text."""
        step, log_p = tables or self.automaton()
        K, D = self.log_p.shape[1], self.depth
        full, begin = padded(data, ends, D)
        full = self.symbol[full].astype(np.int32)
        texts, size = len(ends) - 1, np.diff(ends)
        windows = -(-size // _WINDOW)
        owner = np.repeat(np.arange(texts), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[owner] + inside * _WINDOW
        length = np.minimum(_WINDOW, size[owner] - inside * _WINDOW)
        order = np.argsort(-length, kind="stable")
        total = np.zeros(texts)
        for lane in range(0, len(order), _LANES):
            mine = order[lane : lane + _LANES]
            p, n = at[mine], length[mine]
            state = np.zeros(len(mine), np.int32)
            for t in range(D):  # after as many bytes the state depends on nothing before them
                state = step[state * K + full[p - D + t]]
            gain = np.zeros(len(mine))
            active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
            for t in range(n[0]):
                m = active[t]
                cell = state[:m] * K + full[p[:m] + t]
                gain[:m] += log_p[cell]
                state[:m] = step[cell]
            np.add.at(total, owner[mine], gain)
        return total


def grow(rows: list[tuple[int, int, list[int], list[int]]], depth: int, divergence: float = DIVERGENCE, smooth: float = SMOOTH) -> Tree:
    """The tree of candidate contexts (length, code, next bytes, their counts)."""
    seen = sorted({s for k, _, syms, _ in rows if k == 0 for s in syms} | {0})
    symbol = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.int16)
    symbol[seen] = np.arange(len(seen))
    K = len(seen) + (len(seen) < 256)
    contexts, log_p, place = [b""], [], {b"": 0}
    base = np.full(K, 0.5)
    for k, _, syms, counts in rows:
        if k == 0:
            np.add.at(base, symbol[np.array(syms, np.int64)].astype(np.int64), np.array(counts, float))
    log_p.append(base / base.sum())
    for k, code, syms, counts in sorted(rows, key=lambda r: (r[0], r[1])):
        if k == 0:
            continue
        c = int(code).to_bytes(8, "big")[8 - k :]
        s = c[1:]
        while s not in place:
            s = s[1:]
        p = log_p[place[s]]
        n = np.zeros(K)
        np.add.at(n, symbol[np.array(syms, np.int64)].astype(np.int64), np.array(counts, float))
        own = n / n.sum()
        some = own > 0
        if (own[some] * np.log(own[some] / p[some])).sum() >= divergence:
            place[c] = len(contexts)
            contexts.append(c)
            log_p.append((n + smooth * p) / (n.sum() + smooth))
    return Tree(depth, symbol, contexts, np.log(np.array(log_p)))


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def deepen(codes: np.ndarray, counts: np.ndarray, k: int, below: tuple[np.ndarray, np.ndarray], least: float, divergence: float, smooth: float):
    """The contexts of ``k`` bytes from those of ``k - 1``.

    ``below`` has the pairs (context, next byte) of the shorter candidates and
    the log probability of each under its longest retained suffix or itself.
    Returns the grams that may go deeper, this length's ``below``, and of the
    retained contexts the pairs, their log probabilities and the log weight that
    the suffix's distribution has for bytes without a pair.
    """
    short = codes & _mask(k)
    at = np.minimum(np.searchsorted(below[0], short), max(0, len(below[0]) - 1))
    met = below[0][at] == short if len(below[0]) else np.zeros(len(codes), bool)
    codes, counts = codes[met], counts[met]
    if not len(codes):
        z = np.zeros(0)
        return (codes, counts), (codes, z), (codes, z, z)
    key, n = _merge([codes & _mask(k + 1)], [counts])
    context = key >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(np.append(first, len(key)))
    total = np.repeat(np.add.reduceat(n, first), size)
    q = below[1][np.searchsorted(below[0], key & _mask(k))]
    own = n / total
    kept = np.repeat(np.add.reduceat(own * (np.log(own) - q), first) >= divergence, size) & (total >= least)
    q = np.where(kept, np.log((n + smooth * np.exp(q)) / (total + smooth)), q)
    often = total >= least
    weight = np.log(smooth / (total + smooth))
    return (codes, counts), (key[often], q[often]), (key[kept], q[kept], weight[kept])


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    ending = (codes >> np.uint64(8)) & _mask(HEAD + 1)
    return ((ending * np.uint64(_SPREAD)) >> np.uint64(16)) % np.uint64(shards)


def _lookup(codes: np.ndarray, k: int, level: tuple[np.ndarray, np.ndarray, np.ndarray], out: np.ndarray, left: np.ndarray) -> np.ndarray:
    """From the longest contexts to the shorter: adds to ``out`` of the places ``left`` the log
    probability where the context of ``k`` bytes is retained with the pair, and its weight
    where it is retained without. Returns the places that shorter contexts have to tell."""
    key, q, weight = level
    if not len(key) or not len(left):
        return left
    asked = codes[left] & _mask(k + 1)
    here = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    found = key[here]
    met = found == asked
    out[left[met]] += q[here[met]]
    rest = np.flatnonzero(~met)
    left, here, context = left[rest], here[rest], asked[rest] >> np.uint64(8)
    # pairs of one context stand together, so a retained context has one beside the place of any other
    before = np.maximum(here, 1) - 1
    side = np.where((found[rest] >> np.uint64(8)) == context, here, before)
    retained = (key[side] >> np.uint64(8)) == context
    out[left[retained]] += weight[side[retained]]
    return left


def _own(data: np.ndarray, ends: np.ndarray, long: int) -> np.ndarray:
    """Of every place from ``long`` on, whether its text has as many bytes before it."""
    take = np.ones(len(data), bool)
    early = (ends[:-1, None] + np.arange(long)).reshape(-1)  # beyond a short text's end are the next one's first
    take[early[early < len(data)]] = False
    return take[long:]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a number."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))


def minimizers(data: np.ndarray, long: int) -> np.ndarray:
    """Of every place from ``long`` on the least 32-bit hash of the runs of ``GRAM`` bytes
    within the ``long`` bytes before it."""
    out = np.empty(len(data) - long, np.uint32)
    for lo in range(0, len(out), _BLOCK):
        out[lo : lo + _BLOCK] = _least(data[lo : lo + _BLOCK + long], long)
    return out


def _least(data: np.ndarray, long: int) -> np.ndarray:
    """``minimizers`` of one block."""
    size, k = len(data), min(GRAM, long)
    with np.errstate(over="ignore"):
        if k >= 8:
            words = _words(data)
            h = words[: size - k + 1] * np.uint64(_STEP)
            h += words[k - 8 :]
        else:
            h = np.zeros(size - k + 1, np.uint64)
            for i in range(k):
                h <<= np.uint64(8)
                h |= data[i : size - k + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    least, wide, seen = (h >> np.uint64(32)).astype(np.uint32), long - k + 1, 1
    while seen < wide:
        more = min(seen, wide - seen)
        least = np.minimum(least[:-more], least[more:])
        seen += more
    return least[: size - long]


def _spread(least: np.ndarray) -> np.ndarray:
    """The least of many hashes are small numbers; this deals them evenly over 32 bits."""
    u = least * np.uint32(_SPREAD)
    u ^= u >> np.uint32(15)
    u *= np.uint32(0x85EBCA6B)
    u ^= u >> np.uint32(13)
    return u


def _share(where: np.ndarray, shares: int) -> np.ndarray:
    """The number of the equal range of 32 bits that ``where`` lies in."""
    return (where.astype(np.uint64) * np.uint64(shares)) >> np.uint64(32)


def _keys(data: np.ndarray, at: np.ndarray, long: int) -> np.ndarray:
    """56 bits of the hash of the ``long`` bytes before each place, and the byte there."""
    out, width = np.empty(len(at), np.uint64), min(8, long)
    words = _words(data) if width == 8 and len(data) > 7 else data
    with np.errstate(over="ignore"):
        for lo in range(0, len(at), _BLOCK):
            own = at[lo : lo + _BLOCK] - long
            h = np.zeros(len(own), np.uint64)
            for i in [*range(0, long - width, width), long - width] if width == 8 else range(long):  # the last may overlap the one before
                h = (h + words[own + i] + np.uint64(1)) * np.uint64(_STEP)
                h ^= h >> np.uint64(29)
            out[lo : lo + _BLOCK] = mix(h) & ~np.uint64(255)
    out |= data[at]
    return out


def _places(data: np.ndarray, ends: np.ndarray, codes: np.ndarray | None, long: int, anchor: int) -> np.ndarray:
    """The places with ``long`` bytes before them in their text whose preceding bytes hash to
    0 modulo ``anchor``. ``codes`` may be None for anchor 1."""
    if not long or len(data) <= long:
        return np.zeros(0, np.int64)
    n = np.maximum(np.diff(ends) - long, 0)
    at = np.repeat(ends[:-1] + long - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return at[mix(codes[at] >> np.uint64(8)) % np.uint64(anchor) == 0] if anchor > 1 else at


def anchors(data: np.ndarray, ends: np.ndarray, codes: np.ndarray | None, long: int, anchor: int, rounds: int = 1, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, where) of the positions that may have a long context. ``where`` is a
    number of 32 bits that the context's minimizer gives and that shards and rounds have
    ranges of; ``only`` gives the positions of one round."""
    at = _places(data, ends, codes, long, anchor)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    where = _spread(minimizers(data, long)[at - long])
    if only is not None:
        mine = _share(where, rounds) == only
        at, where = at[mine], where[mine]
    return at, _keys(data, at, long), where


def spans(data: np.ndarray, ends: np.ndarray, long: int, rounds: int = 1, only: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, where) of the longest stretches of text in which all positions' long
    contexts have one minimizer, of those in one round; with the ``long`` bytes before them."""
    if len(data) <= long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    take, least = _own(data, ends, long), minimizers(data, long)
    change = np.ones(len(take) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (take[1:] != take[:-1])
    edge = np.flatnonzero(change)
    start, length = edge[:-1], np.diff(edge)
    where = _spread(least[start])
    mine = take[start] & (_share(where, rounds) == only)
    return start[mine], length[mine] + long, where[mine]


def _grams_at(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``grams`` of some places with ``depth`` bytes before them."""
    code = np.zeros(len(at), np.uint64)
    for i in range(depth, -1, -1):
        code = (code << np.uint64(8)) | data[at - i]
    return code


def _by_shard(mine: np.ndarray, shards: int) -> np.ndarray:
    """The order that brings the places of each shard together; numpy sorts 16 bits by counting."""
    return np.argsort(mine.astype(np.uint16) if shards <= 1 << 16 else mine, kind="stable")


def _clear(spark) -> None:
    """Let Spark delete what earlier exchanges wrote, when nothing refers to them any more."""
    for _ in range(2):  # it deletes on a thread of its own, some time after
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _write(folder: str, name: str, parts: list[np.ndarray]) -> None:
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(path)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for p in parts:
            f.write(p.tobytes())
    fs.move(part, f"{path}/{name}")  # a repeated task writes the same


def _read(folder: str, name: str):
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    file = f"{path}/{name}"
    with pa.memory_map(file) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(file) as f:
        return f.read_buffer()


def _kind_of(kinds: int) -> str:
    return "<u2" if kinds <= 1 << 16 else "<u4"


def _level(whole, n: int, at: int = 0) -> tuple[np.ndarray, ...]:
    """Keys, log probabilities and weights of ``n`` pairs at a place of a file."""
    return tuple(np.frombuffer(whole, kind, n, at + skip * n) for kind, skip in (("<u8", 0), ("<f4", 8), ("<f4", 12))) if n else tuple(np.zeros(0, kind) for kind in ("<u8", "<f4", "<f4"))


@dataclass
class ShardedTree:
    """``root``: log probability by byte. ``head``: by length, pairs (context,
    next byte) of retained contexts, log probabilities, weights. ``files``: by
    shard, the number of pairs of every longer length; ``retained``: contexts by length."""

    depth: int
    root: np.ndarray
    head: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    folder: str
    shards: int
    files: dict[int, list[int]]
    retained: list[int]
    long: int = 0
    anchor: int = ANCHOR
    long_shards: int = 1
    long_rounds: int = 1
    long_files: dict[int, tuple[int, int]] = field(default_factory=dict)
    smooth: float = SMOOTH
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def shard(self, i: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        whole = _read(self.folder, str(i))
        out, at = [], 0
        for n in self.files[i]:
            out.append(_level(whole, n, at))
            at += 16 * n
        return out

    @property
    def contexts(self) -> list[bytes]:
        """All retained contexts; for small trees."""
        levels = [(k, level) for k, level in enumerate(self.head, 1)]
        levels += [(k, level) for i in self.files for k, level in enumerate(self.shard(i), HEAD + 1)]
        return [b""] + [int(c).to_bytes(8, "big")[8 - k :] for k, (key, _, _) in levels for c in np.unique(key >> np.uint64(8))]

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte after its others."""
        out, rest = np.zeros(len(codes)), []
        if self.files:
            mine = shard_of(codes, self.shards).astype(np.int64)
            order = _by_shard(mine, self.shards)
            cut = np.searchsorted(mine[order], np.arange(self.shards + 1))
            for i in range(self.shards):
                left = order[cut[i] : cut[i + 1]]
                if len(left) and i in self.files:
                    for k, level in reversed([*enumerate(self.shard(i), HEAD + 1)]):
                        left = _lookup(codes, k, level, out, left)
                rest.append(left)
        left = np.concatenate(rest) if rest else np.arange(len(codes))
        for k, level in reversed([*enumerate(self.head, 1)]):
            left = _lookup(codes, k, level, out, left)
        out[left] += self.root[(codes[left] & np.uint64(255)).astype(np.int64)]
        return out

    def _each_log_p(self, codes: np.ndarray) -> np.ndarray:
        """``log_p`` where codes repeat: a sort of plain numbers, a hash's first bits with the
        place, brings like ones together (one that is parted by another of these bits is looked up twice)."""
        places = max(1, len(codes).bit_length())
        low = np.uint64((1 << places) - 1)
        with np.errstate(over="ignore"):
            packed = codes * np.uint64(_STEP)
        packed &= ~low
        packed |= np.arange(len(codes), dtype=np.uint64)
        packed.sort()
        packed &= low
        order = packed.astype(np.int64)
        alike = codes[order]
        first = np.flatnonzero(np.append(True, alike[1:] != alike[:-1]))
        one = alike[first]
        rank = np.argsort(one)
        p = np.empty(len(one))
        p[rank] = self.log_p(one[rank])
        out = np.empty(len(codes))
        out[order] = np.repeat(p, np.diff(np.append(first, len(codes))))
        return out

    def long_shard(self, where: np.ndarray) -> np.ndarray:
        return _share(where, self.long_shards).astype(np.int64)

    def long_log_p(self, keys: np.ndarray, where: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability, whether the context is retained) of anchored positions,
        from the log probabilities that the shorter contexts give."""
        out, known = log_p.copy(), np.zeros(len(keys), bool)
        # one sort of plain numbers, of the shard, the key's first bits and the place: shards stand
        # together, and what is searched for in one comes nearly in order
        bits, places = max(1, (self.long_shards - 1).bit_length()), max(1, len(keys).bit_length())
        low = np.uint64((1 << places) - 1)
        packed = (keys >> np.uint64(bits)) & ~low
        packed |= self.long_shard(where).astype(np.uint64) << np.uint64(64 - bits)
        packed |= np.arange(len(keys), dtype=np.uint64)
        packed.sort()
        cut = np.searchsorted(packed >> np.uint64(64 - bits), np.arange(self.long_shards + 1, dtype=np.uint64))
        order = (packed & low).astype(np.int64)
        for i, (n, kinds) in self.long_files.items():
            at = order[cut[i] : cut[i + 1]]
            if not len(at):
                continue
            whole = _read(self.folder, f"long-{i}")
            key, counts, totals = (np.frombuffer(whole, kind, size, skip) for kind, size, skip in (("<u8", n, 0), ("<i8", kinds, 8 * n), ("<i8", kinds, 8 * (n + kinds))))
            which = np.frombuffer(whole, _kind_of(kinds), n, 8 * (n + 2 * kinds))
            asked = keys[at]
            here = np.searchsorted(key, asked)
            left, right = np.maximum(here, 1) - 1, np.minimum(here, n - 1)
            found = key[right]
            same = (found >> np.uint64(8)) == (asked >> np.uint64(8))
            held = np.flatnonzero(same | ((key[left] >> np.uint64(8)) == (asked >> np.uint64(8))))
            side = which[np.where(same, right, left)[held]]
            count = np.where((found == asked)[held], counts[side], 0)
            at = at[held]
            known[at] = True
            out[at] = np.log((count + self.smooth * np.exp(log_p[at])) / (totals[side] + self.smooth))
        return out, known

    def score(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text its natural-log probability, how many positions may have a long
        context, and how many of these contexts are retained."""
        codes = grams(data, ends, self.depth)
        each = np.empty(len(codes))
        for lo in range(0, len(codes), _SLICE):
            each[lo : lo + _SLICE] = self._each_log_p(codes[lo : lo + _SLICE])
        at, keys, where = anchors(data, ends, codes, self.long, self.anchor)
        each[at], met = self.long_log_p(keys, where, each[at])
        asked, known = (np.zeros(len(codes), np.int8) for _ in range(2))
        asked[at] = 1
        known[at] = met
        some = np.diff(ends) > 0
        out = np.zeros((3, len(some)))
        for k, x in enumerate((each, asked, known)):
            out[k, some] = np.add.reduceat(x, ends[:-1][some], dtype=np.float64)
        return tuple(out)


def fit(docs: DataFrame, depth: int = DEPTH, least: float = COUNT, divergence: float = DIVERGENCE, smooth: float = SMOOTH, long: int = LONG, anchor: int = ANCHOR, text_col: str = "text") -> ShardedTree:
    """Count all documents and grow the tree. ``least`` is the number of positions
    that must follow a context, below 1 their share of all. Null and empty texts add
    nothing; a table without text gives the tree of the empty context alone. ``long``
    0 leaves out the long contexts, which are counted in a second pass."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must lie between 1 and 7")
    if long and long < depth:
        raise ValueError("long contexts can't be shorter than depth")
    spark = docs.sparkSession
    counted = stored(gram_counts(docs, depth, text_col), "grams")
    rows, total = counted.agg(F.count(F.lit(1)), F.sum("n")).collect()[0]
    least = least if least >= 1 else least * (total or 0)
    short = counted.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (HEAD + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, counts = short["code"].to_numpy().astype(np.uint64), short["n"].to_numpy().astype(np.int64)
    base = np.bincount((codes & np.uint64(255)).astype(np.int64), counts, 256)
    unseen = base == 0
    unseen[0] = False
    root = np.log((base + 0.5) / (base[~unseen].sum() + 0.5 * (np.sum(~unseen) + unseen.any())))
    below, head = (np.arange(256, dtype=np.uint64), root), []
    for k in range(1, min(HEAD, depth) + 1):
        (codes, counts), below, level = deepen(codes, counts, k, below, least, divergence, smooth)
        head.append(level)
    shards = max(1, math.ceil(rows / _SHARD))
    folder = scratch_path(spark, "tree")
    files: dict[int, list[int]] = {}
    retained = [1, *[len(np.unique(key >> np.uint64(8))) for key, _, _ in head], *[0] * (depth - len(head))]
    if depth > HEAD and rows:
        for i, pairs, contexts in _grow_shards(counted, depth, below, least, divergence, smooth, shards, folder):
            files[i] = pairs
            for k, n in enumerate(contexts, HEAD + 1):
                retained[k] += n
    drop(counted)
    tree = ShardedTree(depth, root, head, folder, shards, files, retained)
    if long and rows:
        _grow_long(docs, tree, total, long, anchor, divergence, smooth, text_col)
    return tree


def _grow_long(docs: DataFrame, tree: ShardedTree, total: int, long: int, anchor: int, divergence: float, smooth: float, text_col: str) -> None:
    """Count the long contexts of all documents, keep those that repeat and diverge from
    what the tree says without them, and write them as files of their own."""
    rounds = max(1, min(_ROUNDS, total // anchor // _ROUND))
    shards = rounds * max(1, math.ceil(total / anchor / _LONG_SHARD / rounds))
    each = shards // rounds
    tree.long, tree.anchor, tree.long_shards, tree.long_rounds, tree.smooth = long, anchor, shards, rounds, smooth
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tree)

    def collect(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        t, held, size = sent.value, [], 0

        def deal():
            base = np.cumsum([0, *(len(x) for x, *_ in held)])
            data, start = np.concatenate([x for x, *_ in held]), np.concatenate([x + b for (_, x, _, _), b in zip(held, base)])
            length, where = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            order = np.argsort(where)  # so spans of one minimizer stand together, and shards too
            start, length, mine = start[order], length[order], t.long_shard(where[order])
            end = np.cumsum(length)
            text = np.repeat(start - (end - length), length)
            text += np.arange(len(text))
            text = data[text]
            cut = [*np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])), len(mine)]
            rows = []
            for a, b in zip(cut, cut[1:]):
                whole = length[a:b].astype("<u4").tobytes() + text[end[a] - length[a] : end[b - 1]].tobytes()
                rows.append((mine[a], b - a, len(whole), pa.compress(whole, "zstd", asbytes=True)))
            # one row a shard, not one a position: what travels is text
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "n", "size", "spans"])

        for batch in bounded(batches, 4000, 1 << 20):
            data, ends = byte_view(batch.column(0))
            found = spans(data, ends, long, rounds, turn)
            if len(found[0]):
                held.append((data, *found))
                size += len(data)
            if size >= _DEALT:
                yield from deal()
                held, size = [], 0
        if held:
            yield from deal()

    def kept(data: np.ndarray, ends: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, counts, totals) of the retained contexts' pairs, of one range of keys."""
        t, keys, at = sent.value, [], []
        steps = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], _PART)), len(ends) - 1))
        for a, b in zip(steps, steps[1:]):
            some, cut = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            p = _places(some, cut, grams(some, cut, t.depth) if anchor > 1 else None, long, anchor)
            k = _keys(some, p, long)
            if parts > 1:
                mine = _share(k >> np.uint64(32), parts) == part
                p, k = p[mine], k[mine]
            keys.append(k)
            at.append(p + ends[a])
        keys, at = np.concatenate(keys), np.concatenate(at)
        # a sort of plain numbers, a key's first bits with its place, leaves out most contexts that
        # occur once; of the others whole keys are compared
        places = np.uint64(max(8, len(keys).bit_length()))
        low = (np.uint64(1) << places) - np.uint64(1)
        packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
        packed.sort()
        near = (packed[1:] >> places) == (packed[:-1] >> places)
        again = np.flatnonzero(np.append(near, False) | np.append(False, near)) if len(keys) else np.zeros(0, np.int64)
        again = (packed[again] & low).astype(np.int64)
        again = again[np.argsort(keys[again], kind="stable")]
        key, at = keys[again], at[again]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else again
        n, key, at = np.diff(np.append(first, len(key))), key[first], at[first]
        if not len(key):
            return key, n, n
        context = key >> np.uint64(8)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size = np.diff(np.append(begin, len(key)))
        sums = np.repeat(np.add.reduceat(n, begin), size)
        own = n / sums
        c, back = np.unique(_grams_at(data, at, t.depth), return_inverse=True)
        q = t.log_p(c)[back]
        stay = (sums >= REPEATED) & (np.repeat(np.add.reduceat(own * (np.log(own) - q), begin), size) >= divergence)
        return key[stay], n[stay], sums[stay]

    def written(i: int, data: np.ndarray, length: np.ndarray) -> tuple[int, int]:
        ends = np.append(0, np.cumsum(length, dtype=np.int64))
        parts = max(1, math.ceil((len(data) - long * len(length)) / _PART))
        key, n, sums = (np.concatenate(x) for x in zip(*(kept(data, ends, part, parts) for part in range(parts))))
        # few different counts and totals, as they add up to the shard's positions: a pair has the number of its own
        kinds, which = np.unique(sums << 32 | n, return_inverse=True)
        if len(key):
            _write(folder, f"long-{i}", [key.astype("<u8"), (kinds & 0xFFFFFFFF).astype("<i8"), (kinds >> 32).astype("<i8"), which.astype(_kind_of(len(kinds)))])
        return len(key), len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def done():
            if held:
                whole = [(n, pa.decompress(x, size, "zstd")) for n, size, x in held]
                n = written(now, np.concatenate([np.frombuffer(x, np.uint8, offset=4 * n) for n, x in whole]), np.concatenate([np.frombuffer(x, "<u4", n) for n, x in whole]))
                if n[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.int64()) for x in n)], names=["shard", "n", "kinds"])

        for batch in batches:
            for shard, n, size, x in zip(*(batch.column(j).to_pylist() for j in range(3)), batch.column(3)):
                if shard != now:
                    yield from done()
                    now, held = shard, []
                held.append((n, size, x.as_buffer()))
        yield from done()

    folder = tree.folder

    def one_round(turn: int) -> list:
        dealt = docs.where(F.length(text_col) > 0).select(text_col).mapInArrow(lean(lambda batches: collect(batches, turn)), "shard int, n long, size long, spans binary")
        return dealt.repartition(each, "shard").sortWithinPartitions("shard").mapInArrow(lean(run), "shard int, n long, kinds long").collect()

    found = []
    for turn in range(rounds):
        if rounds > 1:
            _clear(spark)
        found += one_round(turn)
    tree.long_files = {r["shard"]: (r["n"], r["kinds"]) for r in found}


def _grow_shards(counted: DataFrame, depth: int, head, least: float, divergence: float, smooth: float, shards: int, folder: str) -> list:
    """Write every shard's file; (shard, pairs by length, contexts by length) of those with contexts."""
    sent = counted.sparkSession.sparkContext.broadcast(head)

    def written(i: int, codes: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
        below, levels = sent.value, []
        for k in range(HEAD + 1, depth + 1):
            (codes, counts), below, level = deepen(codes, counts, k, below, least, divergence, smooth)
            levels.append(level)
        sizes = [len(key) for key, _, _ in levels]
        if any(sizes):
            _write(folder, str(i), [x.astype(kind) for level in levels for x, kind in zip(level, ("<u8", "<f4", "<f4"))])
        return sizes, [len(np.unique(key >> np.uint64(8))) for key, _, _ in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts = -1, [], []

        def done():
            if codes:
                sizes, contexts = written(now, np.concatenate(codes), np.concatenate(counts))
                if any(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([contexts], pa.list_(pa.int64()))], names=["shard", "pairs", "contexts"])

        for batch in batches:
            shard, code, n = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            cut = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cut, cut[1:]):
                if b > a and shard[a] != now:
                    yield from done()
                    now, codes, counts = int(shard[a]), [], []
                codes.append(code[a:b].astype(np.uint64))
                counts.append(n[a:b].astype(np.int64))
        yield from done()

    ending = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * (HEAD + 1)) - 1))
    shard = F.pmod(F.shiftright(ending * F.lit(_SPREAD), 16), F.lit(shards)).cast("int")
    dealt = counted.select(shard.alias("shard"), "code", "n").repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, pairs array<long>, contexts array<long>").collect()


def score(docs: DataFrame, tree: ShardedTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte, known_share), a row for a row.

    ``log_prob`` is the natural logarithm of the text's probability under the
    tree. ``known_share`` is the share of the positions that may have a long
    context whose context the tree retains: near 1 for a text that the corpus
    holds twice. A null text has nulls; an empty one 0 bytes, log probability 0
    and null bits; a text too short for long contexts a null share. Whole texts
    are scored, whatever their length; repeated rows and null ids as they come;
    other columns are not carried; an empty table gives none.
    """
    check_names(id_col, "n_bytes", "log_prob", "bits_per_byte", "known_share")
    # the head and the names of the files; the shards stay where they are
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in bounded(batches, 8000, 4 << 20):
            data, ends = byte_view(batch.column(1))
            null = np.array(batch.column(1).is_null())
            size = np.diff(ends)
            log_prob, asked, known = t.score(data, ends) if len(data) else np.zeros((3, len(size)))
            bits = -log_prob / np.log(2) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int32), mask=null), pa.array(log_prob, mask=null), pa.array(bits, mask=size == 0), pa.array(known / np.maximum(asked, 1), mask=asked == 0)],
                names=["id", "n_bytes", "log_prob", "bits_per_byte", "known_share"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes int, log_prob double, bits_per_byte double, known_share double").withColumnRenamed("id", id_col)
