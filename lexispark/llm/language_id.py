"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows of ``WINDOW`` positions, once
forwards and once backwards. Each direction is a minimal gated unit

    f = gate(Wf[byte] + Uf h),  c = squash(Wc[byte] + Uc (f * h)),  h = h + f * (c - h)

with squash(x) = x / (1 + |x|) and gate(x) = (1 + squash(x)) / 2, and a linear
layer over both directions' states gives a label for every byte. A document's
probabilities are the mean of its positions' probabilities. Training is
backpropagation through time in numpy on the driver, over a bounded sample of
labelled documents; scoring runs over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_view, check_names, sampled

WINDOW = 256
_LANES = 4096


@dataclass
class Network:
    """Weights: for each direction an input table (2H x 256) and two recurrent
    matrices; the output layer is (labels x 2H) with a bias."""

    labels: list[str]
    tables: list[np.ndarray]
    gates: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.states[0].shape[0]


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def train(texts: list[bytes], answers: list[int], labels: list[str], hidden: int = 8, steps: int = 220, lanes: int = 192, span: int = 80, rate: float = 0.02, seed: int = 3) -> Network:
    """Fit the network on random stretches of ``span`` bytes, the labels drawn evenly."""
    rng = np.random.default_rng(seed)
    kinds, H = len(labels), hidden
    f4 = np.float32
    par = []
    for _ in range(2):
        par += [rng.normal(0, 0.5, (2 * H, 256)).astype(f4), rng.normal(0, 0.3, (H, H)).astype(f4), rng.normal(0, 0.3, (H, H)).astype(f4)]
    par += [rng.normal(0, 0.3, (kinds, 2 * H)).astype(f4), np.zeros((kinds, 1), f4)]
    first, second = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    of = [[i for i, a in enumerate(answers) if a == k and len(texts[i])] for k in range(kinds)]
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    for step in range(1, steps + 1):
        kind = rng.integers(kinds, size=lanes)
        x = np.full((span, lanes), 32, np.int64)
        for j, k in enumerate(kind):
            a = arrays[of[k][rng.integers(len(of[k]))]]
            at = rng.integers(max(1, len(a) - span + 1))
            part = a[at : at + span]
            x[: len(part), j] = part
        kept, grads = [], [np.zeros_like(p) for p in par]
        both = np.empty((span, 2 * H, lanes), f4)
        for d in range(2):
            table, gate, state = par[3 * d : 3 * d + 3]
            h = np.zeros((H, lanes), f4)
            trail = []
            for t in range(span) if d == 0 else range(span - 1, -1, -1):
                e = table[:, x[t]]
                a = e[:H] + gate @ h
                f = 0.5 * (1 + _squash(a))
                b = e[H:] + state @ (f * h)
                c = _squash(b)
                trail.append((t, h, a, f, b, c))
                h = h + f * (c - h)
                both[t, d * H : d * H + H] = h
            kept.append(trail)
        z = np.einsum("lk,tkb->tlb", par[6], both, optimize=True) + par[7]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, kind, np.arange(lanes)] -= 1
        p /= span * lanes
        grads[6] = np.einsum("tlb,tkb->lk", p, both, optimize=True)
        grads[7] = p.sum((0, 2))[:, None]
        back = np.einsum("lk,tlb->tkb", par[6], p, optimize=True)
        for d in range(2):
            _, gate, state = par[3 * d : 3 * d + 3]
            dh = np.zeros((H, lanes), f4)
            into = np.zeros((span, 2 * H, lanes), f4)
            for t, h, a, f, b, c in reversed(kept[d]):
                dh = dh + back[t, d * H : d * H + H]
                db = dh * f / (1 + np.abs(b)) ** 2
                through = state.T @ db
                df = dh * (c - h) + through * h
                da = df * 0.5 / (1 + np.abs(a)) ** 2
                grads[3 * d + 1] += da @ h.T
                grads[3 * d + 2] += db @ (f * h).T
                into[t, :H], into[t, H:] = da, db
                dh = dh * (1 - f) + through * f + gate.T @ da
            flat = into.transpose(0, 2, 1).reshape(-1, 2 * H)
            where = x.reshape(-1)
            for j in range(2 * H):
                grads[3 * d][j] = np.bincount(where, flat[:, j], 256)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p_, g, m, v in zip(par, grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(f4)
    return Network(labels, [par[0], par[3]], [par[1], par[4]], [par[2], par[5]], par[6], par[7])


def _window_run(net: Network, x: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (positions x windows) and summed probabilities (labels x windows).

    ``x`` holds bytes, a window a column, longest first; ``active[t]`` windows
    reach position t.
    """
    W, B = x.shape
    H, kinds = net.hidden, len(net.labels)
    f4 = np.float32
    ahead = np.empty((W, H, B), f4)
    total = np.zeros((kinds, B), f4)
    marks = np.zeros((W, B), _kind(kinds))
    e, a, u, fh = (np.empty((n, B), f4) for n in (2 * H, H, H, H))
    for d in (0, 1):
        table, gate, state = net.tables[d], net.gates[d], net.states[d]
        hs = np.zeros((H, B), f4)
        half = None
        if d:
            half = net.out[:, :H], net.out[:, H:]
        for t in range(W) if d == 0 else range(W - 1, -1, -1):
            n = active[t]
            if n == 0:
                continue
            if n == B:
                E, A, U, FH, h = e, a, u, fh, hs
            else:
                E, A, U, FH, h = e[:, :n], a[:, :n], u[:, :n], fh[:, :n], hs[:, :n]
            if n == B:
                np.take(table, x[t], axis=1, out=E, mode="clip")
                np.matmul(gate, h, out=A)
            else:
                E[...] = table[:, x[t, :n]]
                A[...] = gate @ h
            A += E[:H]
            np.abs(A, out=U)
            U += 1
            A /= U
            A += 1
            A *= 0.5
            np.multiply(A, h, out=FH)
            if n == B:
                np.matmul(state, FH, out=U)
            else:
                U[...] = state @ FH
            U += E[H:]
            np.abs(U, out=FH)
            FH += 1
            U /= FH
            U -= h
            U *= A
            h += U
            if d == 0:
                ahead[t, :, :n] = h
            else:
                z = half[0] @ ahead[t, :, :n]
                z += half[1] @ h
                z += net.bias
                marks[t, :n] = _argmax(z)
                np.exp(z, out=z)
                z /= z.sum(0)
                total[:, :n] += z
    return marks, total


def _kind(labels: int) -> type:
    return np.uint8 if labels <= 256 else np.int32


def _argmax(z: np.ndarray) -> np.ndarray:
    best, at = z[0].copy(), np.zeros(z.shape[1], _kind(len(z)))
    for k in range(1, len(z)):
        np.copyto(at, k, where=z[k] > best)
        np.maximum(best, z[k], out=best)
    return at


def label_bytes(net: Network, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: a label for every byte, and the texts' pooled
    probabilities (texts x labels; zeros for an empty text)."""
    texts = len(ends) - 1
    labels = np.zeros(len(data), _kind(len(net.labels)))
    pooled = np.zeros((texts, len(net.labels)), np.float64)
    size = np.diff(ends)
    if len(net.labels) < 2:  # nothing to tell apart
        pooled[size > 0] = 1
        return labels, pooled
    windows = -(-size // WINDOW)
    owner = np.repeat(np.arange(texts), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = ends[owner] + inside * WINDOW
    length = np.minimum(WINDOW, ends[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    steps = np.arange(WINDOW)
    for at in range(0, len(order), _LANES):
        mine = order[at : at + _LANES]
        n = length[mine]
        where = start[mine][None, :] + steps[: n[0], None]
        x = np.take(data, where, mode="clip").astype(np.intp)
        active = len(n) - np.searchsorted(n[::-1], steps[: n[0]], side="right")
        marks, total = _window_run(net, x, active)
        inside_ = steps[: n[0], None] < n[None, :]
        if inside_.all():
            labels[where] = marks
        else:
            labels[where[inside_]] = marks[inside_]
        np.add.at(pooled, owner[mine], total.T)
    pooled[size > 0] /= size[size > 0, None]
    return labels, pooled


def fit(docs: DataFrame, per_label: int = 120, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id", **how) -> Network:
    """Train on at most ``per_label`` documents of each label.

    Which ones is decided by a hash of key and text, so the same table gives the
    same network. Rows with a null label, key or text, or an empty text, are not
    used. With one label, or none, there is nothing to learn: the network then
    gives that label to every text, or none.
    """
    known = docs.select(F.col(key_col).alias("k"), F.col(label_col).alias("l"), F.col(text_col).alias("t")).where("k is not null and l is not null and length(t) > 0")
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if len(labels) < 2:
        return Network(labels, [], [], [], np.zeros((len(labels), 0)), np.zeros((len(labels), 1)))
    parts = [sampled(known.where(F.col("l") == l), per_label, counts[l], "k", "t") for l in labels]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    rows = sorted((tuple(r) for r in chosen.collect()), key=lambda r: (str(r[0]), r[2]))
    missing = set(labels) - {r[1] for r in rows}
    if missing:
        raise ValueError(f"no document was sampled for {sorted(missing)}")
    return train([r[2].encode() for r in rows], [labels.index(r[1]) for r in rows], labels, **how)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, lang, confidence, probabilities, n_bytes, spans), a row for a row.

    ``lang`` has the greatest pooled probability (of equal ones the first
    label), ``confidence`` is that probability, ``probabilities`` follow
    ``net.labels``. ``spans`` are the runs of equal labels over the text's
    bytes: every byte lies in one. A null or empty text has a null language,
    confidence 0 and no spans. Repeated rows, null ids and ties are kept as they
    come; other columns are not carried; an empty table gives an empty result.
    """
    check_names(id_col, "lang", "confidence", "probabilities", "n_bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(net.labels, pa.string())
        for batch in bounded(batches, 8000, 8 << 20):
            data, ends = byte_view(batch.column(1))
            labels, pooled = label_bytes(net, data, ends)
            size = np.diff(ends)
            best = pooled.argmax(1) if net.labels else np.zeros(len(size), np.int64)
            empty = (size == 0) | (not net.labels)
            cut = np.zeros(len(data) + 1, bool)
            if len(data) and net.labels:
                cut[1:-1] = labels[1:] != labels[:-1]
                cut[ends[:-1][size > 0]] = True
            at = np.flatnonzero(cut[:-1])
            stop = np.append(at[1:], len(data)) if len(at) else at
            of = np.searchsorted(ends, at, side="right") - 1
            runs = pa.StructArray.from_arrays(
                [pa.array((at - ends[of]).astype(np.int32)), pa.array((stop - ends[of]).astype(np.int32)), names.take(pa.array(labels[at].astype(np.int32)))],
                names=["start", "end", "lang"],
            )
            offsets = np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)
            columns = [
                batch.column(0),
                names.take(pa.array(best.astype(np.int32), mask=empty)),
                pa.array(pooled.max(1, initial=0)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * pooled.shape[1]), pa.array(pooled.reshape(-1))),
                pa.array(size.astype(np.int32)),
            ]
            if spans:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), runs))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "confidence", "probabilities", "n_bytes", "spans"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    form = f"id {kind}, lang string, confidence double, probabilities array<double>, n_bytes int" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(id_col, text_col).mapInArrow(run, form).withColumnRenamed("id", id_col)


def least_probability(labels: int) -> float:
    if labels < 2:
        return 0.0
    return 1 / labels + 0.2 * (1 - 1 / labels)


def keep_identified(docs: DataFrame, net: Network, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text the network
    places in some language with a pooled probability of at least ``least``: if
    not given, a fifth of the way from chance to certainty, 0.4 with four labels.

    Null and empty texts go. Where the network knows fewer than two languages
    there is nothing to choose from, and every other text stays. Rows are judged
    one by one, so repeated rows stay or go together, and a null id changes
    nothing. An empty table stays empty.
    """
    fields = docs.schema
    least = least_probability(len(net.labels)) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.names.index(text_col)
        for batch in bounded(batches, 8000, 8 << 20):
            data, ends = byte_view(batch.column(at))
            _, pooled = label_bytes(net, data, ends)
            yield batch.filter(pa.array((pooled.max(1, initial=0) >= least) & (np.diff(ends) > 0)))

    return docs.mapInArrow(run, fields)
