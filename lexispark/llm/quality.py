"""Document quality by a generalised additive model with pairwise interactions.

Features are counted over a document's whole text. Each is cut into bins at
training quantiles; cyclic boosting visits the features in turn and adds a
shallow tree over one feature's bins to that feature's table, then does the
same for the strongest pairs on a coarse grid. A document's score is the sum
of the table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_view, check_names, mix, sampled, words_of

FEATURES = (
    "log_bytes",
    "word_bytes",
    "capital_share",
    "digit_share",
    "stop_share",
    "symbol_share",
    "bar_share",
    "beyond_ascii_share",
    "line_words",
    "repeated_word_share",
    "repeated_line_share",
    "repeated_run_share",
)
# byte classes: small letter, capital, digit, white space, sentence mark, other mark, bar, beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[ord("|")] = 6
_CLASS[128:] = 7


def _repeats(of: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """For each text, how many of its hashes occurred in it before."""
    order = np.lexsort((h, of))
    o, k = of[order], h[order]
    again = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    return np.bincount(o[1:][again], minlength=texts).astype(float)


def features_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features (texts x FEATURES) of texts laid end to end; zeros for an empty text."""
    texts, size = len(ends) - 1, np.diff(ends)
    owner = np.repeat(np.arange(texts, dtype=np.int64), size)
    counts = np.bincount(owner * 8 + _CLASS[data], minlength=texts * 8).reshape(texts, 8).astype(float)
    h, start, end, before = words_of(data, ends)
    words = np.diff(before).astype(float)
    of = np.repeat(np.arange(texts), np.diff(before))
    short = np.bincount(of, weights=(end - start) <= 3, minlength=texts)
    # lines: the words between two line breaks, hashed together
    breaks = np.flatnonzero(data == 10)
    line_of_word = np.searchsorted(breaks, start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (line_of_word[1:] != line_of_word[:-1]) | (of[1:] != of[:-1])
    lines_at = np.flatnonzero(fresh)
    with np.errstate(over="ignore"):
        weight = mix(np.arange(len(h), dtype=np.uint64) - np.repeat(lines_at, np.diff(np.append(lines_at, len(h)))).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        line_hash = np.add.reduceat(h * weight, lines_at) if len(lines_at) else np.zeros(0, np.uint64)
        runs = h[:-2] + mix(h[1:-1]) * np.uint64(3) + mix(h[2:]) * np.uint64(7) if len(h) > 2 else np.zeros(0, np.uint64)
    line_of = of[lines_at]
    lines = np.bincount(line_of, minlength=texts).astype(float)
    same = of[:-2] == of[2:] if len(h) > 2 else np.zeros(0, bool)
    some, w, ln = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log1p(size),
            (size - counts[:, 3]) / w,
            counts[:, 1] / some,
            counts[:, 2] / some,
            short / w,
            counts[:, 5] / some,
            counts[:, 6] / some,
            counts[:, 7] / some,
            words / ln,
            _repeats(of, h, texts) / w,
            _repeats(line_of, line_hash, texts) / ln,
            _repeats(of[:-2][same], runs[same], texts) / w if len(h) > 2 else np.zeros(texts),
        ]
    )


@dataclass
class Model:
    """Lookup tables over binned features; log-odds of being good add up."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        small = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (a, b), grid in zip(self.pairs, self.grids):
            out += grid[small[a], small[b]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -60, 60)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree over ordered bins: split greedily up to ``leaves`` ranges; a Newton step a leaf."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    ranges = [(0, len(g))]

    def worth(a, b):
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)

    while len(ranges) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(ranges):
            c = np.arange(a + 1, b)
            if len(c):
                left, right = H[c] - H[a], H[b] - H[c]
                gain = (G[c] - G[a]) ** 2 / (left + 1) + (G[b] - G[c]) ** 2 / (right + 1) - worth(a, b)
                gain[(left < least) | (right < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], r, int(c[k]))
        if best[1] is None:
            break
        a, b = ranges.pop(best[1])
        ranges += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cross cut of a grid: its gain and the four parts' Newton steps."""
    def corner(m):
        return np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1)

    G, H = corner(g), corner(h)
    r, c = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    out = np.zeros_like(g)
    if not len(r) or not len(c):
        return 0.0, out

    def four(M):
        tl = M[np.ix_(r, c)]
        top, left, all_ = M[r, -1][:, None], M[-1, c][None, :], M[-1, -1]
        return tl, top - tl, left - tl, all_ - top - left + tl

    gs, hs = four(G), four(H)
    gain = sum(a * a / (b + 1.0) for a, b in zip(gs, hs))
    gain[np.minimum.reduce(hs) < least] = -1
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, out
    v = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs)]
    y, x = r[i], c[j]
    out[:y, :x], out[:y, x:], out[y:, :x], out[y:, x:] = v
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1.0)), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 6, bins: int = 48, coarse_bins: int = 12, rate: float = 0.15, leaves: int = 4, least: float = 4.0, pair_least: float = 0.25) -> Model:
    """Cyclic boosting of the logistic loss; ``y`` is 0 or 1."""
    n, m = x.shape
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Model(float(np.log(share / (1 - share))), [_cuts(x[:, j], bins) for j in range(m)], [], [], [_cuts(x[:, j], coarse_bins) for j in range(m)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    z = np.full(n, model.base)

    def pull():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            g, h = pull()
            size = len(model.tables[j])
            step = rate * _shallow(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, least)
            model.tables[j] += step
            z += step[at[j]]
    def cells(a, b, w):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(small[a] * shape[1] + small[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = pull()
    found = sorted(((-_quadrants(cells(a, b, g), cells(a, b, h), pair_least)[0], a, b) for a in range(m) for b in range(a + 1, m)))
    model.pairs = [(a, b) for worth, a, b in found[:pairs] if worth < 0]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), grid in zip(model.pairs, model.grids):
            g, h = pull()
            step = rate * _quadrants(cells(a, b, g), cells(a, b, h), pair_least)[1]
            grid += step
            z += step[small[a], small[b]]
    return model


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features), a row for a row; null and empty texts have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000):
            x = features_of(*byte_view(batch.column(1)))
            step = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(step), pa.array(x.reshape(-1)))], names=["id", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, features array<double>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Model:
    """Train on at most ``most`` labels, chosen by a hash of the id, and the documents they name.

    Rows with a null id, label or text are not used. Where an id has several
    labels or texts each pairing counts. With labels of one kind only the model
    is that constant; with none it gives every text the probability 0.5.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    chosen = sampled(known, most, known.count(), "k", "y")
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    # the chosen labels are bounded by ``most``, so they may be sent to every task; the
    # rows they name are as few but where an id repeats, and then as many are taken
    rows = feature_rows(texts.join(F.broadcast(chosen), "k").select(F.struct("k", "y").alias("k"), "t"), "k", "t")
    rows = sampled(rows.select("k.k", "k.y", "features"), most, 0, "k", "y", "features").collect()
    if not rows:
        return Model(0.0, [], [], [], [], [])
    rows.sort(key=lambda r: (r["k"], r["y"], r["features"]))
    return train(np.array([r["features"] for r in rows]), np.array([float(r["y"]) for r in rows]), **how)


def classify(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep), a row for a row.

    ``score`` is the probability of good quality and ``keep`` whether it is at
    least ``least``. A null text has a null score and isn't kept; an empty one
    is scored by its features, all zero. Repeated rows, ties and null ids are
    scored as they come; other columns are not carried; an empty table gives an
    empty result.
    """
    check_names(id_col, "score", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000):
            p = model.probability(features_of(*byte_view(batch.column(1))))
            null = np.array(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, mask=null), pa.array((p >= least) & ~null)], names=["id", "score", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns as they were.

    Null texts go; an empty text is judged by its features, all zero. Rows are
    judged one by one, so repeated rows stay or go together and a null id
    changes nothing. An empty table stays empty.
    """
    at = docs.schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000):
            p = model.probability(features_of(*byte_view(batch.column(at))))
            yield batch.filter(pa.array((p >= least) & ~np.array(batch.column(at).is_null())))

    return docs.mapInArrow(run, docs.schema)
