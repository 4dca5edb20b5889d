"""Document quality by a factorisation machine.

Inputs are hashed words, binned structure statistics and text length. Scoring uses the sum-of-squares
identity: the sum of all pairwise interactions  sum_{i<j} <v_i, v_j> x_i x_j  equals half of
|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2, so it is linear in the number of features. Every word
occurrence is one feature instance with value 1/sqrt(words); a statistic is one feature with value 1.

Training uses a bounded, documented sample of labelled rows outside the held-out remainder; what
comes to the driver are their hashed words and statistics, of at most ``sample`` rows with ``chars`` characters
together. The order in which rows arrive does not matter.

Defined results: null, empty and blank texts are scored from their (zero) statistics; null ids are
scored and not held out; null labels are ignored; with one class or no label the score is the smoothed
base rate; repeated rows are scored each; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textvec import Words, chunks, mix
from corvine.llm.toxicity import held_out, sampled

DIMS = 1 << 15
RANK = 4
BINS = 12
SAMPLE = 8000
SAMPLE_CHARS = 48_000_000
STATS = ("bytes", "words", "mean_word", "long_words", "alpha", "upper", "digit", "symbol", "pipe", "bang", "stop", "comma", "high", "lines", "mean_line", "distinct", "repeat_next", "top_word", "distinct_lines", "symbol_words", "short_lines")


@dataclass
class Machine:
    edges: np.ndarray  # statistics x (BINS - 1) cut points
    w0: float
    words: np.ndarray  # DIMS x (1 + RANK): weight, factors
    stats: np.ndarray  # (statistics * BINS) x (1 + RANK)


def _class_table() -> np.ndarray:
    t = np.zeros((256, 9), np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = [c.isalpha(), c.isupper(), c.isdigit(), not c.isalnum() and not c.isspace(), c == "|", c == "!", c == ".", c == ",", 0]
    t[128:, 0] = t[128:, 8] = 1
    return t


_CLASS = _class_table()


def describe(texts: list[bytes]) -> tuple[np.ndarray, Words]:
    """(texts x statistics, the words). Ratios are of the bytes, words or lines of the text."""
    w = Words(texts)
    buf, n = w.buf, w.n
    size = np.diff(w.first) - 1
    totals = np.empty((n, 9))
    for k in range(9):  # each text ends with a separator, so no text is an empty range
        totals[:, k] = np.add.reduceat(_CLASS[:, k][buf], w.first[:-1], dtype=np.int64)
    count, length = w.count, w.end - w.start
    some = np.maximum(count, 1)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, x, n) if len(x) else np.zeros(n)

    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    sym = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_CLASS[:, 3][buf], out=sym[1:], dtype=np.int32)
    noisy = (sym[w.end] - sym[w.start]) >= 2
    # lines: the separators between texts end the last line of each
    stop = np.flatnonzero(buf == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    line_doc = np.searchsorted(w.first, begin, "right") - 1
    lo, hi = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    hashed = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash ^ np.uint64(7)), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        line_hash = hashed[hi] - hashed[lo]
    full = hi > lo
    line_doc, line_hash, line_words = line_doc[full], line_hash[full], (hi - lo)[full]
    lines = np.bincount(line_doc, minlength=n)
    o = np.lexsort((line_hash, line_doc))
    lh, ld = line_hash[o], line_doc[o]
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[1:] != lh[:-1]) | (ld[1:] != ld[:-1])
    some_lines, some_bytes = np.maximum(lines, 1), np.maximum(size, 1)
    out = np.column_stack([
        np.log1p(size), np.log1p(count), per_doc(length) / some, per_doc((length > 14).astype(float)) / some,
        totals[:, 0] / some_bytes, totals[:, 1] / some_bytes, totals[:, 2] / some_bytes, totals[:, 3] / some_bytes, totals[:, 4] / some, totals[:, 5] / some, totals[:, 6] / some, totals[:, 7] / some, totals[:, 8] / some_bytes,
        np.log1p(lines), np.log1p(count / some_lines), np.bincount(d[at], minlength=n) / some, per_doc(same) / some, top / some, np.bincount(ld[fresh], minlength=n) / some_lines, per_doc(noisy.astype(float)) / some,
        np.bincount(line_doc, (line_words < 4).astype(float), n) / some_lines,
    ])
    return out, w


def hashed_words(w: Words) -> np.ndarray:
    return (w.hash % np.uint64(DIMS)).astype(np.int32)


def bins(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Feature number of every statistic of every text."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        out[:, k] = k * BINS + np.searchsorted(edges[k], stats[:, k], "right")
    return out


def raw_scores(m: Machine, stats: np.ndarray, words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(linear + pairwise score, summed factors) of every text, linear in features."""
    n = len(count)
    some = np.flatnonzero(count)
    at = np.cumsum(count) - count
    x = 1 / np.sqrt(np.maximum(count, 1))
    sums, squares = np.zeros((n, 1 + RANK)), np.zeros((n, RANK))
    if len(words):
        for f in range(1 + RANK):
            col = np.ascontiguousarray(m.words[:, f])[words]
            sums[some, f] = np.add.reduceat(col, at[some])
            if f:
                squares[some, f - 1] = np.add.reduceat(col * col, at[some])
        sums *= x[:, None]
        squares *= (x * x)[:, None]
    s = m.stats[stats]
    sums += s.sum(1)
    squares += (s[:, :, 1:] ** 2).sum(1)
    return m.w0 + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1), sums[:, 1:]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(stats: np.ndarray, words: list[np.ndarray], y: np.ndarray, epochs: int = 12, seed: int = 5) -> Machine:
    """Adam on the logistic loss, in small batches, from a bounded sample."""
    rng = np.random.default_rng(seed)
    k = len(STATS)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = np.sort(np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T, axis=1) if len(stats) else np.zeros((k, BINS - 1))
    m = Machine(edges, float(np.log(rate / (1 - rate))), np.zeros((DIMS, 1 + RANK)), np.zeros((k * BINS, 1 + RANK)))
    if len(y) == 0 or y.min() == y.max():
        return m
    m.words[:, 1:] = rng.normal(0, 0.02, (DIMS, RANK))
    m.stats[:, 1:] = rng.normal(0, 0.05, (k * BINS, RANK))
    binned = bins(edges, stats)
    params = {"w": m.words, "s": m.stats}
    mom = {a: (np.zeros_like(p), np.zeros_like(p)) for a, p in params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate_now = 0.02 / (1 + 0.3 * epoch)
        for i in range(0, len(y), 256):
            rows = order[i : i + 256]
            count = np.array([len(words[r]) for r in rows])
            flat = np.concatenate([words[r] for r in rows])
            z, sums = raw_scores(m, binned[rows], flat, count)
            g = (logistic(z) - y[rows]) / len(rows)
            x = 1 / np.sqrt(np.maximum(count, 1))
            grad = {"w": 2e-4 * m.words, "s": 2e-4 * m.stats}
            gx = np.repeat(g * x, count)
            grad["w"][:, 0] += np.bincount(flat, gx, DIMS)
            gs = np.repeat(g, k)
            sb = binned[rows].ravel()
            grad["s"][:, 0] += np.bincount(sb, gs, k * BINS)
            gxx = np.repeat(g * x * x, count)
            own = np.bincount(flat, gxx, DIMS)
            for f in range(RANK):
                grad["w"][:, f + 1] += np.bincount(flat, np.repeat(g * x * sums[:, f], count), DIMS) - own * m.words[:, f + 1]
                grad["s"][:, f + 1] += np.bincount(sb, np.repeat(g * sums[:, f], k), k * BINS) - np.bincount(sb, gs, k * BINS) * m.stats[:, f + 1]
            step += 1
            m.w0 -= rate_now * float(g.sum())
            for a, p in params.items():
                m1, m2 = mom[a]
                m1 += 0.1 * (grad[a] - m1)
                m2 += 0.01 * (grad[a] ** 2 - m2)
                p -= rate_now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return m


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS) -> Machine:
    """Fit on at most ``sample`` labelled rows and ``chars`` characters, in the order of a hash of the id; statistics and hashed words are computed where the texts are."""
    rows = sampled(docs, labels, sample, chars, mod, rest, "quality", id_col, text_col).select(F.col("text").cast("binary").alias("text"), "y", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, 0)
            for a, b in chunks([len(t) for t in texts]):
                stats, w = describe(texts[a:b])
                ids = hashed_words(w).astype(np.uint16)
                cut = np.append(w.at, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stats.tolist(), pa.list_(pa.float64())), pa.array([ids[cut[i] : cut[i] + w.count[i]].tobytes() for i in range(w.n)], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["stats", "ids", "y", "h"]
                )

    got = sorted(rows.mapInArrow(run, "stats array<double>, ids binary, y int, h long").collect(), key=lambda r: (r.h, bytes(r.ids), r.stats, r.y))
    stats = np.array([r.stats for r in got]).reshape(-1, len(STATS))
    return fit(stats, [np.frombuffer(r.ids, np.uint16).astype(np.int64) for r in got], np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Machine, threshold: float = 0.3, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, out = texts_of(batch, 1), []
            for a, b in chunks([len(t) for t in texts]):
                stats, w = describe(texts[a:b])
                out.append(logistic(raw_scores(m, bins(m.edges, stats), hashed_words(w), w.count)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
