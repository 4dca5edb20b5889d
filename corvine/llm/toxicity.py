"""Toxicity by a linear-chain conditional random field over tokens.

Labels mark whole documents, so the tags of tokens are latent: a document is toxic when at least one of its
tokens is. The two-state chain (clean, toxic) over hashed features of word, affixes and shape is fitted by gradient ascent on
the likelihood of the document labels under that rule: log p(no toxic tag) for a clean document,
log(1 - p(no toxic tag)) for a toxic one. Both gradients are expectations from forward-backward, so the
field itself decides which tokens of a toxic document are toxic; no word list is drawn up. Near copies in the sample
share one vote. A document's score is a logistic function of the log-odds of "some tag is toxic" and the
largest marginal, fitted on the same rows. Offending offsets are tokens whose marginal exceeds one half.

One chain runs over a whole text. It is computed in blocks of ``BLOCK`` tokens: every block yields its 2 x 2 transfer matrix,
messages pass from block to block, then all blocks are finished independently. The results are those of one
pass over the text, whatever the block, the batch or the part of a very long text that was read at a time.

The sample: at most ``SAMPLE`` labelled rows and ``SAMPLE_CHARS`` characters of text, taken in the order of a hash of
the id. All tokens of a sampled row take part, and the order in which rows arrive does not matter.

Defined results: null, empty and blank texts get the score of no evidence and no spans; rows with a
null id are scored and count as not held out; repeated rows are scored each; labels with nulls are
ignored; several labels of an id count as the largest; without any usable label of both kinds the score is 0.5 x the smoothed base rate; further columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.textvec import chunks

BLOCK = 64
SLICE = 4096  # blocks that are finished at a time
DIMS = 1 << 16
SAMPLE = 5000
SAMPLE_CHARS = 24_000_000
REMEMBER = 200_000
WIDTH = 7  # features of a token
EPOCHS = 80
#: The least log-loss of 0.005, 0.02 and 0.1 in ``cross_validated`` on training rows.
RIDGE = 0.005
LONG = 1 << 20
_core = re.compile(r"\w+")
_space = re.compile(r"\s")


@dataclass
class Crf:
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # exp of transition scores, 2 x 2
    doc: np.ndarray  # logistic coefficients: constant, log-odds of a toxic tag, largest marginal


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def core(token: str) -> str:
    found = _core.findall(token.lower())
    return max(found, key=len) if found else ""


def features(token: str) -> list[int]:
    """Hashed features of one token; the same token always has the same ones."""
    c = core(token)
    shape = "A" if token.isupper() else "a" if token.islower() else "x"
    keys = ("w" + c, "p" + c[:3], "p" + c[:4], "p" + c[:5], "s" + c[-4:], f"n{min(len(c), 12)}", "h" + shape)
    return [xxhash.xxh64_intdigest(k) % DIMS for k in keys]


class Emissions(dict):
    """Token to emission score of the toxic state; bounded memory of what was met."""

    def __init__(self, m: Crf, most: int = REMEMBER):
        super().__init__()
        self.m, self.most = m, most

    def __missing__(self, token: str) -> float:
        s = float(self.m.weights[features(token)].sum()) + self.m.bias
        if len(self) > self.most:
            self.clear()
        if len(token) <= 64:
            self[token] = s
        return s


class Chain:
    """Messages of chains laid out in blocks; ``lengths`` are tokens per document, documents without tokens have no block.

    The chain starts with equal weights of both states; emission scores count for the toxic state.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.per = -(-lengths // BLOCK)
        self.first = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(self.per, out=self.first[1:])
        self.n = int(self.first[-1])
        self.owner = np.repeat(np.arange(len(lengths)), self.per)
        self.lead = np.zeros(self.n, bool)
        self.lead[self.first[:-1][lengths > 0]] = True
        last = self.first[1:][lengths > 0] - 1
        self.used = np.full(self.n, BLOCK, np.int64)
        self.used[last] = (lengths[lengths > 0] - 1) % BLOCK + 1

    def padded(self, flat: np.ndarray, a: int, b: int) -> np.ndarray:
        """Places x blocks a..b of the per-token values ``flat`` (documents one after the other), zero beyond a document's end."""
        out = np.zeros((b - a, BLOCK))
        live = np.arange(BLOCK) < self.used[a:b, None]
        start = int(self.used[:a].sum())
        out[live] = flat[start : start + int(self.used[a:b].sum())]
        return out.T

    def transfer(self, odds: np.ndarray, a: int, b: int, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2 x 2 x blocks matrices of sum 1, log of what they were divided by)."""
        n = b - a
        m, log = np.zeros((2, 2, n)), np.zeros(n)
        lead = self.lead[a:b]
        for t in range(BLOCK):
            if not t:
                step = np.where(lead, np.eye(2)[:, :, None], trans[:, :, None])
                now = step.copy()
            else:
                now = np.empty_like(m)
                now[:, 0] = m[:, 0] * trans[0, 0] + m[:, 1] * trans[1, 0]
                now[:, 1] = m[:, 0] * trans[0, 1] + m[:, 1] * trans[1, 1]
            now[:, 1] *= odds[t]
            size = now.sum((0, 1))
            now /= size
            if t:
                live = self.used[a:b] > t
                now, size = np.where(live, now, m), np.where(live, size, 1.0)
            m, log = now, log + np.log(size)
        return m, log

    def messages(self, flat: np.ndarray, trans: np.ndarray) -> None:
        """``into`` and ``back`` of every block, ``log_z`` and ``log_clean`` (probability of no toxic tag) of every document."""
        m, log = np.empty((2, 2, self.n)), np.empty(self.n)
        for a in range(0, self.n, SLICE):
            b = min(a + SLICE, self.n)
            m[:, :, a:b], log[a:b] = self.transfer(np.exp(np.clip(self.padded(flat, a, b), -30, 30)), a, b, trans)
        self.into, self.back = np.full((2, self.n), 0.5), np.ones((2, self.n))
        self.log_z = np.zeros(len(self.lengths))
        by = np.argsort(-self.per, kind="stable")
        counts = self.per[by]
        f = np.full((2, len(by)), 0.5)
        for k in range(int(counts[0]) if len(by) else 0):
            n = int(np.searchsorted(-counts, -k))  # documents with more than k blocks
            at = self.first[by[:n]] + k
            self.into[:, at] = f[:, :n]
            f = np.einsum("in,ijn->jn", f[:, :n], m[:, :, at])
            size = f.sum(0)
            f /= size
            self.log_z[by[:n]] += np.log(size) + log[at]
        for k in range(1, int(counts[0]) if len(by) else 0):
            n = int(np.searchsorted(-counts, -k))
            at = self.first[by[:n] + 1] - k
            g = np.einsum("ijn,jn->in", m[:, :, at], self.back[:, at])
            self.back[:, at - 1] = g / g.sum(0)
        steps = np.maximum(self.lengths - 1, 0)
        self.log_clean = np.where(self.lengths > 0, np.minimum(np.log(0.5) + steps * np.log(trans[0, 0]) - self.log_z, 0.0), 0.0)

    def finished(self, flat: np.ndarray, trans: np.ndarray, a: int, b: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(toxic marginals, places x blocks; expected transitions into each block's tokens, 2 x 2 x blocks) of blocks a..b."""
        odds = np.exp(np.clip(self.padded(flat, a, b), -30, 30))
        used, lead, n = self.used[a:b], self.lead[a:b], b - a
        ratio = np.empty((BLOCK, n))  # forward odds toxic : clean
        r = self.into[1, a:b] / np.maximum(self.into[0, a:b], 1e-300)
        for t in range(BLOCK):
            moved = (trans[0, 1] + r * trans[1, 1]) / (trans[0, 0] + r * trans[1, 0])
            r = (np.where(lead, r, moved) if not t else moved) * odds[t]
            ratio[t] = r
        back = self.back[1, a:b] / np.maximum(self.back[0, a:b], 1e-300)
        out = np.empty((BLOCK, n))
        moves = np.zeros((2, 2, n)) if pairs else None
        for t in range(BLOCK - 1, -1, -1):
            live = used > t
            x = ratio[t] * back
            out[t] = np.where(live, x / (1 + x), 0.0)
            up = odds[t] * back
            if pairs:
                before = ratio[t - 1] if t else self.into[1, a:b] / np.maximum(self.into[0, a:b], 1e-300)
                p = np.array([[np.full(n, trans[0, 0]), trans[0, 1] * up], [trans[1, 0] * before, trans[1, 1] * before * up]])
                moves += np.where(live & ~lead if not t else live, p / p.sum((0, 1)), 0.0)
            back = np.where(live, (trans[1, 0] + trans[1, 1] * up) / (trans[0, 0] + trans[0, 1] * up), back)
        return out, moves


def odds_of_some(log_clean: np.ndarray) -> np.ndarray:
    """Log-odds that some tag is toxic, within 20 of even odds."""
    return np.clip(np.log(np.maximum(-np.expm1(log_clean), 1e-300)) - log_clean, -20, 20)


def kin(tokens: list[str]) -> int:
    """The smallest hash of a 3-token shingle: near copies mostly share it."""
    return min(xxhash.xxh64_intdigest(" ".join(tokens[i : i + 3])) for i in range(max(1, len(tokens) - 2)))


def gradient(chain: Chain, e: np.ndarray, word: np.ndarray, n_words: int, trans: np.ndarray, toxic: np.ndarray, vote: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(by distinct token, by log transition, log-likelihood) of the document labels."""
    chain.messages(e, trans)
    some = odds_of_some(chain.log_clean)
    value = float((vote * np.where(toxic, chain.log_clean + some, chain.log_clean)).sum())
    pull = vote * np.where(toxic, np.exp(-some), -1.0)  # p(clean) / p(not clean) where toxic
    steps = np.maximum(chain.lengths - 1, 0)
    by_word, by_move = np.zeros(n_words), np.zeros((2, 2))
    at = 0
    for a in range(0, chain.n, SLICE):
        b = min(a + SLICE, chain.n)
        p, moves = chain.finished(e, trans, a, b, True)
        g = pull[chain.owner[a:b]]
        live = np.arange(BLOCK) < chain.used[a:b, None]
        flat = (p * g).T[live]
        by_word += np.bincount(word[at : at + len(flat)], flat, n_words)
        at += len(flat)
        by_move += (moves * g).sum(2)
    by_move[0, 0] -= (pull * steps).sum()
    return by_word, by_move, value


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, ridge: float = RIDGE) -> Crf:
    """Train on labelled texts, in the order given; what is held here is bounded by the size of the sample."""
    rate = (sum(toxic) + 0.5) / (len(toxic) + 1)
    none = Crf(np.zeros(DIMS), -8.0, np.array([[0.9, 0.1], [0.5, 0.5]]), np.array([np.log(rate / (2 - rate)), 0.0, 0.0]))
    some = [(t, y) for t, y in zip(texts, toxic, strict=True) if not t.isspace() and t]
    if len({bool(y) for _, y in some}) < 2:
        return none
    ids: dict[str, int] = {}
    words, keys = [], []
    for t, _ in some:
        tokens = t.split()
        words.append(np.fromiter((ids.setdefault(x, len(ids)) for x in tokens), np.int32, len(tokens)))
        keys.append(kin(tokens))
    groups = Counter(keys)
    vote = np.array([1 / groups[k] for k in keys])  # near copies share one
    chain = Chain(np.array([len(x) for x in words], np.int64))
    word = np.concatenate(words)
    del words
    feats = np.fromiter((f for x in ids for f in features(x)), np.int32, WIDTH * len(ids)).reshape(-1, WIDTH)
    used, inverse = np.unique(feats, return_inverse=True)
    inverse = inverse.reshape(feats.shape)
    y = np.array([bool(v) for _, v in some])
    w, bias, trans = np.zeros(len(used)), -7.0, np.log(np.array([[0.95, 0.05], [0.5, 0.5]]))
    prior = trans.copy()
    m, v = np.zeros(len(used) + 5), np.zeros(len(used) + 5)
    for k in range(1, epochs + 1):
        e = (w[inverse].sum(1) + bias)[word]
        by_word, by_move, _ = gradient(chain, e, word, len(ids), np.exp(trans), y, vote)
        by_feature = np.bincount(inverse.ravel(), np.repeat(by_word, inverse.shape[1]), len(used))
        grad = np.concatenate([by_feature - ridge * w, [by_word.sum()], (by_move - 0.1 * (trans - prior)).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.2 * (1 - 0.8 * k / epochs)
        delta = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-3)
        w, bias, trans = w + delta[: len(used)], bias + delta[len(used)], trans + delta[len(used) + 1 :].reshape(2, 2)
    weights = np.zeros(DIMS)
    weights[used] = w
    model = Crf(weights, float(bias), np.exp(trans), np.zeros(3))
    x, _ = evidence(model, chain, (w[inverse].sum(1) + bias)[word])
    x = np.column_stack([np.ones(len(x)), x])
    coef = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (vote * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        coef += np.linalg.solve(h, x.T @ (vote * (y - q)) - 1e-2 * coef)
    model.doc = coef
    return model


def cross_validated(texts: list[str], toxic: list[int], ridges: tuple[float, ...], folds: int = 3, epochs: int = EPOCHS) -> list[float]:
    """Mean log-loss by ridge on folds of the given training rows, each scored by a model fitted on the other folds.

    Rows that share a smallest shingle, near copies mostly, are in one fold. Rows without words take part in no fold.
    """
    rows = [(t, bool(y), kin(t.split()) % folds) for t, y in zip(texts, toxic, strict=True) if t and not t.isspace()]
    out = []
    for ridge in ridges:
        loss = n = 0
        for k in range(folds):
            fold = [(t, y) for t, y, f in rows if f == k]
            rest = [(t, y) for t, y, f in rows if f != k]
            if not fold or not rest:
                continue
            m = fit([t for t, _ in rest], [int(y) for _, y in rest], epochs, ridge)
            x, _ = measured(m, Emissions(m), [t for t, _ in fold])
            z = np.clip(m.doc[0] + x @ m.doc[1:], -30, 30)
            loss += np.logaddexp(0, np.where([y for _, y in fold], -z, z)).sum()
            n += len(fold)
        out.append(loss / max(1, n))
    return out


def evidence(m: Crf, chain: Chain, flat: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per document (log-odds of a toxic tag, largest marginal) and the numbers of its toxic tokens; ``flat`` has the emission scores."""
    x, hits = np.zeros((len(chain.lengths), 2)), [np.zeros(0, np.int64)] * len(chain.lengths)
    x[:, 0] = -20.0
    if not chain.n:
        return x, hits
    chain.messages(flat, m.trans)
    some = np.flatnonzero(chain.lengths)
    x[some, 0] = odds_of_some(chain.log_clean)[some]
    top, found = np.empty(chain.n), []
    for a in range(0, chain.n, SLICE):
        b = min(a + SLICE, chain.n)
        p, _ = chain.finished(flat, m.trans, a, b)
        top[a:b] = p.max(0)
        strong = np.flatnonzero(top[a:b] > 0.5)
        t, k = np.nonzero(p[:, strong] > 0.5)
        found.append(np.column_stack([strong[k] + a, t]))
    x[some, 1] = np.maximum.reduceat(top, chain.first[:-1][some])
    rows = np.concatenate(found)
    if len(rows):
        doc = chain.owner[rows[:, 0]]
        place = (rows[:, 0] - chain.first[doc]) * BLOCK + rows[:, 1]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True):
            hits[doc[a]] = place[a:b]
    return x, hits


def parts_of(text: str) -> list[str]:
    """A very long text cut at white space into parts of about LONG characters, which are read one by one; the chain goes on over all of them."""
    if len(text) <= LONG:
        return [text]
    out, at = [], 0
    while at < len(text):
        m = _space.search(text, at + LONG)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def measured(m: Crf, emissions: Emissions, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """``evidence`` of texts; of a very long one the tokens are read part by part and only their scores are kept."""
    x, hits = np.zeros((len(texts), 2)), []
    get = emissions.__getitem__
    for a, b in chunks([len(t) for t in texts]):
        lengths, flat = [], []
        for t in texts[a:b]:
            n = 0
            for part in parts_of(t):
                tokens = part.split()
                flat.append(np.fromiter(map(get, tokens), np.float32, len(tokens)))
                n += len(tokens)
            lengths.append(n)
        x[a:b], found = evidence(m, Chain(np.array(lengths, np.int64)), np.concatenate(flat))
        hits += found
    return x, hits


_kept: dict[int, tuple] = {}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mod: int = 3, rest: int = 1, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS) -> Crf:
    """Fit on at most ``sample`` labelled rows and ``chars`` characters outside the held-out remainder, picked by hash order."""
    rows = sampled(docs, labels, sample, chars, mod, rest, label, id_col, text_col)
    got = sorted((r.h, r.text, r.y) for r in rows.collect())
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def sampled(docs: DataFrame, labels: DataFrame, sample: int, chars: int, mod: int, rest: int, label: str, id_col: str, text_col: str) -> DataFrame:
    """h (hash of the id), text, y of at most ``sample`` labelled rows that have ``chars`` characters together, taken in the order of h."""
    rows = labelled(docs, labels, sample, mod, rest, label, id_col, text_col)
    # lengths first: only texts within the bound are asked for
    sizes = sorted((r.h, str(r.doc_id), r.doc_id, r.n) for r in rows.groupBy("h", "doc_id").agg(F.sum(F.length("text")).alias("n")).collect())
    kept, left = [], chars
    for _, _, i, n in sizes:
        if n <= left:
            kept.append((i,))
            left -= n
    chosen = docs.sparkSession.createDataFrame(kept, f"_id {docs.schema[id_col].dataType.simpleString()}")
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("h", "text", "y")


def labelled(docs: DataFrame, labels: DataFrame, sample: int, mod: int, rest: int, label: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the id), text, y of the sample: at most ``sample`` ids are broadcast, so no text is shuffled."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    ids = ids.filter(~held_out(F.col("doc_id"), mod, rest)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "text", "y")


def score(docs: DataFrame, model: Crf, threshold: float = 0.7, mod: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans ("start:end" of offending tokens, code points)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if id(m) not in _kept:
            _kept.clear()
            _kept[id(m)] = (m, Emissions(m))
        emissions = _kept[id(m)][1]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            x, hits = measured(m, emissions, texts)
            scores = 1 / (1 + np.exp(-np.clip(m.doc[0] + x @ m.doc[1:], -30, 30)))
            counts, spans = [len(h) for h in hits], []
            for t, h in zip(texts, hits, strict=True):
                want = set(h.tolist())
                spans.append(",".join(f"{s.start()}:{s.end()}" for i, s in enumerate(re.finditer(r"\S+", t)) if i in want) if want else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], ["doc_id", "score", "n_toxic", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, n_toxic long, spans string")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic", "spans")


def reject(docs: DataFrame, model: Crf, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        emissions = Emissions(m)
        for batch in batches:
            x, _ = measured(m, emissions, [t or "" for t in batch.column(at).to_pylist()])
            keep = 1 / (1 + np.exp(-np.clip(m.doc[0] + x @ m.doc[1:], -30, 30))) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
