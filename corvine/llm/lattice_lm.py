"""Language-model scores from a lattice of subwords: every way to spell a token with vocabulary pieces counts.

The vocabulary is a given file; it is neither trained nor changed. Its scores say in which order its pieces rank.

1. *Counts.* Tokens (white-space words in lower case, and one end per text) of the training texts are counted by a shuffle
   with sums per task. Texts that are held out only contribute the names of their tokens.
2. *Calibration.* The scores of the vocabulary are ranks, not probabilities. Pieces of neighbouring ranks form classes (word-initial and inner
   ones apart, and bytes, which spell what no piece covers). Each class gets the share of use that forward-backward sums over all lattices of all
   counted tokens expect, started from a Zipf law over the scores; within a class the pieces follow that law. One row of some ninety sums per task reaches the driver.
3. *Lattice.* A token is the piece of a word's beginning and then any pieces, so no piece spans two tokens and the lattice of a text is a chain of
   its tokens' lattices. ``a[j] = log sum(exp(a[i] + w(i, j)))`` over all pieces from i to j, forward over the bytes of the token, gives its marginal
   log probability over all segmentations. Each distinct token goes through it once, many tokens of a length at a time.
4. *Memory.* Beside the pieces a token's lattice has one arc over the whole token, weighted by its training count: with the mass
   ``theta`` of the pieces, ``p = (count + theta * lattice) / (total + theta)``. Theta gives unseen tokens the share that Good and Turing estimate, the share of
   tokens that were seen once. ``lattice_score`` is the marginal of the pieces alone.
5. *Scoring.* Tokens with at least 1/COMMON of all occurrences are at most COMMON many; they go to every worker and cover most of a text where it lies.
   The others leave as one row per text and token, meet their counts in a shuffled join, and come back as partial sums.

Defined results: null and blank texts consist of the end alone; repeated rows are scored each and, in training, counted each; a row without id
is held out (checksum 0); without training texts ``train_tokens`` is 0, ``base_score`` 0 and the pieces alone give the score; words of any length are scored, without being cut;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.storage import drop_shared, written

COMMON = 500_000
#: Distinct tokens that a task counts before it hands its sums on.
HELD = 400_000
#: The end of a text; no word holds white space.
END = b"\n"
#: Tokens up to so many bytes go through the lattice in arrays, longer ones in a loop.
ARRAY = 64
START = "▁"
#: Zipf's law over ranks is flat up to about here.
FLAT = 16
BANDS = 4  # classes per doubling of the rank
BATCH = 4096
LN10 = math.log(10)


@dataclass
class Pieces:
    """Spellings, by whether they begin a word; class and share within the class of each piece."""

    initial: dict[bytes, int] = field(default_factory=dict)
    inner: dict[bytes, int] = field(default_factory=dict)
    cls: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    start: np.ndarray | None = None  # first share of each class
    byte: int = 0  # number of the first byte piece

    @property
    def classes(self) -> int:
        return len(self.start)

    def log_weights(self, mass: np.ndarray) -> np.ndarray:
        """Natural log probability of each piece when the classes have ``mass``."""
        return np.log(np.asarray(self.share)) + np.log(mass)[np.asarray(self.cls)]


def pieces_of(path: str) -> Pieces:
    """Pieces of a sentencepiece file. Control pieces and runs of word starts spell nothing and are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    p, zipf = Pieces(), []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) or START in text[1:]:
            continue
        rank = max(-sp.get_score(i), 0.0)
        first = text.startswith(START)
        (p.initial if first else p.inner)[text.removeprefix(START).encode()] = len(p.cls)
        p.cls.append(1 + 2 * int(BANDS * math.log2(1 + rank / FLAT)) + first)
        zipf.append(1 / (rank + FLAT))
    p.byte = len(p.cls)
    p.cls += [0] * 256
    zipf += [1e-3 / FLAT / 256] * 256
    used = sorted(set(p.cls))
    p.cls = [used.index(c) for c in p.cls]
    total = np.bincount(p.cls, zipf)
    p.start = total / total.sum()
    p.share = [z / total[c] for z, c in zip(zipf, p.cls, strict=True)]
    return p


class Lattice:
    """Marginals and expected classes of tokens under fixed weights of the pieces."""

    def __init__(self, p: Pieces, mass: np.ndarray):
        self.p, self.w, self.cls = p, p.log_weights(mass), np.asarray(p.cls)
        self.bare = p.initial.get(b"")
        # without a piece for the bare start of a word its three bytes stand for it
        self.empty = float(self.w[self.bare]) if self.bare is not None else float(sum(self.w[p.byte + b] for b in START.encode()))
        self.tables = [self._table(p.initial), self._table(p.inner)]

    @staticmethod
    def _table(spelled: dict[bytes, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: sorted hashes of the pieces and their numbers."""
        by: dict[int, list[tuple[int, int]]] = {}
        for text, number in spelled.items():
            if text:
                by.setdefault(len(text), []).append((hash_of(text), number))
        out = {}
        for n, rows in by.items():
            rows.sort()
            out[n] = (np.array([h for h, _ in rows], np.uint64), np.array([k for _, k in rows], np.int64))
        return out

    def arcs(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) to the piece of every word, -1 for none; ``words`` is a matrix of bytes. Place -1 is before the word's start mark."""
        n, length = words.shape
        out, h = {}, np.zeros((n, length), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, length + 1):
                h = h[:, : length - size + 1] * MULTIPLY + SPREAD[words[:, size - 1 :]]
                for table, begins in ((self.tables[0], [-1]), (self.tables[1], range(length - size + 1))):
                    if size not in table:
                        continue
                    hashes, numbers = table[size]
                    own = h[:, :1] if begins == [-1] else h
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    found = np.where(hashes[at] == own, numbers[at], -1)
                    for k, i in enumerate(begins):
                        if (found[:, k] >= 0).any():
                            out[i, max(i, 0) + size] = found[:, k]
                if size >= max(max(t, default=0) for t in self.tables):
                    break
        for i in range(length):  # every byte may also be spelled as such
            out[i, -i - 2] = self.p.byte + words[:, i].astype(np.int64)
        return out

    def _forward(self, words: np.ndarray, arcs: dict) -> np.ndarray:
        n, length = words.shape
        a = np.full((length + 1, n), -np.inf)
        a[0] = self.empty
        into: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), piece in arcs.items():
            into.setdefault(i + 1 if j < 0 else j, []).append((i, piece))
        for j in range(1, length + 1):
            parts = [np.where(piece >= 0, self.w[piece], -np.inf) + (0.0 if i < 0 else a[i]) for i, piece in into[j]]
            a[j] = log_sum(parts)
        return a

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, summed over all segmentations."""
        out = np.empty(len(words))
        for at, some in matrices(words):
            if some is None:
                out[at] = [self.long(words[k]) for k in at]
            else:
                out[at] = self._forward(some, self.arcs(some))[-1]
        return out

    def long(self, word: bytes) -> float:
        """The same for one word of any length; only as many places as the longest piece has bytes are looked back at."""
        inner, initial, w = self.p.inner, self.p.initial, self.w
        most = max(map(len, inner), default=1)
        ahead = max(map(len, initial), default=0)
        a = [self.empty]
        for j in range(1, len(word) + 1):
            parts = [a[-1] + w[self.p.byte + word[j - 1]]]
            for i in range(max(0, j - most), j):
                k = inner.get(word[i:j])
                if k is not None:
                    parts.append(a[i - j] + w[k])
            if j <= ahead and (k := initial.get(word[:j])) is not None:
                parts.append(w[k])
            top = max(parts)
            a.append(top + math.log(sum(math.exp(x - top) for x in parts)))
            if len(a) > most + 1:
                a.pop(0)
        return float(a[-1])

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each class is used by all lattices, every word as often as ``counts`` says. Words beyond ``ARRAY`` bytes are seen through their first and further pieces of ARRAY bytes."""
        total = np.zeros(self.p.classes)
        cut = [(w[i : i + ARRAY], c) for w, c in zip(words, counts, strict=True) for i in range(0, max(len(w), 1), ARRAY)]
        weight = np.array([c for _, c in cut], float)
        for at, some in matrices([w for w, _ in cut]):
            arcs = self.arcs(some)
            a = self._forward(some, arcs)
            n, length = some.shape
            b = np.full((length + 1, n), -np.inf)
            b[length] = 0
            outof: dict[int, list[tuple[int, np.ndarray]]] = {}
            for (i, j), piece in arcs.items():
                outof.setdefault(i, []).append((i + 1 if j < 0 else j, piece))
            for i in range(length - 1, -1, -1):
                b[i] = log_sum([np.where(piece >= 0, self.w[piece], -np.inf) + b[j] for j, piece in outof[i]])
            for i, rows in outof.items():
                for j, piece in rows:
                    with np.errstate(invalid="ignore"):
                        use = np.exp((0.0 if i < 0 else a[i]) + np.where(piece >= 0, self.w[piece], -np.inf) + b[j] - a[length]) * weight[at]
                    ok = piece >= 0
                    total += np.bincount(self.cls[piece[ok]], use[ok], self.p.classes)
            if self.bare is not None:
                total[self.cls[self.bare]] += float((np.exp(self.empty + b[0] - a[length]) * weight[at]).sum())
        return total


_rng = np.random.default_rng(11)
SPREAD = _rng.integers(1, 2**64, 256, dtype=np.uint64)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def hash_of(text: bytes) -> int:
    h, m = 0, int(MULTIPLY)
    for b in text:
        h = (h * m + int(SPREAD[b])) & (2**64 - 1)
    return h


def log_sum(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    x = np.stack(parts)
    top = x.max(0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(0))


def matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of words of one length and their bytes as a matrix, at most BATCH at a time; long words without a matrix."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(size[order]) != 0))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        if not len(order):
            return
        for i in range(a, b, BATCH):
            at = order[i : min(i + BATCH, b)]
            n = int(size[at[0]])
            yield at, np.frombuffer(b"".join(words[k] for k in at), np.uint8).reshape(len(at), n) if n <= ARRAY else None


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows, so that many tokens of a length go through the lattice at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def held_out(doc_id: Column, mod: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 0


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes split at ASCII white space."""
    return text.encode().lower().split() if text else []


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c of every token of ``docs`` (doc_id, text); c counts the training texts alone and is 0 for tokens that only others have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            names = list(seen) + [w for w in other if w not in seen]
            n = list(seen.values()) + [0] * (len(names) - len(seen))
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64())], ["token", "c"])

        for batch in batches:
            for text, out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if out:
                    other.update(words_of(text.as_py()))
                else:
                    seen.update(words_of(text.as_py()))
                    seen[END] += 1
                if len(seen) + len(other) > HELD:
                    yield flush()
        yield flush()

    return docs.select("text", "held_out").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Totals:
    n: int
    distinct: int
    once: int
    texts: int

    @property
    def theta(self) -> float:
        """Mass of the lattice: unseen tokens get the share of tokens seen once."""
        return max(1.0, self.once * self.n / max(self.n - self.once, 1))

    def base(self, c: int) -> float:
        return math.log10((c + 0.1) / (self.n + 0.1 * (self.distinct + 1)))


def totals(counts: DataFrame) -> Totals:
    row = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long")), F.sum(F.when(F.col("token") == END, F.col("c")))).first()
    return Totals(*[int(x or 0) for x in row])


def calibrated(counts: DataFrame, p: Pieces, texts: int, rounds: int = 2) -> tuple[np.ndarray, float]:
    """Mass of each class and of the end, by expected use over all counted tokens; one row per class reaches the driver and round."""
    spark = counts.sparkSession
    mass, end = p.start * (1 - 1e-3), 1e-3
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((p, mass))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            of, m = held.value
            lattice, total = Lattice(of, m), np.zeros(of.classes)
            for many in gathered(batches):
                total += lattice.expected(many.column(0).to_pylist(), many.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(of.classes)), pa.array(total)], ["cls", "use"])

        known = counts.filter((F.col("c") > 0) & (F.col("token") != END))
        use = np.zeros(p.classes)
        for row in known.mapInArrow(run, "cls long, use double").groupBy("cls").agg(F.sum("use").alias("use")).collect():
            use[row["cls"]] = row["use"]
        smooth = use + p.start  # one more piece in all, dealt by the scores
        whole = smooth.sum() + texts + 1e-3
        mass, end = smooth / whole, (texts + 1e-3) / whole
        held.unpersist()
    return mass, end


def with_marginals(counts: DataFrame, p: Pieces, mass: np.ndarray, end: float) -> DataFrame:
    """token, c, q (natural log of its marginal over all segmentations)."""
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast((p, mass))
    starts = float(sum(mass[p.cls[k]] * p.share[k] for k in p.initial.values()))
    of_end = math.log(end / (starts + end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*held.value)
        for many in gathered(batches):
            words = many.column(0).to_pylist()
            q = lattice.marginals(words)
            q[[k for k, w in enumerate(words) if w == END]] = of_end
            yield from many.append_column("q", pa.array(q)).combine_chunks().to_batches()

    return counts.mapInArrow(run, "token binary, c long, q double")


def score(docs: DataFrame, vocabulary: str, mod: int = 10, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    ``vocabulary`` is the path of a sentencepiece file on the driver; texts whose checksum of the id ``mod`` divides are held out.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), mod).alias("held_out"))
    counts = written(token_counts(own), "lm-counts")
    t, p = totals(counts), pieces_of(vocabulary)
    mass, end = calibrated(counts, p, t.texts)
    lexicon = written(with_marginals(counts, p, mass, end), "lm-lexicon")
    drop_shared(spark, counts)
    theta, all_ = t.theta, t.n + t.theta
    few = lexicon.filter((F.col("c") * common >= t.n) & (F.col("c") > 0) & (F.octet_length("token") <= ARRAY))
    # at most ``common`` tokens of at most ARRAY bytes
    table = {bytes(r.token): (r.c, r.q) for r in few.select("token", "c", "q").collect()}
    of_end = table.get(END)
    if of_end is None:
        at = lexicon.filter(F.col("token") == END).select("c", "q").first()
        starts = float(sum(mass[p.cls[k]] * p.share[k] for k in p.initial.values()))
        of_end = (at.c, at.q) if at else (0, math.log(end / (starts + end)))
        table[END] = of_end

    def terms(c: int, q: float) -> tuple[bool, float, float, float]:
        return c > 0, t.base(c), math.log10((c + theta * math.exp(q)) / all_) if c or q > -700 else (math.log(theta / all_) + q) / LN10, q / LN10

    known = spark.sparkContext.broadcast({w: terms(c, q) for w, (c, q) in table.items()})
    kind = docs.schema[id_col].dataType.simpleString()

    names = ["row", "token", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "lattice"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), to_arrow_type(docs.schema[id_col].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, under a token that no text has, and one for each of its tokens that is not common."""
        near, out = known.value, [[] for _ in names]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
            for v in out:
                v.clear()
            return made

        for batch in batches:
            rows, ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for row, doc, text, is_held in zip(rows, ids, batch.column(2), held, strict=True):
                words = words_of(text.as_py())
                found = Counter(words)
                found[END] = 1
                k, b, s, q, far, tf = 0, 0.0, 0.0, 0.0, [b"\n" + str(row).encode()], [0]
                for w, m in found.items():
                    e = near.get(w)
                    if e is None:
                        far.append(w)
                        tf.append(m)
                    else:
                        k += m * e[0]
                        b += m * e[1]
                        s += m * e[2]
                        q += m * e[3]
                rest = [None] * (len(far) - 1)
                for v, first in zip(out[3:], (doc, is_held, len(words) + 1, k, b, s, q), strict=True):
                    v.append(first)
                    v.extend(rest)
                out[0].extend([row] * len(far))
                out[1].extend(far)
                out[2].extend(tf)
                if len(out[0]) > 1 << 16:
                    yield flush()
        if out[0]:
            yield flush()

    read = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    sent = read.mapInArrow(run, f"row long, token binary, tf long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, lattice double")
    met = sent.join(lexicon, "token", "left")
    c, q, tf = F.coalesce("c", F.lit(0)), F.col("q"), F.col("tf")
    mixed = F.when((c > 0) | (q > -700), F.log10((c + theta * F.exp(q)) / all_)).otherwise((math.log(theta / all_) + q) / LN10)
    base = F.log10((c + 0.1) / (t.n + 0.1 * (t.distinct + 1)))
    whole = F.col("tf") == 0
    each = met.select(
        "row", "doc_id", "held_out", "n_tokens", F.when(whole, F.col("n_known")).otherwise(F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        F.when(whole, F.col("base")).otherwise(tf * base).alias("base"), F.when(whole, F.col("score")).otherwise(tf * mixed).alias("score"), F.when(whole, F.col("lattice")).otherwise(tf * q / LN10).alias("lattice"),
    )
    by_row = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *[F.sum(k).alias(k) for k in ("n_known", "base", "score", "lattice")])
    return by_row.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.col("lattice").alias("lattice_score"))
