"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101001011`` hashes the tokens under its ones and ignores the others, so a passage in
which single tokens were replaced still shares hashes with the benchmark item. Hashes of all benchmark
windows meet hashes of all document windows; around every hit the item is laid over the document on
the hit's diagonal (and its neighbours, for a token put in or left out) and the tokens that agree are
counted. A document is contaminated by an item when at least ``similarity`` of the item's tokens agree, or, of
an item longer than ``WINDOW`` tokens, at least ``similarity`` of the tokens of some window of ``WINDOW`` of its tokens:
a passage that is cut out of a long item is found, too, however long the rest of the item is.

The benchmark is a stated query set. It is read in blocks of at most ``block_bytes`` of text; only a
block, whose size is checked, is ever broadcast, and each block is run against all documents. No
document text is shuffled.

Tokens are runs of letters and digits, lower-cased. Items shorter than a mask use one contiguous window
over all their tokens. Defined results: null or blank texts on either side match nothing; an item
without tokens matches nothing; equal best places go to the earliest; repeated rows give repeated
findings; null doc_ids keep their rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.llm.textvec import ALNUM, BASE, Words, chunks, mix

MASKS = ("111111", "1101001011", "1011010011", "1100110101", "1010011101")
BAND = 8
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
WINDOW = 50  # tokens of an item within which a part of it is judged by itself


def windows(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of the mask that lies inside one text."""
    span = len(mask)
    if len(words.hash) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words.hash) - span + 1
    h = np.full(n, len(mask) * 1000003 + int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j, one in enumerate(mask):
            if one == "1":
                h = h * BASE + words.hash[j : j + n]
    ok = words.doc[:n] == words.doc[span - 1 :]
    at = np.flatnonzero(ok)
    return at, mix(h[at])


class Seeds:
    """Every window hash of a block of items, with a bit table in front of the binary search."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        w = Words([lowered(t) for _, t in items], ALNUM)
        self.tokens = [w.hash[a : a + c] for a, c in zip(w.at, w.count, strict=True)]
        longest = max(map(len, MASKS))
        shorts = sorted({int(c) for c in w.count if 0 < c < longest})
        self.masks = [*MASKS, *("1" * c for c in shorts if "1" * c not in MASKS)]
        hashes, item, offset = [], [], []
        for mask in self.masks:
            at, h = windows(w, mask)
            whole = mask in MASKS
            keep = np.ones(len(at), bool) if whole else w.count[w.doc[at]] == len(mask)
            hashes.append(h[keep])
            item.append(w.doc[at][keep])
            offset.append((at - w.at[w.doc[at]])[keep])
        self.hash, self.item, self.offset = map(np.concatenate, (hashes, item, offset))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.offset = self.hash[order], self.item[order], self.offset[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hash >> np.uint64(64 - TABLE_BITS)] = True

    def hits(self, words: Words) -> np.ndarray:
        """Rows (item, text, diagonal), each once."""
        out = []
        for mask in self.masks:
            at, h = windows(words, mask)
            maybe = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            at, lo = np.repeat(at, n), np.repeat(lo, n)
            k = lo + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            doc = words.doc[at]
            out.append(np.column_stack([self.item[k], doc, at - words.at[doc] - self.offset[k]]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def densest(agree: np.ndarray, window: int) -> tuple[int, int]:
    """(agreeing tokens, first token) of the first window of an item in which most tokens agree; (0, 0) where the item is no longer than a window."""
    if len(agree) <= window:
        return 0, 0
    sums = np.concatenate([[0], np.cumsum(agree)])
    each = sums[window:] - sums[:-window]
    at = int(np.argmax(each))
    return int(each[at]), at


def overlaps(seeds: Seeds, words: Words, similarity: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text, item, agreeing tokens, first byte, last byte, item tokens, most agreeing tokens of a window) of every contaminated pair."""
    found = seeds.hits(words)
    i = 0
    while i < len(found):
        item, doc = found[i, 0], found[i, 1]
        j = i
        best, part = (0, 0, 0), (0, 0, 0)
        mine = seeds.tokens[item]
        theirs = words.hash[words.at[doc] : words.at[doc] + words.count[doc]]
        while j < len(found) and found[j, 0] == item and found[j, 1] == doc:
            agree = np.zeros(len(mine), bool)
            where = np.zeros(len(mine), np.int64)  # the token of the text that agrees
            start = found[j, 2]
            while j < len(found) and found[j, 0] == item and found[j, 1] == doc and found[j, 2] - start <= BAND:
                d = found[j, 2]
                a, b = max(0, -d), min(len(mine), len(theirs) - d)
                if b > a:
                    same = np.flatnonzero(mine[a:b] == theirs[a + d : b + d]) + a
                    if len(same):
                        where[same] = np.where(agree[same], np.minimum(where[same], same + d), same + d)
                        agree[same] = True
                j += 1
            if agree.any():
                at = where[agree]
                best = max(best, (len(at), -int(at.min()), int(at.max())))
                n, k = densest(agree, window)
                if n:
                    at = where[k : k + window][agree[k : k + window]]
                    part = max(part, (n, -int(at.min()), int(at.max())))
        whole = best[0] and best[0] >= similarity * len(mine)
        if whole or (part[0] and part[0] >= similarity * window):
            a, (_, first, last) = words.at[doc], best if whole else part
            base = words.first[doc]
            yield int(doc), int(item), best[0], int(words.start[a - first] - base), int(words.end[a + last] - base), len(mine), part[0]
        i = j


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes``; a block is picked by hash, so none depends on another."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if rows := part.collect():
            yield [(r.item_id, r.text) for r in rows]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, item_id, n_agree, n_item, n_window (most agreeing tokens of a window of the item; 0 for items no longer than one), similarity (n_agree / n_item), start, end (bytes of the
    lower-cased text; of the window where the whole item does not suffice) and mark (hash of the text, which tells rows of one id apart) of contaminated pairs."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_type = to_arrow_type(kinds[1])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, n_agree long, n_item long, n_window long, start long, end long, mark long"
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    parts = []
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(shared.value)
            for batch in batches:
                texts, rows = [lowered(t) for t in batch.column(1).to_pylist()], []
                for a, b in chunks([len(t) for t in texts]):
                    words = Words(texts[a:b], ALNUM)
                    rows += [(a + doc, *rest) for doc, *rest in overlaps(seeds, words, similarity, window)]
                where = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), pa.array([seeds.ids[r[1]] for r in rows], item_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 5, 6, 3, 4)), batch.column(2).take(where)],
                    ["doc_id", "item_id", "n_agree", "n_item", "n_window", "start", "end", "mark"],
                )

        parts.append(read.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema + ", similarity double")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("similarity", F.col("n_agree") / F.col("n_item"))
