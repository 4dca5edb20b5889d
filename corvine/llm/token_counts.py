"""Token counts by the whole-token shortcut.

Most words of a text are vocabulary strings that a byte-pair encoder turns into exactly one token.
Which vocabulary strings behave so is *proved* once, before any text is read: a string qualifies when
the splitting pattern leaves it whole and its own merges end in a single symbol. Counting then means
splitting a text and adding 1 for every proven string; only the others go through the merges.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
further columns of the input are not touched and none of their names is used.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of the vocabulary, white space written out by the Unicode property.
_WS = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{L}+|\x20?\p{N}+|\x20?[^"
    + _WS
    + r"\p{L}\p{N}]+|["
    + _WS
    + r"]+(?![^"
    + _WS
    + r"])|["
    + _WS
    + r"]+"
)
#: Entries a worker remembers beyond the proven strings before it forgets them all.
REMEMBER = 300_000
LONG = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Merge ranks, the strings proven to be one token, and special strings (one token wherever they occur)."""

    ranks: dict[tuple[str, str], int]
    single: list[str]
    special: list[str]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merges by rank, leftmost first; a heap over a linked list, so long words stay n log n."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return [s for s in symbols if s]


def prove(path: str) -> Vocabulary:
    """Read a byte-level BPE file and prove which of its strings encode alone as one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
    ranks = {p: i for i, p in enumerate(pairs)}
    special = [t["content"] for t in spec["added_tokens"] if t["special"]]
    byte_of = {c: b for b, c in byte_letters().items()}
    split, single = regex.compile(PATTERN), []
    for shown in spec["model"]["vocab"]:
        if shown in special:
            continue
        try:
            text = bytes(byte_of[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a whole pre-token
        if split.findall(text) == [text] and len(merged(list(shown), ranks)) == 1:
            single.append(text)
    return Vocabulary(ranks, single, special)


class Costs(dict):
    """Pre-token to token count: proven strings from the start, others merged when first met."""

    def __init__(self, v: Vocabulary):
        super().__init__(dict.fromkeys(v.single, 1))
        self.v, self.letters, self.base = v, byte_letters(), len(v.single)

    def __missing__(self, word: str) -> int:
        n = len(merged([self.letters[b] for b in word.encode()], self.v.ranks))
        if len(self) >= self.base + REMEMBER:
            self.clear()
            self.update(dict.fromkeys(self.v.single, 1))
        if len(word) <= 64:
            self[word] = n
        return n


_kept: dict[str, Costs] = {}


def counter(v: Vocabulary, key: str):
    """A function text -> token count; the table of a vocabulary is built once per Python worker."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Costs(v)
    costs, split = _kept[key], regex.compile(PATTERN)
    apart = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None

    def count(text: str) -> int:
        n = 0
        if apart is not None and any(s in text for s in v.special):
            parts = apart.split(text)
            n = len(parts) - 1
        else:
            parts = (text,)
        for part in parts:
            if len(part) <= LONG:
                n += sum(map(costs.__getitem__, split.findall(part)))
            else:  # without a list of all words
                n += sum(costs[m[0]] for m in split.finditer(part))
        return n

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    The vocabulary (bounded by the tokenizer file) is broadcast once; texts stay where they were read.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(prove(tokenizer_path))
    key = tokenizer_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary.value, key)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
