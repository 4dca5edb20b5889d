"""Importance resampling towards a target: documents that look like the target's texts are drawn more often.

1. Features of a text are its words and pairs of neighbouring words, hashed into ``buckets``. Both sides are counted:
   every task adds its own texts into one array, so a task sends at most one number per bucket.
2. A bucket's *gain* is the scaled log ratio of its smoothed shares. The gains are one array of fixed length; a document's
   weight is the floored mean over its features, read by array index.
3. The score adds Gumbel noise that depends on seed and id alone, so the highest scores are a draw without replacement
   with probabilities that follow the weights.
4. The draw is exact and without a global sort. Scores are whole numbers in a bounded range: their histogram, summed from
   the top, gives every score the rank at which it starts and finds the cutoff score. Only rows that reach the cutoff go
   on; ``row_number`` by id within a score gives the rank, and cuts the last score where the draw is full.

The histogram has at most one row per score. Weights lie between -1000*ln and +1000*ln of the number of features
and noise between -3,100 and +22,900, so these are some 100,000 rows whatever the input, and they may be broadcast.

Defined results: null and blank texts have no feature, weight 0 and are never drawn; a word is a run of digits, ASCII letters and
characters outside ASCII; a null id has the noise of an empty one and is the last of a tie; rows with equal score and id
(repeated rows) are ordered by number of features and hash of the text; ranks stay distinct; further columns are ignored;
without target texts every gain follows the corpus alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.storage import written

BUCKETS = 10_000
#: Every byte that is part of no word becomes a space; A-Z become a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are split into words at a time.
PART = 1 << 22


def parts(folded: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time, so that a very long text needs no list of all its words."""
    at = 0
    while at < len(folded):
        stop = len(folded) if len(folded) - at <= PART else folded.find(b" ", at + PART)
        stop = len(folded) if stop < 0 else stop
        yield folded[at:stop].split()
        at = stop


def features(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all words and neighbouring pairs of a text, in arrays of bounded size."""
    crc, last = zlib.crc32, None
    for words in parts(text.encode().translate(FOLD)):
        if not words:
            continue
        own = list(map(crc, words))
        # the checksum of "a b" is that of " b" carried on from a's
        lead = [crc(b" ", c) for c in own]
        pairs = list(map(crc, words[1:], lead))
        if last is not None:
            pairs.append(crc(words[0], last))
        last = lead[-1]
        yield np.array(own + pairs, np.int64) % buckets


def counted(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. Tasks send sums, and only ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in features(text.as_py() or "", buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Whole gain of each bucket; both sides are smoothed by one occurrence per bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(source, target, strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int = 7, scale: int = 1000) -> Column:
    """Whole Gumbel noise of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, mark (hash of the text) of every row. The array of gains goes along with the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(gain)
        for batch in batches:
            n, w = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                total = 0
                for found in features(text.as_py() or "", k):
                    n[i] += len(found)
                    total += int(gain[found].sum())
                w[i] = total // int(n[i]) if n[i] else 0
            words = (n + 1) // 2  # m words have m - 1 pairs
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(w), batch.column(2)], ["doc_id", "n_words", "n_features", "weight", "mark"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return read.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, mark long")


def offsets(scored: DataFrame) -> tuple[list[tuple[int, int, int]], int]:
    """((score, its rows, rows of higher scores), from the highest score down), number of rows. One row per score comes to the driver."""
    rows = sorted(((r["score"], r["n"]) for r in scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    out, above = [], 0
    for score, n in rows:
        out.append((score, n, above))
        above += n
    return out, above


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where a row is not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` per cent (rounded down) are drawn.
    """
    spark = docs.sparkSession
    gain = gains(counted(docs, text_col, buckets), counted(target, target_text, buckets))
    scored = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "resample-scores")
    steps, n = offsets(scored.filter(F.col("n_words") >= least_words))
    draw = percent * n // 100
    kept = [(score, above) for score, _, above in steps if above < draw]
    table = spark.createDataFrame(kept, "score long, above long")
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(kept[-1][0] if kept else 0)) & F.lit(draw > 0)
    # the scores of the drawn are one row each in the table of offsets, which is bounded by the range of scores
    met = scored.filter(drawn).join(F.broadcast(table), "score")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "mark"))
    ranked = met.withColumn("rank", (F.col("above") + within).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")).unionByName(rest)
