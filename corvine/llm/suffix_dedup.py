"""Repeated-passage removal: every byte covered by a ``length``-byte string that starts earlier too.

Sorting all suffixes of a corpus in one order means moving every suffix. Like induced sorting, this
operator first reduces the string to seeds chosen by its content, settles what the seeds settle, and
sorts suffixes only where that is left open:

1. *Seeds.* Every ``length``-byte window picks its seed: the ``GRAM``-byte string of smallest hash in it.
   Equal windows pick equal seeds at equal places, and neighbouring windows share one, so a text has
   about one seed in 35 bytes, each owning a run of consecutive windows and their context. Seeds are
   packed into byte columns and dealt by hash; equal (seed, context) pairs are combined in each task
   before that, so a text with very many copies is one seed per task.
2. *Settled seeds.* Of equal seeds with equal contexts all but the earliest repeat in all their windows.
   Where one seed has several contexts, as at the borders of a repeated passage, the earliest of each
   context stays open.
3. *Open seeds.* Their contexts are dealt into shards by seed, written to a file of the owner task and sorted by external
   induced sorting with disk-backed queues (``induced``), which carries common prefixes along; runs of suffixes
   whose common prefix reaches ``length`` are the
   equal windows, all but the earliest of which repeat. A seed with more than ``hot`` contexts is spread
   over several shards; each hands on one digest per distinct window, packed into byte columns and dealt by digest as
   seeds are, and the earliest of each digest settles them.
4. Each document receives its repeated intervals and is cut.

Equality of seeds and contexts is that of two independent 64-bit hashes over both (128 bits); equality in
step 3 is that of bytes. "Earlier" is a smaller doc_id, or a smaller start in the same document.

Documents are known by a number in the order of their ids. Whole-number ids that are unique are that number; other ids
(text, null, repeated) get one from a distributed sort of (id, SHA-256 of the text).

Defined results: null texts are empty; shorter texts than ``length`` lose nothing; a row that repeats id and text
is the same document and repeats nothing of it; rows of one id with different texts are different documents, in the order of their
SHA-256; rows with a null id come before all others, those with equal texts as one document; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm import induced
from corvine.llm.textvec import BASE, BYTE, chunks, mix, powers
from corvine.storage import written

LENGTH = 100
GRAM = 32
HOT = 1024
SHARD_BYTES = 2 << 20
WINDOWS = 1 << 20  # repeated windows of a shard that are merged at a time
FLUSH_SEEDS = 1_500_000
PIECE = 4 << 20
WINDOW = np.dtype([("d", "<u8", 2), ("doc", "<i8"), ("lo", "<i4")])
SEED = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("width", "<i2"), ("twin", "?")])


def seeds_of(texts: list[bytes], length: int, gram: int) -> np.ndarray:
    """Seeds of several texts; ``doc`` is the number of the text, ``lo`` the first window of ``width``."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size - 1
    n, spread = len(buf), length - gram + 1
    if n < length:
        return np.zeros(0, SEED)
    bp, ip = powers(n + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[buf] * ip[:n], out=s[1:])
        g = mix((s[gram:] - s[:-gram]) * bp[: n - gram + 1])
    # smallest of ``spread`` neighbours, leftmost on a tie, by doubling
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while 2 * reach <= spread:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < spread:
        least = np.minimum(least[: len(least) - (spread - reach)], least[spread - reach :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # seed of the window that starts here
    start = np.arange(len(at))
    doc = np.repeat(np.arange(len(texts)), size + 1)[: len(at)]
    ok = start + length <= (first + size)[doc]
    start, at, doc = start[ok], at[ok], doc[ok]
    if not len(start):
        return np.zeros(0, SEED)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    lead = np.flatnonzero(new)
    out = np.zeros(len(lead), SEED)
    lo, hi = start[lead], start[np.append(lead[1:], len(at)) - 1]
    seat = at[lead]
    end = hi + length
    with np.errstate(over="ignore"):
        context = (s[end] - s[lo]) * bp[lo]
        place = (seat - lo).astype(np.uint64) * np.uint64(1009) + (end - lo).astype(np.uint64)
        out["c"] = mix(context + mix(place * BASE))
    out["h"], out["doc"], out["lo"], out["width"] = g[seat], doc[lead], lo - first[doc[lead]], hi - lo + 1
    return out


def pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of the text, place in it, bytes): very long texts in parts that share ``length`` - 1 bytes.

    A seed's run of windows may then fall into two parts; their contexts differ from the whole one and stay open, which
    costs work and changes no result.
    """
    which, place, out = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            which.append(i)
            place.append(at)
            out.append(t[at : at + PIECE + length - 1] if len(t) > PIECE else t)
    return np.array(which, np.int64), np.array(place, np.int32), out


def packed(x: np.ndarray) -> bytes:
    """Seeds by document and place; the columns that rise slowly are deflated, twins need no hashes."""
    x = x[np.lexsort((x["lo"], x["doc"]))]
    body = zlib.compress(np.diff(x["doc"], prepend=0).tobytes() + x["lo"].tobytes() + x["width"].tobytes() + x["twin"].tobytes(), 1)
    once = x[~x["twin"]]
    return len(x).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body + once["h"].tobytes() + once["c"].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    n, m = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little")
    small = zlib.decompress(b[8 : 8 + m])
    x = np.zeros(n, SEED)
    x["doc"] = np.cumsum(np.frombuffer(small, np.int64, n))
    x["lo"] = np.frombuffer(small, np.int32, n, 8 * n)
    x["width"] = np.frombuffer(small, np.int16, n, 12 * n)
    x["twin"] = np.frombuffer(small, bool, n, 14 * n)
    once = np.flatnonzero(~x["twin"])
    x["h"][once] = np.frombuffer(b, np.uint64, len(once), 8 + m)
    x["c"][once] = np.frombuffer(b, np.uint64, len(once), 8 + m + 8 * len(once))
    return x


def marked_twins(x: np.ndarray) -> np.ndarray:
    """All but the earliest of equal (seed, context) pairs become twins; sorted by seed, context and place.

    The same pair at the same place of the same id comes from a repeated row; it is one seed and no twin of itself.
    """
    x = x[np.lexsort((x["lo"], x["doc"], x["c"], x["h"]))]
    if len(x) > 1:
        equal = (x["h"][1:] == x["h"][:-1]) & (x["c"][1:] == x["c"][:-1])
        again = equal & (x["doc"][1:] == x["doc"][:-1]) & (x["lo"][1:] == x["lo"][:-1])
        x["twin"][1:] |= equal
        if again.any():
            x = x[np.append(True, ~again)]
    return x


def deal(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(part, blob) rows of seeds, combined per task in runs of FLUSH_SEEDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            x = marked_twins(np.concatenate(held))
            part = (mix(x["h"]) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            blobs = [packed(x[by[cut[p] : cut[p + 1]]]) for p in some]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            which, place, texts = pieces([t or b"" for t in batch.column(1).to_pylist()], length)
            for a, b in chunks([len(t) for t in texts]):
                x = seeds_of(texts[a:b], length, gram)
                x["lo"] += place[a:b][x["doc"]]
                x["doc"] = ids[which[a:b]][x["doc"]]
                held.append(x)
                n += len(x)
                if n > FLUSH_SEEDS:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return docs.mapInArrow(run, "part int, blob binary")


def settle(blobs: list[bytes], length: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(settled intervals doc/start/end, open seeds, their salt) of one part."""
    x = np.concatenate([unpacked(b) for b in blobs])
    done, live = x[x["twin"]], x[~x["twin"]]
    by = np.argsort(live["h"], kind="stable")
    h = live["h"][by]
    near = np.zeros(len(h), bool)
    near[1:] = h[1:] == h[:-1]
    near[:-1] |= near[1:]
    live = marked_twins(live[by[near]])
    done = np.concatenate([done, live[live["twin"]]])
    live = live[~live["twin"]]
    h = live["h"]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    several = np.repeat(count > 1, count)
    group = np.repeat(count, count)
    salt = np.where(group > hot, 1 + (np.arange(len(h)) - np.repeat(at, count)) // hot, 0)
    return intervals(done["doc"], done["lo"].astype(np.int64), done["lo"].astype(np.int64) + done["width"] - 1 + length), live[several], salt[several]


def intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows doc, start, end in order, overlapping and touching ones merged."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    # running maximum of ends inside a document: shift each document above all before it
    top = int(end.max()) + 1
    step = np.cumsum(fresh) * top
    reach = np.maximum.accumulate(end + step)
    fresh[1:] |= (start + step)[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return np.column_stack([doc[at], start[at], reach[last] - step[last]])


def by_doc(rows: np.ndarray) -> tuple[list, list]:
    """(ids, packed start/end pairs) of interval rows in document order."""
    if not len(rows):
        return [], []
    cut = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
    ends = np.append(cut[1:], len(rows))
    return rows[cut, 0].tolist(), [rows[a:b, 1:].astype(np.int32).tobytes() for a, b in zip(cut, ends, strict=True)]


def settled(dealt: DataFrame, parts: int, length: int, hot: int = HOT) -> DataFrame:
    """doc, cuts (settled intervals), open (seed, first window, windows, salt) and the bytes of open contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(b)
        for p in sorted(held):
            done, live, salt = settle(held.pop(p), length, hot)
            ids, cuts = by_doc(done)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cuts, pa.binary()), pa.nulls(len(ids), pa.binary()), pa.array([0] * len(ids), pa.int64())], ["doc", "cuts", "open", "bytes"])
            by = np.lexsort((live["lo"], live["doc"]))
            live, salt = live[by], salt[by]
            rows = np.column_stack([live["h"].view(np.int64), live["lo"].astype(np.int64), live["width"].astype(np.int64), salt.astype(np.int64)])
            cut = np.flatnonzero(np.append(True, live["doc"][1:] != live["doc"][:-1])) if len(live) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(live))[: len(cut)]  # a part may have no open seed
            yield pa.RecordBatch.from_arrays(
                [pa.array(live["doc"][cut].tolist(), pa.int64()), pa.nulls(len(cut), pa.binary()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([int((live["width"][a:b].astype(np.int64) - 1 + length).sum()) for a, b in zip(cut, ends, strict=True)], pa.int64())],
                ["doc", "cuts", "open", "bytes"],
            )

    return dealt.repartitionById(parts, "part").mapInArrow(run, "doc long, cuts binary, open binary, bytes long")


def opened(docs: DataFrame, marks: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, salted, blob) rows of open contexts: records of doc, first window, windows, bytes."""
    wanted = marks.filter(F.col("open").isNotNull()).groupBy("doc").agg(F.collect_list("open").alias("open"))
    met = docs.join(wanted, "doc").select("doc", "text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, bool], list[bytes]] = {}
            for doc, text, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or b""
                rows = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 4)
                shard = (mix(rows[:, 0].view(np.uint64) ^ mix(rows[:, 3].view(np.uint64))) % np.uint64(shards)).tolist()
                head = np.int64(doc).tobytes()
                for s, (_, lo, width, salt) in zip(shard, rows.tolist(), strict=True):
                    body = text[lo : lo + width - 1 + length]
                    out.setdefault((s, salt > 0), []).append(head + np.array([lo, width], np.int32).tobytes() + body)
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([b"".join(out[k]) for k in keys], pa.binary())], ["shard", "salted", "blob"])

    return met.mapInArrow(run, "shard int, salted boolean, blob binary")


class Shard:
    """Contexts in a file of the task, a zero after each; rows doc, first window, windows, place in the file."""

    def __init__(self, disk: induced.Disk):
        self.paths, self.at = (disk.path(), disk.path()), 0

    def add(self, blob: bytes, length: int) -> None:
        rows, parts, i = [], [], 0
        while i < len(blob):
            lo, width = int.from_bytes(blob[i + 8 : i + 12], "little"), int.from_bytes(blob[i + 12 : i + 16], "little")
            rows.append((int.from_bytes(blob[i : i + 8], "little", signed=True), lo, width, self.at))
            parts.append(blob[i + 16 : i + 15 + width + length])
            i += 15 + width + length
            self.at += width + length
        with open(self.paths[0], "ab") as f:
            f.write(b"\0".join(parts) + b"\0")
        with open(self.paths[1], "ab") as f:
            np.array(rows, np.int64).tofile(f)

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        return np.memmap(self.paths[0], np.uint8, "r"), np.memmap(self.paths[1], np.int64, "r").reshape(-1, 4)


def equal_windows(shard: Shard, length: int, disk: induced.Disk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, doc, start and place in the text of windows; which is the earliest of its group; the text), whole groups at a time."""
    text, rows = shard.opened()
    begin = disk.array(len(text), bool)
    for a in range(0, len(rows), induced.BLOCK):
        place, width = rows[a : a + induced.BLOCK, 3], rows[a : a + induced.BLOCK, 2]
        begin[np.repeat(place, width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)] = True
    tuples = induced.suffixes(text, length, disk)
    places = np.array(rows[:, 3])
    held, group = np.zeros((0, 4), np.int64), 0
    for a in range(0, len(tuples), induced.BLOCK):
        part = np.asarray(tuples[a : a + induced.BLOCK])
        at = part >> induced.BITS
        groups = group + np.cumsum((part & induced.MASK) < length)
        group = int(groups[-1])
        ok = begin[at]
        at, groups = at[ok], groups[ok]
        own = np.searchsorted(places, at, "right") - 1
        found = np.concatenate([held, np.column_stack([groups, rows[own, 0], rows[own, 1] + at - places[own], at])])
        last = a + induced.BLOCK >= len(tuples)
        done = len(found) if last else int(np.searchsorted(found[:, 0], group))  # the last group may go on
        held, found = found[done:], found[:done]
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        # windows of a repeated row are one window
        found = found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(1))[: len(found)]]
        yield found, np.append(True, found[1:, 0] != found[:-1, 0])[: len(found)], text


def resolved(shards_: DataFrame, shards: int, length: int, parts: int) -> DataFrame:
    """Per shard: cuts of documents; from salted shards also the distinct windows (digest, doc, start), packed by part."""
    names = ["doc", "cuts", "part", "windows"]

    def cuts_of(again: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(again)
        ids, cuts = by_doc(intervals(x[:, 0], x[:, 1], x[:, 1] + length))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cuts, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)

    def windows_of(kept: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(kept)
        part = (x["d"][:, 0] % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [x[by[cut[p] : cut[p + 1]]].tobytes() for p in some]
        return pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with induced.Disk() as files:
            held: dict[tuple[int, bool], Shard] = {}
            for batch in batches:
                for s, salted, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (s, salted) not in held:
                        held[s, salted] = Shard(files)
                    held[s, salted].add(b, length)
            kept, many = [], 0
            for key in sorted(held):
                with induced.Disk() as disk:
                    again, n = [np.zeros((0, 2), np.int64)], 0
                    for found, best, text in equal_windows(held[key], length, disk):
                        again.append(found[~best, 1:3])
                        n += len(again[-1])
                        if n > WINDOWS:
                            yield cuts_of(again)
                            again, n = again[:1], 0
                        if key[1] and len(found):
                            keep = found[best]
                            x = np.zeros(len(keep), WINDOW)
                            x["d"] = np.frombuffer(b"".join(hashlib.blake2b(text[p : p + length], digest_size=16).digest() for p in keep[:, 3].tolist()), np.uint64).reshape(-1, 2)
                            x["doc"], x["lo"] = keep[:, 1], keep[:, 2]
                            kept.append(x)
                            many += len(x)
                            if many > WINDOWS:
                                yield windows_of(kept)
                                kept, many = [], 0
                    if n:
                        yield cuts_of(again)
            if many:
                yield windows_of(kept)

    return shards_.repartitionById(shards, "shard").mapInArrow(run, "doc long, cuts binary, part int, windows binary")


def later_windows(x: np.ndarray) -> np.ndarray:
    """Those windows of which an earlier one has the same digest."""
    x = x[np.lexsort((x["lo"], x["doc"], x["d"][:, 1], x["d"][:, 0]))]
    new = np.append(True, (x["d"][1:] != x["d"][:-1]).any(1))[: len(x)]
    first = x[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return x[(x["doc"] != first["doc"]) | (x["lo"] != first["lo"])]


def met_again(late: DataFrame, parts: int, length: int) -> DataFrame:
    """doc, cuts of the windows of salted shards that stand earlier, too, a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(b)
        for p in sorted(held):
            x = later_windows(np.frombuffer(b"".join(held.pop(p)), WINDOW))
            start = x["lo"].astype(np.int64)
            ids, cuts = by_doc(intervals(x["doc"], start, start + length))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cuts, pa.binary())], ["doc", "cuts"])

    return late.filter(F.col("windows").isNotNull()).select("part", "windows").repartitionById(parts, "part").mapInArrow(run, "doc long, cuts binary")


def numbered(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """doc (a number in the order of documents), id, text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if base.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        rows, ids = base.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if rows == ids:
            return base.select(F.col("id").cast("long").alias("doc"), "id", "text")
    hashed = base.withColumn("sha", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    order = hashed.select("id", "sha").distinct().repartitionByRange(parts, "id", "sha").sortWithinPartitions("id", "sha")
    number = written(order.select(F.monotonically_increasing_id().alias("doc"), F.col("id").alias("_id"), F.col("sha").alias("_sha")), "repeat-numbers")
    met = hashed.join(number, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    return written(met.select("doc", "id", "text"), "repeat-numbered")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = numbered(docs, id_col, text_col, parts)
    marks = written(settled(deal(source.select("doc", "text"), parts, length, gram), parts, length, hot), "repeat-marks")
    total = marks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(parts, -(-total // SHARD_BYTES))
    late = written(resolved(opened(source, marks, shards, length), shards, length, parts), "repeat-windows")
    every = marks.filter(F.col("cuts").isNotNull()).select("doc", "cuts").union(late.filter(F.col("cuts").isNotNull()).select("doc", "cuts")).union(met_again(late, parts, length))
    lists = every.groupBy("doc").agg(F.collect_list("cuts").alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                if not cuts:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                x = np.frombuffer(b"".join(cuts), np.int32).reshape(-1, 2).astype(np.int64)
                x = np.minimum(x, len(text))
                spans = intervals(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
                spans = spans[spans[:, 2] > spans[:, 1]]
                at, kept = 0, []
                for _, a, b in spans.tolist():
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            if keep_text:
                cols.append(pa.array([r[4] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols) + 1])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return source.join(lists, "doc", "left").select("id", "text", "cuts").mapInArrow(cut, schema)
