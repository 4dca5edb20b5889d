"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives every shingle a random permutation of the signature's slots and ranks that rise along
it; a slot keeps its smallest rank. Ranks of one shingle are correlated over the slots, which lowers the
variance against independent hashes, and a text is done as soon as no later step can lower a slot.

Work is linear in copies:

1. Texts with equal shingle sets are one class from the start (combined before any shuffle).
2. *Attachment* passes: every bucket of equal band keys has one leader (its smallest member by some
   hash, an ordinary minimum, so no bucket is ever gathered). Every text that is not yet connected with
   a leader is verified against the most similar one by signature. Verified links merge components.
3. *Closure*: buckets that still hold several components are dealt into tiles of bounded size, in which
   members outside the largest component meet each other and that component. Pairs whose signatures rule out
   the threshold (four standard deviations) are passed over, the others are verified inside the tile, best
   first, unless their components have merged. A tile returns links only, never pairs.

A link between two texts can be missed only where two components stay apart, so only pairs across
components are ever looked for; nothing is capped. With 25 bands of 5 slots a pair of similarity 0.85
shares no band with probability 4e-7, one of 0.8 with 5e-5.

Pairs that share a band but whose signatures differ in more slots than ``most_differing`` allows (a chance below 1 in
10,000 at the threshold, and only where no other chain of links joins the two) are not compared; with ``exact`` all pairs that
share a band are.

Classes are known by a number of their own, so ids may be of any type and repeat.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than a
shingle make the whole sequence one shingle; rows of one id with different texts are different documents, a repeated
row is one with the first; rows with a null id have no
component, link with nothing and are kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.components import components
from corvine.llm.textvec import BASE, Words, chunks, mix, shingles
from corvine.storage import written

SLOTS = 128
BANDS, ROWS = 25, 5
SLICE = 1 << 17
TILE = 128  # members of a block in the closure
STEP = np.uint64(0xD1342543DE82EF95)
SKETCH = [f"s{i}" for i in range(SLOTS // 16)]


def superminhash(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x SLOTS, uint32) of sets given as (set number, element hash), by sets in order.

    A value is step * 2**24 plus 24 random bits. Elements go step by step through a Fisher-Yates
    shuffle of the slots; one takes part only while its step can still lower a slot of its set.
    """
    sig = np.full((n, SLOTS), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    start = np.arange(SLOTS, dtype=np.uint8)
    for a in range(0, len(h), SLICE):
        x, d = h[a : a + SLICE], doc[a : a + SLICE]
        lo, hi = int(d[0]), int(d[-1]) + 1
        perm = np.broadcast_to(start, (len(x), SLOTS)).copy()
        rows = np.arange(len(x))
        for j in range(SLOTS):
            worst = sig[lo:hi].max(1)
            rows = rows[worst[d[rows] - lo] >= (j << 24)]
            if not len(rows):
                break
            with np.errstate(over="ignore"):
                z = mix(x[rows] + np.uint64(j + 1) * STEP)
            k = j + ((z & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS - j)).astype(np.int64)
            slot = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            np.minimum.at(flat, d[rows] * SLOTS + slot, ((z >> np.uint64(40)) | np.uint64(j << 24)).astype(np.uint32))
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    out = np.empty((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            k = np.full(len(sig), b + 1, np.uint64)
            for r in range(ROWS):
                k = mix(k * BASE + sig[:, b * ROWS + r].astype(np.uint64))
            out[:, b] = k
    return out.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """n x 8 words of sixteen 4-bit slots: two sketches agree in a slot with the similarity plus chance."""
    nib = mix(sig.astype(np.uint64)) & np.uint64(15)
    out = np.zeros((len(sig), SLOTS // 16), np.uint64)
    for i in range(16):
        out |= nib[:, i::16] << np.uint64(4 * i)
    return out.view(np.int64)


def differing(a: str, b: str) -> Column:
    """Number of 4-bit slots in which two sketches differ."""
    total = F.lit(0)
    for s in SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, set1, set2 (hashes of the set), bands, s0..s7; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column(2).to_pylist()]
            for a, b in chunks([len(t) for t in texts]):
                d, h = shingles(Words(texts[a:b]))
                n = b - a
                count = np.bincount(d, minlength=n)
                at = np.cumsum(count) - count
                some = np.flatnonzero(count)
                set1, set2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        set1[some] = np.add.reduceat(mix(h), at[some])
                        set2[some] = np.add.reduceat(mix(h ^ STEP), at[some])
                sig = superminhash(d, h, n)
                keys, sk = band_keys(sig), sketches(sig)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(count, pa.int64()), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)), pa.array(keys.tolist(), pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(sk[:, i])) for i in range(len(SKETCH)))],
                    ["doc_id", "mark", "n_shingles", "set1", "set2", "bands", *SKETCH],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, n_shingles long, set1 long, set2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b and further columns) with inter and total, from the full shingle sets of both texts."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", *rest, "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            held: dict = {}
            for side in (0, 1):
                col = batch.column(n - 2 + side)
                for i, k in enumerate(ids[side]):
                    if k not in held:
                        held[k] = (col[i].as_py() or b"").lower()
            names, texts_ = list(held), list(held.values())
            sets = {}
            for a, b in chunks([len(t) for t in texts_]):
                d, h = shingles(Words(texts_[a:b]))
                cut = np.searchsorted(d, np.arange(b - a + 1))
                for i in range(b - a):
                    sets[names[a + i]] = h[cut[i] : cut[i + 1]]
            inter = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(*ids, strict=True)]
            total = [len(sets[x]) + len(sets[y]) - i for x, y, i in zip(*ids, inter, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(inter, pa.int64()), pa.array(total, pa.int64())], [*batch.schema.names[: n - 2], "inter", "total"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name not in ("text_a", "text_b")) + ", inter long, total long"
    return met.mapInArrow(run, schema)


def relabelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (id, comp) after merging the components that ``found`` (ca, cb) links."""
    moved = components(found.select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    joined = nodes.join(moved, F.col("comp") == F.col("vertex"), "left")
    return written(joined.select("id", F.coalesce("component", "comp").alias("comp")), "near-nodes")


def linked(percent: int) -> Column:
    return (F.col("total") > 0) & (100 * F.col("inter") >= percent * F.col("total"))


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, mark (hash of the text), kept: one row per row of ``docs``."""
    base = written(signatures(docs, id_col, text_col), "near-signatures")
    sets = ["set1", "set2", "n_shingles"]
    first = base.filter("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    classes = written(first.select(*sets, F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("rep_mark"), F.monotonically_increasing_id().alias("id")), "near-classes")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in sets]
    cond = same[0] & same[1] & same[2] & (F.col("x.doc_id") == F.col("y.rep")) & (F.col("x.mark") == F.col("y.rep_mark"))
    reps = base.alias("x").join(classes.alias("y"), cond).select("y.id", "x.bands", *[f"x.{s}" for s in SKETCH]).dropDuplicates(["id"])
    # members of buckets with company: everything below starts from these
    rows = reps.select("id", F.posexplode("bands").alias("band", "key")).select("id", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    member = written(rows.join(shared, "bucket"), "near-members")
    ids = member.select("id").distinct()
    sketch = written(reps.join(ids, "id").select("id", "bands", *SKETCH), "near-sketches")
    source = docs.select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("rep_mark"), F.col(text_col).cast("binary").alias("text"))
    wanted = classes.join(ids, "id", "left_semi").select("id", "rep", "rep_mark")
    texts = written(source.join(wanted, ["rep", "rep_mark"]).select("id", "text").dropDuplicates(["id"]), "near-texts")
    nodes = sketch.select("id", F.col("id").alias("comp"))
    most = SLOTS if exact else most_differing(percent)

    # attachment: longer keys first, as they single out the most similar texts
    for width, salt in ((4, 0), (2, 1), (1, 2)):
        nodes = attached(nodes, sketch, texts, width, salt, most, percent)

    nodes = closed(nodes, member, sketch, texts, most, percent)

    labelled = classes.join(nodes, "id", "left").select(*sets, "rep", F.coalesce("comp", "id").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = base.join(labelled.join(least, "comp").select(*sets, F.col("component_id").alias("least")), sets, "left")
    out = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "mark")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def closed(nodes: DataFrame, member: DataFrame, sketch: DataFrame, texts: DataFrame, most: int, percent: int) -> DataFrame:
    """Merge the components that a link still joins.

    Only buckets with several components matter. Their members are dealt into tiles of at most two blocks of
    ``TILE``: the members outside the bucket's largest component meet each other and that component. A tile compares
    sketches, verifies candidate pairs on full sets from the most similar on, skips pairs that are connected
    by then, and returns the links it needed: never more rows than it has members.
    """
    state = member.join(nodes, "id")
    sizes = state.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("comps"))
    main = main.filter("comps > 1").select("bucket", "main", F.ceil(F.col("n_main") / TILE).cast("int").alias("mb"), F.ceil((F.col("n") - F.col("n_main")) / TILE).cast("int").alias("sb"))
    crowd = state.join(main, "bucket").withColumn("apart", F.col("comp") != F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("apart"), F.col("sb")).otherwise(F.col("mb"))).cast("int")
    crowd = written(crowd.withColumn("block", block).select("bucket", "band", "id", "comp", "apart", "block", "mb", "sb"), "near-crowd")
    # tile (i, j): block i apart with block j apart, i <= j; tile (i, -1 - j): block i apart with block j of the largest component
    spot = "struct<i:int,j:int,side:int>"
    mine = F.col("block")
    others = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"), F.when(k < mine, 1).otherwise(0).alias("side")))
    mains = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda k: F.struct(mine.alias("i"), (-1 - k).alias("j"), F.lit(0).alias("side")))
    met_by = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda k: F.struct(k.alias("i"), (-1 - mine).alias("j"), F.lit(1).alias("side")))
    spots = F.when(F.col("apart"), F.concat(others.cast(f"array<{spot}>"), mains.cast(f"array<{spot}>"))).otherwise(met_by.cast(f"array<{spot}>"))
    tiles = crowd.select("bucket", "band", "id", "comp", F.explode(spots).alias("t")).select("bucket", "band", "id", "comp", "t.i", "t.j", "t.side")
    full = tiles.join(sketch, "id").join(texts, "id")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "band", "id", "comp", "side", "bands", "text", *SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ca", "cb"]
        held = None
        for batch in batches:
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            keys = np.column_stack([held.column(k).to_numpy() for k in ("bucket", "i", "j")])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(cut):
                continue
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in _tiles(held.slice(0, cut[-1]), cut[:-1], most, percent)], schema=link)
            held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in _tiles(held, np.zeros(0, np.int64), most, percent)], schema=link)

    link = pa.schema([("ca", pa.int64()), ("cb", pa.int64())])
    return relabelled(nodes, dealt.mapInArrow(run, "ca long, cb long"))


def _tiles(rows: pa.Table, cut: np.ndarray, most: int, percent: int) -> Iterator[tuple]:
    """Links (two components) that tiles of consecutive rows need."""
    bands = np.array(rows.column("bands").to_pylist(), np.int64).reshape(rows.num_rows, -1)
    words = np.column_stack([rows.column(s).to_numpy() for s in SKETCH]).view(np.uint64)
    side, band = rows.column("side").to_numpy(), rows.column("band").to_numpy()
    within = rows.column("j").to_numpy() == rows.column("i").to_numpy()
    comp, ids, text = rows.column("comp").to_pylist(), rows.column("id").to_pylist(), rows.column("text")
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), rows.num_rows], strict=True):
        n = b - a
        if n < 2:
            continue
        number = {c: k for k, c in enumerate(dict.fromkeys(comp[a:b]))}
        if len(number) < 2:
            continue
        c = np.array([number[x] for x in comp[a:b]])
        ok = np.triu(c[:, None] != c[None, :], 1)
        if not within[a]:
            ok &= side[a:b, None] != side[None, a:b]
        x, y = np.nonzero(ok)
        w = words[a + x] ^ words[a + y]
        w |= w >> np.uint64(1)
        w |= w >> np.uint64(2)
        d = np.bitwise_count(w & np.uint64(0x1111111111111111)).sum(1)
        near = np.flatnonzero(d <= most)
        # the first band that a pair shares is the one that looks at it
        first = (bands[a + x[near]] == bands[a + y[near]]).argmax(1)
        near = near[first == band[a]]
        if not len(near):
            continue
        near = near[np.argsort(d[near], kind="stable")]
        parent = list(range(len(number)))

        def root(k: int, parent: list[int] = parent) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        sets: dict[int, np.ndarray] = {}
        need = np.unique(np.concatenate([x[near], y[near]])).tolist()
        bodies = [(text[a + k].as_py() or b"").lower() for k in need]
        for s, e in chunks([len(t) for t in bodies]):
            doc, h = shingles(Words(bodies[s:e]))
            at = np.searchsorted(doc, np.arange(e - s + 1))
            for k in range(e - s):
                sets[need[s + k]] = h[at[k] : at[k + 1]]
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            p, q = root(int(c[i])), root(int(c[j]))
            if p == q:
                continue
            m, k = len(sets[i]), len(sets[j])
            if 100 * min(m, k) < percent * max(m, k):
                continue
            inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if inter and 100 * inter >= percent * (m + k - inter):
                parent[q] = p
                yield comp[a + i], comp[a + j]


def most_differing(percent: int) -> int:
    """Differing 4-bit slots that a pair at the threshold exceeds with a chance below 1 in 10,000."""
    agree = percent / 100 + (1 - percent / 100) / 16
    return int(SLOTS * (1 - agree) + 4 * (SLOTS * agree * (1 - agree)) ** 0.5) + 1


def attached(nodes: DataFrame, sketch: DataFrame, texts: DataFrame, width: int, salt: int, most: int, percent: int) -> DataFrame:
    """One pass: every text is verified against the most similar leader outside its component."""
    keys = sketch.select("id", F.posexplode("bands").alias("band", "key"))
    if width > 1:  # several bands together
        keys = keys.groupBy("id", F.floor(F.col("band") / width).alias("band")).agg(F.sort_array(F.collect_list(F.struct("band", "key"))).alias("key"))
    keys = keys.select("id", F.xxhash64("band", "key").alias("bucket"))
    order = F.xxhash64("id", F.lit(salt)) if salt else F.lit(0).cast("long")
    leader = keys.groupBy("bucket").agg(F.min_by("id", F.struct(order, "id")).alias("leader"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket", "leader")
    pairs = keys.join(leader, "bucket").filter("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    sa = sketch.drop("bands").join(nodes, "id").alias("x")
    sb = sketch.drop("bands").join(nodes, "id").alias("y")
    near = pairs.join(sa, F.col("a") == F.col("x.id")).join(sb, F.col("b") == F.col("y.id")).filter(F.col("x.comp") != F.col("y.comp"))
    near = near.select("a", "b", F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"), differing("x", "y").alias("d")).filter(F.col("d") <= most)
    best = near.groupBy("a").agg(F.min(F.struct("d", "b", "ca", "cb")).alias("m")).select("a", "m.b", "m.ca", "m.cb")
    checked = verified(written(best, "near-attach"), texts)
    return relabelled(nodes, checked.filter(linked(percent)))
