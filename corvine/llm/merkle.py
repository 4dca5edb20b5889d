"""A Merkle manifest of a data set: every row is a leaf with a proof against one root, made by fractal traversal.

Leaves of a group (a language) ascend by id; two neighbours become their parent, a lone last node becomes the hash of
itself, until one node, the group's root, remains. The groups' roots in order of the group make the data set's root.

1. Leaves are hashed where the rows lie; only digests, 32 bytes a row, are sorted and dealt out. They are numbered by
   a range sort and the counts of its partitions, so no task sees a whole group.
2. Numbers are cut into aligned *blocks* of 2**BLOCK leaves. A block is a complete subtree, so a task can work on it alone:
   first only its root is computed. Block roots are numbered leaves again, and so on until one is left per group
   (five rounds reach 2**40 leaves); the groups' roots go the same way.
3. Proofs within a block come from fractal traversal: the block's tree is cut into layers of subtrees HEIGHT levels
   high. Each layer holds its *existing* subtree, which contains the present leaf and so all its siblings of these levels, and its
   *desired* subtree, the next one, which is built by two steps per leaf and is ready exactly when it is needed. At most
   2 * BLOCK / HEIGHT * 2**(HEIGHT + 1) digests are held, whatever the length of the sequence.
4. The path from the block's root upwards is the same for all its leaves: it travels as one row per block, comes first in the
   block's stream, and is appended to each proof.

Defined results: a null is ``-`` in a leaf, and an empty string is ``0:``; a null id or group is the first of its order; rows
of one id are ordered by their leaf; equal rows have equal leaves at neighbouring numbers and each its own proof; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.storage import broadcast_if_small, written

BLOCK = 8
HEIGHT = 3
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(c: Column) -> Column:
    """Length in UTF-8 bytes, a colon and the value; ``-`` for a null."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """Digest (32 bytes) of a row."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def digest(*nodes: bytes) -> bytes:
    """Parent of nodes; a node is the 64 characters of its digest."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def parent(a: bytes | None, b: bytes | None) -> bytes | None:
    return None if a is None else digest(a) if b is None else digest(a, b)


def height_of(n: int, most: int = BLOCK) -> int:
    """Levels of a block's tree in a sequence of ``n`` nodes: all of them, unless the sequence is one block."""
    return min((n - 1).bit_length(), most)


class Subtree:
    """One subtree of a layer in the making: leaves from ``start`` on, root ``top`` levels up; nodes from level ``low`` on are kept."""

    def __init__(self, leaves: list[bytes], start: int, low: int, top: int):
        self.leaves, self.at, self.end, self.low, self.top = leaves, start, start + (1 << top), low, top
        self.stack: list[tuple[int, int, bytes | None]] = []
        self.nodes: dict[tuple[int, int], bytes | None] = {}

    def step(self) -> None:
        """One leaf read or one parent computed."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            level, place, b = s.pop()
            _, _, a = s.pop()
            level, place, node = level + 1, place >> 1, parent(a, b)
        elif self.at < self.end:
            level, place, node = 0, self.at, self.leaves[self.at] if self.at < len(self.leaves) else None
            self.at += 1
        else:
            return
        if self.low <= level < self.top:
            self.nodes[level, place] = node
        if level < self.top:
            s.append((level, place, node))

    def done(self) -> bool:
        return self.at == self.end and not self.stack


def root_of(leaves: list[bytes], height: int) -> bytes:
    """Root of a block by a stack of one node per level."""
    stack: list[tuple[int, bytes]] = []
    for node in leaves:
        level = 0
        while stack and stack[-1][0] == level:
            node, level = digest(stack.pop()[1], node), level + 1
        stack.append((level, node))
    level, node = stack.pop()
    while level < height:  # lone nodes rise until the next complete subtree joins them
        if stack and stack[-1][0] == level:
            node = digest(stack.pop()[1], node)
        else:
            node = digest(node)
        level += 1
    return node


def traversal(leaves: list[bytes], height: int, layer: int = HEIGHT) -> Iterator[list[bytes]]:
    """The siblings of every leaf in turn, lowest level first; levels at which a node is alone have none."""
    cuts = [(low, min(low + layer, height)) for low in range(0, height, layer)]
    existing, desired = [], []
    for low, top in cuts:
        first = Subtree(leaves, 0, low, top)
        while not first.done():
            first.step()
        existing.append(first.nodes)
        desired.append(Subtree(leaves, 1 << top, low, top))
    for p in range(len(leaves)):
        path = []
        for (low, top), nodes in zip(cuts, existing, strict=True):
            for level in range(low, top):
                node = nodes[level, (p >> level) ^ 1]
                if node is not None:
                    path.append(node)
        yield path
        for i, (low, top) in enumerate(cuts):
            if top == height:
                continue
            desired[i].step()
            desired[i].step()
            if (p + 1) % (1 << top) == 0:
                existing[i], desired[i] = desired[i].nodes, Subtree(leaves, p + 1 + (1 << top), low, top)


def fold(node: bytes, place: int, n: int, siblings: list[bytes]) -> bytes:
    """Root of a sequence of ``n`` nodes from the node at ``place`` and its siblings."""
    at = 0
    while n > 1:
        if place ^ 1 < n:
            other, at = siblings[at], at + 1
            node = digest(other, node) if place & 1 else digest(node, other)
        else:
            node = digest(node)
        place, n = place >> 1, (n + 1) >> 1
    return node


def split(joined: bytes) -> list[bytes]:
    """Nodes of concatenated 32-byte digests."""
    text = joined.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def packed(nodes: list[bytes]) -> bytes:
    return bytes.fromhex(b"".join(nodes).decode())


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (number within ``key`` by ``order``, from 0) and ``n`` (rows of the key).

    A range sort by key and order deals even one key's rows over all tasks; a table of one row per (partition, key) gives every partition the number it starts at.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "merkle-order").withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    heads = placed.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_rows").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_part", key, (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(by_key).alias("n"))
    return placed.join(broadcast_if_small(heads), ["_part", key]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def blocks(nodes: DataFrame, size: int) -> DataFrame:
    """``nodes`` (grp, idx, ...) so dealt and sorted that each block is a run of rows of one partition."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.withColumn("block", F.shiftright("idx", size)).repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "idx")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block at a time."""
    held, of = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["grp"], row["block"]) != of:
                yield held
                held = []
            of = (row["grp"], row["block"])
            held.append(row)
    if held:
        yield held


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


NODE = "grp long, idx long, n long, node binary"


def block_roots(nodes: DataFrame, size: int) -> DataFrame:
    """The next sequence: grp, idx, n, node of the root of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs(batches):
            n = rows[0]["n"]
            root = root_of([r["node"].hex().encode() for r in rows], height_of(n, size))
            out.append((rows[0]["grp"], rows[0]["block"], -(-n >> size), packed([root])))
            if len(out) == 4096:
                yield batch_of(out, ["grp", "idx", "n", "node"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
                out = []
        if out:
            yield batch_of(out, ["grp", "idx", "n", "node"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return blocks(nodes.select("grp", "idx", "n", "node"), size).mapInArrow(run, NODE)


def block_paths(nodes: DataFrame, size: int) -> DataFrame:
    """grp, idx, path (siblings up to the root of the block) of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            found = traversal([r["node"].hex().encode() for r in rows], height_of(rows[0]["n"], size))
            yield batch_of([(r["grp"], r["idx"], packed(p)) for r, p in zip(rows, found, strict=True)], ["grp", "idx", "path"], [pa.int64(), pa.int64(), pa.binary()])

    return blocks(nodes.select("grp", "idx", "n", "node"), size).mapInArrow(run, "grp long, idx long, path binary")


def climbed(nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(grp, idx, path, node) of the blocks of ``nodes``, the path leading to the group's root, and (grp, root)."""
    levels = [written(block_roots(nodes, size), "merkle-roots")]
    while levels[-1].filter("n > 1").limit(1).count():
        levels.append(written(block_roots(levels[-1], size), "merkle-roots"))
    roots = levels[-1].select("grp", F.col("node").alias("root"))
    up = levels[-1].select("grp", "idx", F.lit(b"").alias("path"))
    for level in reversed(levels[:-1]):
        own = block_paths(level, size).withColumn("_over", F.shiftright("idx", size))
        over = up.select("grp", F.col("idx").alias("_over"), F.col("path").alias("_rest"))
        up = own.join(over, ["grp", "_over"]).select("grp", "idx", F.concat("path", "_rest").alias("path"))
    return written(up, "merkle-paths"), roots


def manifest(leaves: DataFrame, group: str = "lang", id_col: str = "doc_id", carry: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """``leaves``: id, group, leaf (32 bytes) and the columns of ``carry``. One row per leaf with

    doc_id, leaf, idx and n (place in its group, leaves of the group), grp and n_grp (place of the group, groups), subroot, root, proof
    (the siblings' digests up to the root, one after the other) and the carried columns.
    """
    spark = leaves.sparkSession
    own = written(leaves.select(F.col(group).alias("_group"), F.col(id_col).alias("doc_id"), F.col("leaf").alias("node"), *carry), "merkle-leaves")
    groups = own.select("_group").distinct().withColumn("_all", F.lit(0).cast("long"))
    groups = written(numbered(groups, "_all", ["_group"]).select("_group", F.col("idx").alias("_grp"), F.col("n").alias("n_grp")), "merkle-groups")
    named = broadcast_if_small(groups.select(F.col("_group").alias("_named"), F.col("_grp").alias("grp")))
    nodes = own.join(named, F.col("_group").eqNullSafe(F.col("_named"))).drop("_group", "_named")
    nodes = written(numbered(nodes, "grp", ["doc_id", "node"]), "merkle-nodes")
    up, roots = climbed(nodes, size)
    # the roots of the groups are one more sequence
    tops = written(roots.join(groups.select(F.col("_grp").alias("grp"), F.col("n_grp").alias("n")), "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), "n", F.col("root").alias("node")), "merkle-tops")
    up_tops, top = climbed(tops, size)
    inner = block_paths(tops, size).select("idx", "path", F.shiftright("idx", size).alias("block"))
    ends = inner.join(up_tops.select(F.col("idx").alias("block"), F.col("path").alias("rest")), "block").crossJoin(F.broadcast(top.select(F.col("root").alias("_root"))))
    ends = ends.select(F.col("idx").alias("grp"), F.concat("path", "rest").alias("last"), "_root").join(tops.select(F.col("idx").alias("grp"), F.col("n").alias("n_grp"), F.col("node").alias("subroot")), "grp")
    # one row per block, sorted before its leaves
    heads = up.join(broadcast_if_small(written(ends, "merkle-ends")), "grp").select("grp", F.col("idx").alias("block"), F.concat("path", "last").alias("path"), "n_grp", "subroot", F.col("_root").alias("root"))
    kept = [(c, nodes.schema[c].dataType) for c in ("doc_id", *carry)]
    body = nodes.select("grp", F.shiftright("idx", size).alias("block"), "idx", "n", "node", "doc_id", *carry)
    every = body.unionByName(heads.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            head, rows = rows[0], rows[1:]
            found = traversal([r["node"].hex().encode() for r in rows], height_of(rows[0]["n"], size))
            made = {c: pa.array([r[c] for r in rows], t) for c, t in arrow}
            made |= {"leaf": pa.array([r["node"] for r in rows], pa.binary()), "idx": pa.array([r["idx"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int64())}
            made["grp"] = pa.array([head["grp"]] * len(rows), pa.int64())
            made["n_grp"] = pa.array([head["n_grp"]] * len(rows), pa.int64())
            for c in ("subroot", "root"):
                made[c] = pa.array([head[c]] * len(rows), pa.binary())
            made["proof"] = pa.array([packed(p) + head["path"] for p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    arrow = [(c, to_arrow_type(t)) for c, t in kept]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kept) + ", leaf binary, idx long, n long, grp long, n_grp long, subroot binary, root binary, proof binary"
    names = [c for c, _ in kept] + ["leaf", "idx", "n", "grp", "n_grp", "subroot", "root", "proof"]
    return dealt.mapInArrow(run, schema)


def folded(proofs: DataFrame, shown: str) -> DataFrame:
    """``proofs`` (see ``manifest``) with ``folded_root``: what the leaf in column ``shown`` and the proof give."""
    names = [*proofs.columns, "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in (shown, "idx", "n", "grp", "n_grp", "proof")}
            out = []
            for node, place, n, grp, n_grp, proof in zip(*c.values(), strict=True):
                path = split(proof)
                inner = siblings_in(place, n)
                sub = fold(node.hex().encode(), place, n, path[:inner])
                out.append(packed([fold(sub, grp, n_grp, path[inner:])]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema) + ", folded_root binary"
    return proofs.mapInArrow(run, schema)


def siblings_in(place: int, n: int) -> int:
    """How many siblings the node at ``place`` of ``n`` has on its way up."""
    out = 0
    while n > 1:
        out += place ^ 1 < n
        place, n = place >> 1, (n + 1) >> 1
    return out


def checked(docs: DataFrame, every: int = 7, columns: list[str] = LEAF_COLUMNS, changed: str = "n_chars", group: str = "lang", id_col: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """The manifest of ``docs`` and a trial of it: rows whose checksum of the id ``every`` divides are shown with 1 added to ``changed``.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (lowercase hex), verified (whether the fold ends in the root).
    """
    c = {k: F.col(k) for k in columns}
    other = {**c, changed: c[changed] + 1}
    odd = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    leaves = docs.select(F.col(group), F.col(id_col), leaf(list(c.values())).alias("leaf"), F.when(odd, leaf(list(other.values()))).alias("changed"))
    proofs = manifest(leaves, group, id_col, ("changed",), size)
    out = folded(proofs.withColumn("changed", F.coalesce("changed", "leaf")), "changed")
    hexed = {k: F.lower(F.hex(k)).alias(k) for k in ("leaf", "subroot", "root", "folded_root")}
    return out.select("doc_id", hexed["leaf"], hexed["subroot"], hexed["root"], F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), hexed["folded_root"], (F.col("folded_root") == F.col("root")).alias("verified"))
