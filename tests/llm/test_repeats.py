"""Repeated passages (2) and near-duplicates (9) against brute force; the induced sorter against sorted()."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import induced, near_dedup, suffix_dedup
from corvine.llm.components import components

CLASH = "doc_id long, text string, doc long, seed string, kept string, n_bytes long, open string, comp long, rep long, bucket string, id long, set1 long"
REST = (1, "s", "k", 2, "o", 3, 4, "b", 5, 6)


def suffix_list(b, depth):
    """Positions from the last suffix to the first, and the common prefix of each with the one before."""
    at = sorted(range(len(b)), key=lambda i: b[i:], reverse=True)
    shared = lambda x, y: next((d for d in range(depth) if b[x + d : x + d + 1] != b[y + d : y + d + 1] or not b[x + d : x + d + 1]), depth)
    return at, [0] + [shared(x, y) for x, y in zip(at[:-1], at[1:], strict=True)][: len(b) - 1]


def induced_list(b, depth):
    with induced.Disk() as disk:
        rows = np.array(induced.suffixes(np.frombuffer(b, np.uint8), depth, disk))
        return ((rows >> induced.BITS).tolist(), (rows & induced.MASK).tolist()), disk.spilled


@pytest.mark.parametrize("memory", [1 << 16, 16, 3])
def test_induced_order_and_carried_prefixes(monkeypatch, memory):
    for name in ("MEMORY", "BLOCK", "RANGE"):
        monkeypatch.setattr(induced, name, memory)
    random.seed(3)
    spilled = 0
    for _ in range(200):
        k = random.choice([1, 2, 3, 26])
        b = bytes(random.randrange(k) + 97 for _ in range(random.randint(1, 60))) * random.choice([1, 3])
        depth = random.choice([5, 100, 1000])
        got, more = induced_list(b, depth)
        spilled += more
        assert got == suffix_list(b, depth)
    b = b"".join(random.choice([b"abracadabra", b"banana\0", b"mississippi", b"aaaaab"]) for _ in range(60))
    got, more = induced_list(b, 50)
    assert got == suffix_list(b, 50) and (spilled + more > 0) == (memory < 100)


def test_queues_spill_with_the_settings_in_use():
    """A shard of ordinary size goes through files; its windows are those of a dictionary."""
    random.seed(5)
    word = [bytes(random.randrange(97, 123) for _ in range(random.randint(2, 9))) for _ in range(400)]
    texts = [b" ".join(random.choice(word) for _ in range(40))[:160] for _ in range(9000)]
    texts = [random.choice(texts[:2000]) if k % 4 == 0 else t for k, t in enumerate(texts)]
    blob = b"".join(np.int64(k).tobytes() + np.array([7, len(t) - 99], np.int32).tobytes() + t for k, t in enumerate(texts))
    with induced.Disk() as disk:
        shard = suffix_dedup.Shard(disk)
        half = blob.index(np.int64(700).tobytes() + np.array([7], np.int32).tobytes())
        shard.add(blob[:half], 100)
        shard.add(blob[half:], 100)
        again = set()
        for found, best, _ in suffix_dedup.equal_windows(shard, 100, disk):
            again |= set(map(tuple, found[~best, 1:3].tolist()))
        assert shard.at > induced.MEMORY and disk.spilled > induced.MEMORY
    seen, want = set(), set()
    for k, t in enumerate(texts):
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                want.add((k, at + 7))
            seen.add(t[at : at + 100])
    assert again == want and want


def repeats(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdeéß") for _ in range(random.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40), text(60), "ab" * 200, "For " * 120]
    docs = [(i, " ".join(random.choice(shared) if random.random() < 0.3 else text(random.randint(1, 40)) for _ in range(random.randint(0, 5)))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, docs[3][1]), (63, docs[3][1]), (64, "x" * 99), (65, "x" * 99), (66, "x" * 100), (67, "x" * 100), (68, text(4000))]


@pytest.mark.parametrize("hot", [2, 1024])
def test_removed_bytes(spark, passages, hot):
    docs = spark.createDataFrame([(i, t, *REST) for i, t in passages], CLASH).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()}
    assert got == repeats(passages, 100)


def test_long_texts_in_pieces(monkeypatch):
    """Every window start lies in exactly one piece."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    text = bytes(random.randrange(97, 123) for _ in range(1000))
    which, place, parts = suffix_dedup.pieces([text], 100)
    starts = [p + k for p, b in zip(place.tolist(), parts, strict=True) for k in range(len(b) - 99)]
    assert starts == list(range(901))


def test_removed_bytes_keeps_what_is_left(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs, keep_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_empty_repeats(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], CLASH)).count() == 0


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def groups(docs, percent=85):
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_groups(spark):
    random.seed(11)
    words = ["Word%d" % k for k in range(400)] + ["É", "é"]
    base = [[random.choice(words) for _ in range(120)] for _ in range(6)]
    docs = []
    for i in range(150):
        w = list(random.choice(base)) if random.random() < 0.8 else [random.choice(words) for _ in range(random.randint(1, 30))]
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(words)
        docs.append((i, (" " if i % 2 else "\n").join(w)))
    docs += [(150, None), (151, ""), (152, " \t "), (153, "one"), (154, "ONE"), (155, "a b c d"), (156, "a b c d e"), (157, docs[0][1].upper()), (158, " ".join(words * 60))]
    table = spark.createDataFrame([(i, t, *REST) for i, t in docs] + [(None, "one", *REST)], CLASH)
    got = near_dedup.near_groups(table).collect()
    want = groups(docs)
    assert len(got) == len(docs) + 1
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r


def test_near_groups_of_ids_that_repeat(spark):
    """Rows of one id with different texts are different documents; ids of any type; nothing passed over by sketch."""
    text = lambda k: " ".join(f"{k}word{j}" for j in range(40))
    rows = [("b", text(1)), ("a", text(1) + " end"), ("b", text(2)), ("c", text(2)), ("c", text(2)), ("c", text(3)), (None, text(1)), ("d", "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id string, text string, id long, mark long").repartition(3)
    want = sorted(map(str, [("b", "a", False), ("a", "a", True), ("b", "b", True), ("c", "b", False), ("c", "b", False), ("c", "c", True), (None, None, True), ("d", "d", True)]))
    for exact in (False, True):
        assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_dedup.near_groups(docs, exact=exact).collect()) == want


def test_components_end_settled_or_not_at_all(spark):
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, rounds=1)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], CLASH)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[100:700])
    doc = np.repeat([0, 1], 600)
    sig = near_dedup.superminhash(doc, np.concatenate([a, b]), 2)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.15
    again = near_dedup.superminhash(np.zeros(600, np.int64), a[::-1].copy(), 1)
    assert (again[0] == sig[0]).all()


def test_windows_of_a_frequent_seed_travel_packed(spark):
    """A passage with 300 different continuations: the shards hand on blobs, not a row per distinct window, and nothing is lost."""
    random.seed(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(random.choices(letters, k=140))
    rows = [(i, passage + "".join(random.choices(letters, k=90))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    source = suffix_dedup.numbered(docs, "doc_id", "text", 4)
    marks = suffix_dedup.settled(suffix_dedup.deal(source.select("doc", "text"), 4, 100, 32), 4, 100, hot=8)
    late = suffix_dedup.resolved(suffix_dedup.opened(source, marks, 4, 100), 4, 100, 4).collect()
    windows = sum(len(r.windows or b"") for r in late) // suffix_dedup.WINDOW.itemsize
    assert windows > 3000 and sum(r.windows is not None for r in late) <= 16
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, hot=8).collect()}
    assert got[0] == 0 and all(got[i] >= 140 for i in range(1, 300))
    assert got == {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}


@pytest.mark.parametrize(("hot", "tasks"), [(2, 5), (1024, 1), (1024, 5)])
def test_repeated_rows_keep_their_bytes(spark, passages, hot, tasks):
    """A row that occurs again with its id is no repeat of itself, in settled and in open seeds."""
    extra = [passages[k] for k in (0, 3, 20, 41, 63, 66, 68, 68)]
    docs = spark.createDataFrame([(i, t, *REST) for i, t in passages + extra], CLASH).repartition(tasks)
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()]
    want = repeats(passages, 100)
    assert sorted(got) == sorted((i, want[i]) for i, _ in passages + extra)


def test_repeated_row_alone(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()] == [(0, hashlib.sha256(text.encode()).hexdigest())] * 2


def documents_in_order(rows):
    """Rows as documents: null ids first, rows of one id by the hash of their text, a repeated row once."""
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    return {r: k for k, r in enumerate(sorted({(i, t or "") for i, t in rows}, key=key))}


@pytest.mark.parametrize(("kind", "tasks"), [("long", 1), ("long", 7), ("string", 4)])
def test_ids_that_repeat_or_are_missing(spark, passages, kind, tasks):
    """Texts under one id, without id or with ids of another type keep what they do not repeat."""
    own = " ".join(f"alone{k}" for k in range(40))
    rows = passages + [(3, own), (3, own[:200] + "x"), (None, passages[3][1]), (None, own + " more"), (None, own + " more"), (None, None), (63, passages[20][1]), (20, own)]
    if kind == "string":
        rows = [(None if i is None else f"id{i:03d}", t) for i, t in rows]
    number = documents_in_order(rows)
    want = repeats([(k, t) for (_, t), k in number.items()], 100)
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(tasks)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted((str(i), *want[number[i, t or ""]]) for i, t in rows)


@pytest.mark.parametrize("parts", [1, 200])
def test_few_documents_and_many_partitions(spark, passages, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        long = "y" * 300 + "z" * 120
        for rows in ([(1, long)], [(1, long), (2, "q" * 40 + long)], [(1, None)], passages[:20]):
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got == repeats(rows, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
