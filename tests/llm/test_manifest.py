"""Operators 11 to 13 against plain loops on small and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import lattice_lm, merkle, resample
from corvine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, n long, row long, token string, score long, rank long, weight long, node string"
LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
TEXTS = [None, "", " \t\n", "Red red RED fox-hunt", "the cat sat on the mat " * 6, "The dog sat on the log " * 5, "ünïcode wörds für 百分 " * 9, "x" * 4000 + " end", LONG, "a b\x0bc\x0cd\re", "▁under ▁"]


def row(i, text, lang, source="s", n_chars=3):
    return (i, text, lang, source, n_chars, 1, 2, 3, "t", 4, 5, 6, "z")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(i, t, [None, "en", "", "de"][i % 4], None if i % 5 == 0 else f"s{i}", None if i % 6 == 0 else i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], row(4, "other text of one id", "en"), row(None, "no id at all", "en"), row(None, None, None, None, None)]
    rows += [row(100 + i, f"filler {i} " + "words come and go " * (i % 9), "en") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# --- manifest -------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(*at[i : i + 2]) for i in range(0, len(at), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


def up(node, i, levels):
    for level in levels[:-1]:
        j = i ^ 1
        node = sha(node) if j >= len(level) else sha(level[j], node) if i & 1 else sha(node, level[j])
        i >>= 1
    return node


def plain_manifest(rows):
    def leaf(r, plus=0):
        n = None if r.n_chars is None else r.n_chars + plus
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)])

    groups = {}
    for r in rows:
        odd = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), leaf(r, 1) if odd else leaf(r), r.doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, a, b, doc) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            root = up(up(b, i, trees[g]), k, top)
            out.append((doc, a, trees[g][-1][0], top[-1][0], sha(*path(trees[g], i), *path(top, k)), root, root == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 3, 8])
def test_manifest_equals_plain_trees(docs, size):
    got = sorted(map(tuple, merkle.checked(docs, size=size).collect()), key=repr)
    assert got == plain_manifest(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_sequences(spark):
    for n in (1, 2, 3, 8, 9, 21):
        one = spark.createDataFrame([row(i, f"t{i}", "en") for i in range(n)], SCHEMA)
        assert sorted(map(tuple, merkle.checked(one, size=2).collect()), key=repr) == plain_manifest(one.collect())
    assert merkle.checked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_of_many_groups(spark):
    many = spark.createDataFrame([row(i, "t", f"l{i % 37}") for i in range(111)], SCHEMA)
    assert sorted(map(tuple, merkle.checked(many, size=2).collect()), key=repr) == plain_manifest(many.collect())


def test_traversal_holds_few_nodes_and_gives_all_paths():
    for n in (1, 2, 5, 37, 64, 200, 256):
        leaves = [sha(str(i)).encode() for i in range(n)]
        levels = tree([x.decode() for x in leaves])
        height = merkle.height_of(n)
        assert merkle.root_of(leaves, height).decode() == levels[-1][0]
        assert [[p.decode() for p in got] for got in merkle.traversal(leaves, height)] == [path(levels, i) for i in range(n)]
    # a block that is not the only one of its sequence rises to its full height
    lone = merkle.root_of(leaves[:5], 8)
    node = tree([x.decode() for x in leaves[:5]])[-1][0]
    for _ in range(5):
        node = sha(node)
    assert lone.decode() == node


def test_traversal_is_ready_in_time_and_bounded():
    most, held = 0, []
    whole = merkle.Subtree

    class Watched(whole):
        def __init__(self, *a):
            super().__init__(*a)
            held.append(self)

    merkle.Subtree = Watched
    try:
        for _ in merkle.traversal([b"%064d" % i for i in range(256)], 8, 2):
            most = max(most, sum(len(s.nodes) + len(s.stack) for s in held[-9:]))
    finally:
        merkle.Subtree = whole
    assert most <= 9 * (2**3 + 8)


# --- resampling -----------------------------------------------------------------------------------------


def plain_resample(rows, target, percent=25, k=10_000):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(x.encode()) % k for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    def count(all_):
        c = Counter()
        for t in all_:
            c.update(feats(t)[1])
        return c

    s, t = count(r.text for r in rows), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in range(k)]
    out = []
    for r in rows:
        n, f = feats(r.text)
        w = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = order[: percent * len(order) // 100]
    ranks = {id(x): i + 1 for i, x in enumerate(drawn)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resample_equals_plain_draw(spark, docs, percent):
    target = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "Wörds und 百分")], "item_id long, text string")
    got = sorted(map(tuple, resample.resample(docs, target, percent).collect()), key=repr)
    want = plain_resample(docs.collect(), [r.text for r in target.collect()], percent)
    # equal rows of one id are interchangeable
    assert got == want
    assert [t for _, t in resample.resample(docs, target).dtypes] == ["bigint"] * 5


def test_resample_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs, none).count() == docs.count()
    assert resample.resample(docs.limit(0), none).count() == 0
    assert resample.resample(docs.filter("text is null"), none).filter("rank is not null").count() == 0


def test_features_in_parts():
    whole = np.concatenate(list(resample.features(LONG)))
    kept, resample.PART = resample.PART, 1000
    try:
        assert Counter(np.concatenate(list(resample.features(LONG))).tolist()) == Counter(whole.tolist())
    finally:
        resample.PART = kept


# --- language model ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return lattice_lm.pieces_of(tokenizer_path("piece_bpe_32k.model"))


def spellings(p, w, word):
    """Log probability of every way to spell a word, by enumeration."""
    initial = [(b"", lattice_lm.Lattice(p, p.start).empty)] if p.initial.get(b"") is None else []
    initial += [(s, w[k]) for s, k in p.initial.items() if word.startswith(s)]

    def rest(at):
        if at == len(word):
            yield 0.0
            return
        for end in range(at + 1, len(word) + 1):
            k = p.inner.get(word[at:end])
            if k is not None:
                yield from (w[k] + x for x in rest(end))
        yield from (w[p.byte + word[at]] + x for x in rest(at + 1))

    return [v + x for s, v in initial for x in rest(len(s))]


def test_marginal_is_the_sum_over_all_segmentations(pieces):
    lattice = lattice_lm.Lattice(pieces, pieces.start)
    words = [b"the", b"cats", "ü".encode(), "百".encode(), b"q", b"\xf0\x9f\x98\x80", b"others", b"x1-y"]
    got = lattice.marginals(words)
    for word, q in zip(words, got, strict=True):
        all_ = spellings(pieces, lattice.w, word)
        assert len(all_) > 1
        assert q == pytest.approx(math.log(sum(map(math.exp, all_))))
        assert lattice.long(word) == pytest.approx(q)
    assert lattice.long(b"ab" * 5000) < -1000


def test_expected_use_is_the_derivative_of_the_marginal(pieces):
    """Expected uses of a class are the derivative of the log marginal by the log of its mass."""
    words, counts = [b"the", b"cats", b"zebra", "für".encode()], np.array([3, 1, 2, 5])
    lattice = lattice_lm.Lattice(pieces, pieces.start)
    use = lattice.expected(words, counts)
    for c in np.argsort(-use)[:6]:
        ends = []
        for step in (1e-5, -1e-5):
            mass = pieces.start.copy()
            mass[c] *= math.exp(step)
            ends.append(float(lattice_lm.Lattice(pieces, mass).marginals(words) @ counts))
        assert use[c] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4)


def test_expected_uses_raise_the_likelihood(pieces):
    words, counts = [b"thenti", b"oftion", b"wherer,", b"anhe"], np.array([9, 4, 4, 1])
    before = lattice_lm.Lattice(pieces, pieces.start)
    use = before.expected(words, counts) + pieces.start
    after = lattice_lm.Lattice(pieces, use / use.sum())
    assert after.marginals(words) @ counts > before.marginals(words) @ counts


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


@pytest.mark.parametrize("common", [1, 20, 500_000])
def test_lm_base_and_parts(docs, common):
    """The base by plain counts; common or not, a token adds the same."""
    rows = docs.collect()
    out = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0
    c = Counter(t for r in rows if not out(r) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r.doc_id), out(r), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r.text)), 5)) for r in rows)
    got = lattice_lm.score(docs, tokenizer_path("piece_bpe_32k.model"), common=common).collect()
    assert sorted((repr(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got) == want
    assert all(g.score < 0 and g.lattice_score < 0 and math.isfinite(g.score) for g in got)
    once = sum(x == 1 for x in c.values())
    theta = once * n / (n - once)
    for g in got:  # the memory of whole tokens never lowers a probability below the lattice's share
        assert g.score >= g.lattice_score + g.n_tokens * math.log10(theta / (n + theta)) - 1e-6


def test_lm_without_training_texts_and_of_nothing(spark, docs):
    path_ = tokenizer_path("piece_bpe_32k.model")
    none = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    got = lattice_lm.score(none, path_).collect()
    assert len(got) == none.count() and all(g.train_tokens == 0 and g.base_score == 0 and g.n_known == 0 and math.isfinite(g.score) for g in got)
    assert lattice_lm.score(spark.createDataFrame([], SCHEMA), path_).count() == 0


def test_lm_tells_language_from_noise(spark):
    rows = [row(i, "the cat sat on the mat and the dog sat on the log " * 3, "en") for i in range(200)]
    rows += [row(1000 + i, t, "en") for i, t in enumerate(["the catalog sat on the doghouse", "zqx vkj wqq xzz qqk jjx zzq"] * 20)]
    got = {r.doc_id: r for r in lattice_lm.score(spark.createDataFrame(rows, SCHEMA), tokenizer_path("piece_bpe_32k.model")).collect() if r.held_out and r.doc_id >= 1000}
    words, noise = ([r.score / r.n_tokens for i, r in got.items() if i % 2 == k] for k in (0, 1))
    assert words and noise and min(words) > max(noise)
