"""Quality (5), toxicity (10), mixing (1), decontamination (7), extraction (6) and the pipeline."""

import binascii
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import decontamination, html_extract, mixing, quality, toxicity
from corvine.llm.textvec import ALNUM, Words

SCHEMA = "doc_id long, text string, lang string, source string, score double, y int, quality int, toxic int, topic string, weight double"


def crc(i, mod):
    return binascii.crc32(str(i).encode()) % mod


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    words = ["w%d" % k for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [random.choice(words) for _ in range(random.randint(20, 120))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice(["vile", "Foulish", "foulest!"]))
        text = " ".join(w)
        rows.append((i, text if good else "###*** ".join(w) + "&&&", "en", "s%d" % (i % 3)))
        labels.append((i, good, toxic))
    rows += [(900, None, None, None), (901, "", "en", "s0"), (902, "   ", "en", "s0"), (903, "vile " * 20000, "en", "s0"), (None, "plain words", "en", "s0"), (5, rows[5][1], "en", "s2")]
    return rows, labels


def tables(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(*r, 0.5, 1, None, None, None, None) for r in rows], SCHEMA)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(corpus[0]) and all(0 <= r.score <= 1 for r in out)
    truth = {i: g for i, g, _ in corpus[1]}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in out if r.doc_id is not None)
    assert sum((r.score >= 0.3) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in out)


def test_quality_ignores_row_order_and_clashing_columns(spark, corpus):
    docs, labels = tables(spark, corpus)
    one = quality.train(docs.repartition(3), labels)
    two = quality.train(docs.orderBy(F.desc("text")), labels.withColumn("text", F.lit("x")).withColumn("h", F.lit(1)).withColumn("_id", F.lit(1)))
    assert np.array_equal(one.words, two.words) and one.w0 == two.w0
    assert quality.train(docs, labels, chars=20_000).w0 != one.w0


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = quality.Machine(np.zeros((len(quality.STATS), quality.BINS - 1)), 0.3, rng.normal(size=(quality.DIMS, 1 + quality.RANK)), rng.normal(size=(len(quality.STATS) * quality.BINS, 1 + quality.RANK)))
    ids, stats = rng.integers(0, quality.DIMS, 9), np.arange(len(quality.STATS))[None, :] * quality.BINS
    z, _ = quality.raw_scores(m, stats, ids, np.array([9]))
    rows = [*(m.words[k] / 3 for k in ids), *(m.stats[k] for k in stats[0])]
    want = 0.3 + sum(r[0] for r in rows) + sum(rows[i][1:] @ rows[j][1:] for i in range(len(rows)) for j in range(i))
    assert abs(z[0] - want) < 1e-8


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    truth = {i: t for i, _, t in corpus[1]}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (crc(r.doc_id, 3) == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    texts = {r[0]: r[1] for r in corpus[0]}
    for r in out[:300]:
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[r.doc_id][a:b].lower().startswith(("vile", "foul"))
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not r.predicted for r in out)


def small_model():
    return toxicity.fit([" ".join(["plain%d" % (i * k % 7) for k in range(30)] + ["vile"] * (i % 3 == 0)) for i in range(120)], [int(i % 3 == 0) for i in range(120)], 30)


def test_very_long_texts_score_as_one_chain(monkeypatch):
    """Neither the part of a text that is read at a time, nor the block, nor the batch changes a score."""
    model = small_model()
    texts = ["plain1 plain2 vile plain3 " * 64, "plain1", "", "plain2 " * 300 + "vile"]
    whole = toxicity.measured(model, toxicity.Emissions(model), texts)
    alone = [toxicity.measured(model, toxicity.Emissions(model), [t]) for t in texts]
    for key, value in (("LONG", 130), ("SLICE", 2), ("BLOCK", 7)):
        monkeypatch.setattr(toxicity, key, value)
        assert "".join(toxicity.parts_of(texts[0])) == texts[0]
        part = toxicity.measured(model, toxicity.Emissions(model), texts)
        assert np.abs(whole[0] - part[0]).max() < 1e-9
        assert [h.tolist() for h in part[1]] == [h.tolist() for h in whole[1]]
    assert all(np.abs(whole[0][i] - one[0][0]).max() < 1e-9 for i, one in enumerate(alone))


def enumerated(e, trans):
    """All tag sequences of one chain with their weights."""
    n = len(e)
    paths = [[(k >> t) & 1 for t in range(n)] for k in range(2**n)]
    weight = [0.5 * np.prod([np.exp(e[t]) if p[t] else 1 for t in range(n)]) * np.prod([trans[p[t - 1], p[t]] for t in range(1, n)]) for p in paths]
    return paths, np.array(weight)


def test_messages_match_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(3)
    lengths = np.array([5, 0, 1, 9, 3])
    flat, trans = rng.normal(size=18), np.exp(rng.normal(size=(2, 2)))
    chain = toxicity.Chain(lengths)
    chain.messages(flat, trans)
    p, moves = chain.finished(flat, trans, 0, chain.n, True)
    at = 0
    for d, n in enumerate(lengths):
        if not n:
            continue
        paths, weight = enumerated(flat[at : at + n], trans)
        mine = slice(chain.first[d], chain.first[d + 1])
        want = [sum(w for w, s in zip(weight, paths, strict=True) if s[t]) / weight.sum() for t in range(n)]
        assert np.allclose(p.T[mine].ravel()[:n], want)
        assert np.isclose(chain.log_z[d], np.log(weight.sum())) and np.isclose(chain.log_clean[d], np.log(weight[0] / weight.sum()))
        pairs = [[sum(w * sum(s[t - 1] == a and s[t] == b for t in range(1, n)) for w, s in zip(weight, paths, strict=True)) / weight.sum() for b in (0, 1)] for a in (0, 1)]
        assert np.allclose(moves[:, :, mine].sum(2), pairs)
        at += n


def test_gradient_matches_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(8)
    lengths, toxic, vote = np.array([6, 3, 11, 1]), np.array([True, False, True, False]), np.array([1, 0.5, 1, 1])
    word = rng.integers(0, 5, 21)
    score, move = rng.normal(size=5) - 1, rng.normal(size=(2, 2))
    chain = toxicity.Chain(lengths)
    value = lambda s, m: toxicity.gradient(chain, s[word], word, 5, np.exp(m), toxic, vote)
    by_word, by_move, _ = value(score, move)
    for k in range(5):
        d = np.eye(5)[k] * 1e-5
        assert np.isclose((value(score + d, move)[2] - value(score - d, move)[2]) / 2e-5, by_word[k], atol=1e-5)
    for a in (0, 1):
        for b in (0, 1):
            d = np.zeros((2, 2))
            d[a, b] = 1e-5
            assert np.isclose((value(score, move + d)[2] - value(score, move - d)[2]) / 2e-5, by_move[a, b], atol=1e-5)


def test_fitted_field_ignores_row_order_and_clashing_columns(spark, corpus):
    docs, labels = tables(spark, corpus)
    one = toxicity.train(docs.repartition(3), labels)
    two = toxicity.train(docs.orderBy(F.desc("text")), labels.orderBy(F.rand(3)).withColumn("text", F.lit("x")).withColumn("y", F.lit(9)).withColumn("h", F.lit(1)))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.doc, two.doc)
    few = toxicity.train(docs, labels, chars=20_000)
    assert not np.array_equal(few.weights, one.weights)


def test_field_is_no_word_list(spark):
    """Toxic words with endings that no training text has are tagged, and no others."""
    random.seed(21)
    word = lambda: random.choice("bcdfg") + "".join(random.choice("aeiou") for _ in range(4))
    bad = lambda k: "zorkh" + "lmnpqrst"[k % 8] + random.choice("aeiou")
    make = lambda k, y: " ".join([word() for _ in range(30)] + [bad(k)] * y + [word() for _ in range(30)])
    train = [(make(k % 4, k % 2), k % 2) for k in range(400)]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    test = [(make(4 + k % 4, k % 2), k % 2) for k in range(200)]
    x, hits = toxicity.measured(model, toxicity.Emissions(model), [t for t, _ in test])
    said = 1 / (1 + np.exp(-(model.doc[0] + x @ model.doc[1:]))) >= 0.7
    assert (said == [y == 1 for _, y in test]).mean() > 0.97
    assert all(h.tolist() == [30] for h, (_, y) in zip(hits, test, strict=True) if y)


def test_models_without_labels_or_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    none = labels.limit(0)
    assert {r.predicted for r in quality.score(docs, quality.train(docs, none)).collect()} == {1}
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0}
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def raked(cells, powers, rounds=500):
    total = sum(cells.values())
    w = dict(cells)
    for _ in range(rounds):
        for axis, p in ((0, powers[0]), (1, powers[1]), (2, powers[2])):
            marginal, now = {}, {}
            for k, t in cells.items():
                marginal[k[axis]] = marginal.get(k[axis], 0) + t
            norm = sum(v**p for v in marginal.values())
            for k, t in w.items():
                now[k[axis]] = now.get(k[axis], 0) + t
            w = {k: t * total * marginal[k[axis]] ** p / norm / now[k[axis]] for k, t in w.items()}
    return {k: w[k] / cells[k] for k in cells}


def test_mixing_matches_plain_raking(spark):
    random.seed(9)
    rows = [(i, "a " * random.randint(1, 400), random.choice("xy"), "s%d" % min(3, int(random.expovariate(0.7)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "t").otherwise("u"))
    out = mixing.mixed(docs, budget=0.4).collect()
    cells = {}
    for r in out:
        assert r.n_tokens == len(r.text.split())
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.n_tokens
    want = raked(cells, (0.7, 0.5, 0.7))
    for r in out:
        assert abs(r.mix_weight - want[(r.source, r.lang, r.topic)]) < 1e-5
    total = sum(cells.values())
    assert abs(sum(r.n_tokens * r.prob for r in out) / total - 0.4) < 1e-3
    assert [r.sampled for r in sorted(mixing.mixed(docs, budget=0.4).collect())] == [r.sampled for r in sorted(out)]
    assert abs(sum(r.n_tokens * r.weight for r in out if r.sampled) / total - 1) < 0.25


def test_mixing_of_awkward_rows(spark, corpus):
    docs, _ = tables(spark, corpus)
    out = mixing.mixed(docs)
    assert out.count() == len(corpus[0]) and out.filter("prob is null or weight is null or prob > 1").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.filter("doc_id in (900, 901)")).count() == 2


def laid_over(item, doc, band=decontamination.BAND, window=decontamination.WINDOW):
    """Whether enough tokens of an item, or of a window of it, agree on diagonals within the band, over all places."""
    for first in range(-len(item) + 1, len(doc)):
        agree = set()
        for d in range(first, first + band + 1):
            agree |= {k for k in range(max(0, -d), min(len(item), len(doc) - d)) if item[k] == doc[k + d]}
        if len(agree) >= 0.8 * len(item) or any(len(agree & set(range(k, k + window))) >= 0.8 * window for k in range(len(item) - window + 1) if len(item) > window):
            return True
    return False


def test_decontamination(spark):
    random.seed(13)
    words = ["tok%d" % k for k in range(3000)]
    items = [(k, " ".join(random.choice(words) for _ in range(n))) for k, n in enumerate([15, 18, 30, 40, 55, 8, 3])]
    docs = []
    for i in range(60):
        w = [random.choice(words) for _ in range(random.randint(0, 120))]
        if i % 3 == 0:
            part = items[i // 3 % 7][1].split()
            for _ in range(int(len(part) * random.choice([0, 0.1, 0.4]))):
                part[random.randrange(len(part))] = random.choice(words)
            if i % 2:
                part = [p.upper() + random.choice(["", "***", "."]) for p in part]
            at = random.randint(0, len(w))
            w = w[:at] + part + w[at:]
        docs.append((i, " ".join(w), "x"))
    docs += [(60, None, "x"), (61, "", None), (None, items[3][1], "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (98, None), (99, "  ")], "item_id long, text string")
    want = set()
    tok = lambda t: Words([decontamination.lowered(t)], ALNUM).hash.tolist()
    for i, t, _ in docs:
        for k, s in items:
            item = tok(s)
            if item and laid_over(item, tok(t)):
                want.add((i, k))
    for block in (8 << 20, 200):
        got = decontamination.contaminated(table, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert decontamination.contaminated(table, bench.limit(0)).count() == decontamination.contaminated(table.limit(0), bench).count() == 0


def test_decontamination_finds_parts_of_long_items(spark):
    """70 of 100 tokens, and 50 of 2,000 with five replaced, are found; 30 tokens in a row of a long item are not, nor 60 that lie scattered."""
    words = [f"word{k}" for k in range(2000)]
    items = [(1, " ".join(words[:100])), (2, " ".join(words))]
    cut = words[1000:1050]
    cut[5::10] = ["other"] * 5
    scattered = [w if k % 5 < 3 else "none" for k, w in enumerate(words[200:300])]
    docs = [(1, "a b " + " ".join(words[10:80]) + " c"), (2, " ".join(cut)), (3, " ".join(words[1500:1530])), (4, " ".join(scattered)), (5, "")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_agree, r.n_window) for r in got} == {(1, 1, 70, 50), (1, 2, 70, 50), (2, 2, 45, 45)}
    one = next(r for r in got if (r.doc_id, r.item_id) == (1, 1))
    text = dict(docs)[1]
    assert text[one.start : one.end] == " ".join(words[10:60])
    assert (one.similarity, one.n_item) == (0.7, 100)


@pytest.mark.parametrize("kind", ["smallint", "tinyint", "int", "bigint", "string", "decimal(6,0)", "date"])
def test_decontamination_item_ids_of_any_type(spark, kind):
    words = "one of the long passages that a benchmark asks about and that stands word by word in a text of the corpus too"
    value = "date'2020-01-01'" if kind == "date" else f"cast(7 as {kind})"
    bench = spark.createDataFrame([(words,)], "text string").selectExpr(f"{value} as item_id", "text")
    got = decontamination.contaminated(spark.createDataFrame([(1, "x y " + words + " z")], "doc_id long, text string"), bench)
    assert dict(got.dtypes)["item_id"] == kind and [r.item_id for r in got.collect()] == [bench.first().item_id]


def test_cross_validation_separates_ridges():
    random.seed(5)
    texts = [" ".join(random.choice("abcdefgh") + str(random.randrange(50)) for _ in range(12)) + (" awful" if i % 3 == 0 else "") for i in range(90)]
    y = [int(i % 3 == 0) for i in range(90)]
    low, high = toxicity.cross_validated(texts + ["", " "], [*y, 1, 0], (0.02, 1000.0), epochs=40)
    assert 0 < low < high
    assert toxicity.cross_validated([], [], (0.02,)) == [0.0]


PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home {0}</a></ul></nav>
<div class="cookie-notice">We use cookies {0}</div><div class="ad">Buy {0}</div><{tag}><h1>Title&nbsp;{0} &amp; more</h1><p><b>First <i>in</i>line {0}.<br>next<p>Second&#33;
 line {0}<p>Read our terms of use.</p><div class="comments"><p>Nice {0}</p></div></{tag}><aside>Side {0}</aside><form><p>Name</p></form><footer>&copy; {0}</footer>"""


def test_extraction(spark):
    rows = [(i, f"https://h{i % 4 // 2}.example.org/p{i}", PAGE.format(i, tag="article" if i % 4 < 2 else "section"), "t") for i in range(16)]
    rows += [(16, None, None, "t"), (17, "x", "", None), (18, "http://solo/", "<p>only <a href='/'>one</a> <!-- x", "t"), (19, "http://solo2", "a < b <p>c</p><div", None)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == 20
    for i in range(16):
        # the sentence that is the same on every page of the host is template
        assert got[i].text == f"Title {i} & more First inline {i}. next Second! line {i}", got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert (got[16].text, got[17].text, got[18].text) == ("", "", "only one")
    assert got[19].text.startswith("a < b c")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BARE = """<html><head><title>{0}</title></head><body><div><div><div><span>{1}</span></div><div><span>{2}</span></div></div><div>{3}</div>
<div><h2>{0}</h2><p>{4}</p><p>{5}</p><p>Always the same line.</p></div><div>{6}</div></div></body></html>"""


def test_alignment_finds_content_without_any_tag_or_class(spark):
    """Menus, adverts and footers with varying words in bare div elements: only the host's common structure tells."""
    random.seed(31)
    text = lambda n: " ".join(random.choice("abcdefgh") + str(random.randrange(100)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        part = [text(6), text(2), text(2), text(8), text(40), text(25), text(7)]
        rows.append((i, f"http://bare{i % 2}.example/{i}", BARE.format(*part)))
        want[i] = " ".join([part[0], part[4], part[5]])
    rows += [(50, "http://few.example/1", BARE.format(*"abcdefg")), (51, "http://bare0.example/x", "<p>other <b>page"), (52, "http://bare0.example/y", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {i: got[i].text for i in want} == want
    assert {got[i].way for i in want} == {"template"}
    assert [(got[i].way, got[i].text) for i in (51, 52)] == [("list", "other page"), ("list", "")] and got[50].way == "list"


@pytest.mark.parametrize("size", [0, 8 << 20])
def test_hostile_pages(spark, monkeypatch, size):
    """Deep nesting, very many siblings and stray end tags next to ordinary pages; templates broadcast and joined."""
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", size)
    n = 10_000
    odd = ["<div>" * n + "deep" + "</div>" * n, "<b>" * n + "bold" + "<p>x" * 50, "<body>" + "".join(f"<p>{k}</p>" for k in range(50_000)), "</i>" * n + "<p>end" + "<li><td>" * 200]
    odd += ["<body>" + "".join(f"<div><p>{k * 3}</p></div>" for k in range(20_000))]
    rows = [(k, "http://odd.example/", page) for k, page in enumerate(odd)] + [(k + 10, f"http://odd.example/{k}", PAGE.format(k, tag="article")) for k in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep" and got[1].startswith("bold x x") and len(got[2].split()) == 50_000 and got[3].startswith("end") and len(got[4].split()) == 20_000
    assert got[12].startswith("Title 2 & more First inline 2.")


def listed_text(page):
    return html_extract.main_text(html_extract.parse(page), None, set())


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p data-id="menu" data-class=footer>a</p><p id=menu>b</p></article>', "a"),
        ("<article><p title=it's>first</p><p>don't stop</p></article>", "first don't stop"),
        ('<article><p title="open>one</p><p>two</p></article>', "one two"),
        ("<article><div class='social-history'>a</div><div class=search-results>b</div><div class='x reader-comments'>c</div><div id=ad-slot-2>d</div></article>", "a b"),
        ('<article><svg width=1/><p>a</p><svg><text>x</text></SVG><template>b<p>c</article>', "a b c"),
        ("<article>1<2 &lt;b&gt; <!-->x<!-- > -->y</ p>z<!doctype q>w<? a ?>v</article>", "1<2 <b> xyzwv"),
        ('<article><script>"</p>"<b>x</script ><p>a<script>b', "a"),
        ("<p>end <a", "end <a"),
        ("<p>end <a <!-- x", "end <a"),
        ('<p>a<b c="x>y', "ay"),
        ("<ARTICLE><P CLASS=a CLASS=menu>a</P></ARTICLE>", "a"),
    ],
)
def test_scanner(page, want):
    assert listed_text(page) == want


def test_scanner_is_linear():
    """Each page took minutes to hours, or would have, while one regular expression split pages into tags."""
    n = 100_000
    for piece in ("<script", '<a "', '<a b="x>" ', "<svg>", "<!--", "</scrip", "<a b='", "<!", "</", "<p title=it's>x"):
        began = time.monotonic()
        listed_text(piece * n + ">")
        assert time.monotonic() - began < 30
    for head, tail in (("<p><button>", "<hr>"), ("<li><div>", "<li>")):
        began = time.monotonic()
        listed_text(head + "<b>" * n + tail * n)
        assert time.monotonic() - began < 60


def test_link_paragraphs_and_clashing_names_in_a_slot(spark):
    """A paragraph that is one link, and blocks whose class only begins like a menu's, stay in the slot that alignment finds."""
    page = "<html><head><title>{0}</title></head><body><div><div>m{0} <i>n</i></div></div><div><h2>{0}</h2><p>{1}</p><p><a href=x>{2}</a></p><div class=social-history>{3}</div></div></body></html>"
    rows = [(i, "http://slot.example/", page.format(f"t{i}", f"w{i} " * 30, f"l{i} " * 9, f"s{i} " * 5)) for i in range(8)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text, r.way) for r in got} == {(i, " ".join(f"t{i} {f'w{i} ' * 30} {f'l{i} ' * 9} {f's{i} ' * 5}".split()), "template") for i in range(8)}


def naive_match(a, b):
    if a[0] != b[0]:
        return 0.0
    own = 1.5 if a[1] and a[1] == b[1] else 1.0

    def best(x, y):
        if not x or not y:
            return 0.0
        return max(best(x[1:], y), best(x, y[1:]), naive_match(x[0], y[0]) + best(x[1:], y[1:]))

    return own + best(a[2], b[2])


def flat_tree(nested):
    label, parent, text = [], [], []

    def walk(t, up):
        at = len(label)
        label.append(t[0])
        parent.append(up)
        text.append(t[1])
        for k in t[2]:
            walk(k, at)

    walk(nested, -1)
    return html_extract.Tree(label, parent, text, [0] * len(label), [0] * len(label))


def test_tree_matching_is_optimal():
    random.seed(17)

    def tree(depth):
        return [random.choice("pqr"), random.choice(["", "1", "2"]), [tree(depth - 1) for _ in range(random.randint(0, 3))] if depth else []]

    for _ in range(150):
        a, b = tree(2), tree(2)
        a[0] = b[0] = "p"
        x, y = flat_tree(a), flat_tree(b)
        weight, pairs = html_extract.match(x, y)
        assert weight == naive_match(a, b) == sum(1.5 if x.text[i] and x.text[i] == y.text[j] else 1.0 for i, j in pairs)
        assert all(x.label[i] == y.label[j] and (not i or (x.parent[i], y.parent[j]) in pairs) for i, j in pairs)
        few = html_extract.match(x, y, cells=0)
        assert few[0] <= weight and all(x.label[i] == y.label[j] for i, j in few[1])


def test_matching_does_not_depend_on_a_limit():
    """Comparing kinds of subtrees gives the weight and the pairs that comparing all nodes gives, and rows of a long list keep their partners."""
    random.seed(5)

    def tree(depth):
        return [random.choice("pqr"), random.choice(["", "1", "2", str(random.random())]), [tree(depth - 1) for _ in range(random.randint(0, 4))] if depth else []]

    for _ in range(200):
        a, b = tree(3), tree(3)
        a[0] = b[0] = "p"
        x, y = flat_tree(a), flat_tree(b)
        assert html_extract.match(x, y, cells=0) == html_extract.match(x, y, cells=7) == html_extract.match(x, y, cells=1 << 40)
    # an advert in the place of the first item: in label order it would take the partner of the article
    items = [["li", f"{k}", []] for k in range(400)]
    page = lambda name, more: flat_tree(["body", "", [["div", f"ad {name}", [["b", "", []]]] for _ in range(more)] + [["div", "", [["h1", "", []], ["p", name, []], ["p", "fixed", []]]]] + [["ul", name, [[*k[:1], f"{name} {k[1]}", []] for k in items]]]])
    x, y = page("x", 0), page("y", 2)
    weight, pairs = html_extract.match(x, y)
    assert (1, 5) in pairs and (4, 8) in pairs and weight == 406.5
    assert sum(i > 5 for i, _ in pairs) == 400


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from corvine.llm import exact_dedup
    from corvine.session import table
    from tests.llm.test_repeats import groups

    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, table(spark, sf, "labels"))
            gone = {r.doc_id for r in toxicity.score(before, model).collect() if r.predicted}
        elif name == "exact dedup":
            gone = {r.doc_id for r in exact_dedup.exact_dedup(before).collect() if not r.kept}
        elif name == "near dedup":
            texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            gone = {i for i, (_, root) in groups(texts, 80).items() if root != i}
        else:
            gone = {r.doc_id for r in decontamination.contaminated(before, table(spark, sf, "benchmark")).collect()}
        assert ids(after) == ids(before) - gone, name
        before = spark.createDataFrame(after.collect(), after.schema)
    out = corpus_pipeline.run(spark, sf)
    assert set(columns) <= set(out.columns) and ids(out) <= ids(before)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]


def test_pipeline_near_stage_links_from_four_fifths(spark):
    """The stage against brute force at 0.8, on texts of which many pairs lie between 0.80 and 0.85."""
    import corpus_pipeline
    from tests.llm.test_repeats import groups

    random.seed(29)
    word = lambda: f"w{random.randrange(10**6)}"
    base = [[word() for _ in range(120)] for _ in range(8)]
    rows = []
    for i in range(48):
        w = list(base[i % 8])
        for at in random.sample([10, 30, 50, 70, 90, 110], random.randint(1, 3)):
            w[at] = word()
        rows.append((i, " ".join(w)))
    want = {i for i, (_, root) in groups(rows, 80).items() if root == i}
    assert want < {i for i, (_, root) in groups(rows).items() if root == i}
    kept = corpus_pipeline.near_out(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_pipeline_of_awkward_rows(spark, sf):
    """Null and repeated ids, empty texts, clashing columns and an empty table go through every stage."""
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (None, "other text"), (None, None), (1, long + "\n"), (1, "one more"), (2, ""), (3, "   "), (4, "x " * 50_000), (4, "x " * 50_000), (5, long[:-1] + "x")]
    extra = "key long, sha string, norm string, mark long, rep long, id long, comp long, item_id string, n_tokens long, _picked long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", 2, 3, 4, 5, "c", 6, 7) for i, t in rows], f"doc_id long, text string, lang string, source string, {extra}")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        held[name] = sorted(str((r.doc_id, r.text)) for r in out.select("doc_id", "text").collect())
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert held["toxicity"] == held["decontamination"] == sorted(map(str, rows))
    # of the long text the longer row under id 1 stays, of the blank ones that with most characters, of the repeated row both
    assert held["exact dedup"] == sorted(str(r) for r in [rows[1], rows[3], rows[4], rows[6], *rows[7:]])
    assert held["near dedup"] == sorted(str(r) for r in rows if r[0] != 5)
    last = corpus_pipeline.mix(spark, docs, sf)
    assert last.count() <= len(rows) and corpus_pipeline.mix(spark, docs.limit(0), sf).count() == 0
