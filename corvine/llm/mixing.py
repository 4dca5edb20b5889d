"""Mixing sources to target weights by iterative proportional fitting.

Token counts of (source, language, topic) cells are raked until their weighted sums match the target
shares of sources, languages and topics. A cell's weight is a product of three factors. Languages and
topics are small fixed sets, sources are not, so the table that is iterated over has one row per
source with an array over (language, topic) pairs: one pass gives every source its factor and returns
only the sums of the pairs, from which the other two factors follow.

Documents are then drawn independently: a document of a cell with weight m has probability
``min(1, c m)``, where c makes the expected tokens equal the budget. Draws depend on the document id
and the seed alone, so a rerun after a lost executor draws the same documents. ``weight`` is
m divided by the probability; summed over the sample it estimates the raked token sums without bias.

Defined results: null source, language or topic count as the empty string, a category like any other;
null and blank texts have 0 tokens and keep their cell's probability; a cell without tokens has weight 1;
equal ids share one draw; an empty table gives an empty result; other columns pass through
(a clash with a result column is resolved in favour of the result).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.storage import written

MAX_PAIRS = 1 << 16
ROUNDS = 500
CLOSE = 1e-9
STILL = 1e-12  # a round that changes less ends the fit
BROADCAST_SOURCES = 100_000
SPACES = " \t\n\x0b\f\r"
RESULT = ("topic", "n_tokens", "mix_weight", "prob", "sampled", "weight")


def count_words(text: Column) -> Column:
    """Runs of other characters than white space; 0 for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def form_topic(text: Column) -> Column:
    """A topic from the text's form, where no topic column is given: table, shout, noise, note or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def count(s: str) -> Column:
        return (n - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)

    noise = count("###") + count("***") + count("%%%") + count("$$$") + count("&&&")
    return F.when(n < 200, "note").when(count("|") * 60 > n, "table").when(count("!!") * 40 > n, "shout").when(noise * 40 > n, "noise").otherwise("prose")


@dataclass
class Mix:
    """``sources``: source and its factor; ``pair_weight``: factor of each (lang, topic); ``scale``: c of the draw."""

    sources: DataFrame
    pair_weight: dict[tuple[str, str], float]
    scale: float
    error: float


def smoothed(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to tokens ** power."""
    up = {k: max(v, 0.0) ** power if v > 0 else 0.0 for k, v in tokens.items()}
    total = sum(up.values()) or 1.0
    return {k: v / total for k, v in up.items()}


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def rake(cells: DataFrame, powers: tuple[float, float, float] = (0.7, 0.5, 0.7), budget: float = 0.5, lang_target: dict[str, float] | None = None, topic_target: dict[str, float] | None = None) -> Mix:
    """Fit the factors. ``cells``: source, lang, topic, tokens (one row per cell).

    Without explicit targets a share is proportional to tokens ** power. ``budget`` is the expected
    share of all tokens that the sample has.
    """
    pairs = [(r.lang, r.topic, float(r.tokens)) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_PAIRS + 1).collect()]
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of language and topic")
    pairs.sort()
    langs, topics = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    number = {(a, b): i for i, (a, b, _) in enumerate(pairs)}
    li, ti = np.array([langs.index(p[0]) for p in pairs], int), np.array([topics.index(p[1]) for p in pairs], int)
    tokens = np.array([p[2] for p in pairs])
    total = float(tokens.sum())
    spark = cells.sparkSession
    if not total:
        return Mix(spark.createDataFrame([], "source string, x double"), {k: 1.0 for k in number}, budget, 0.0)
    by = lambda idx, names, v: {n: float(v[idx == i].sum()) for i, n in enumerate(names)}
    lt, tt = lang_target or smoothed(by(li, langs, tokens), powers[1]), topic_target or smoothed(by(ti, topics, tokens), powers[2])
    lt, tt = np.array([lt.get(a, 0.0) for a in langs]), np.array([tt.get(a, 0.0) for a in topics])
    numbers = spark.createDataFrame([(a, b, i) for (a, b), i in number.items()], "lang string, topic string, pair int")
    per = cells.join(F.broadcast(numbers), ["lang", "topic"]).groupBy("source").agg(F.collect_list(F.struct("pair", F.col("tokens").cast("double").alias("tokens"))).alias("cells"), F.pow(F.sum("tokens").cast("double"), F.lit(powers[0])).alias("up"))
    per = written(per, "mix-sources")
    whole = per.agg(F.sum("up")).first()[0]
    y, z = np.ones(len(langs)), np.ones(len(topics))
    share = F.col("up") / F.lit(float(whole))

    def factor(pair_weight: np.ndarray) -> Column:
        w = literal(pair_weight.tolist())
        return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["tokens"] * F.element_at(w, c["pair"] + 1))

    def fitted(pair_weight: np.ndarray) -> DataFrame:
        mass = factor(pair_weight)
        return per.select("source", "cells", (F.when(mass > 0, share * total / mass).otherwise(1.0)).alias("x"))

    error, last = 1.0, 2.0
    for _ in range(ROUNDS):
        rows = fitted(y[li] * z[ti]).select("x", F.explode("cells").alias("c")).groupBy(F.col("c.pair").alias("pair")).agg(F.sum(F.col("c.tokens") * F.col("x")).alias("m")).collect()
        m = np.zeros(len(pairs))
        for r in rows:
            m[r.pair] = r.m
        got = np.bincount(li, m * y[li] * z[ti], len(langs)) / total, np.bincount(ti, m * y[li] * z[ti], len(topics)) / total
        error = float(max(np.abs(got[0] - lt).max(), np.abs(got[1] - tt).max()))
        if error < CLOSE or abs(last - error) < STILL:
            break  # matched, or as near as cells without tokens allow
        last = error
        now = np.bincount(li, m * z[ti], len(langs))
        y = np.divide(lt * total, now, out=np.ones(len(langs)), where=now > 0)
        now = np.bincount(ti, m * y[li], len(topics))
        z = np.divide(tt * total, now, out=np.ones(len(topics)), where=now > 0)
    else:
        raise RuntimeError(f"raking has not settled after {ROUNDS} rounds: a marginal is off by {error:.2g}")
    w = y[li] * z[ti]
    final = fitted(w)
    each = final.select(F.explode("cells").alias("c"), "x").select(F.col("c.tokens").alias("t"), (F.col("x") * F.element_at(literal(w.tolist()), F.col("c.pair") + 1)).alias("m"))
    low, high = 0.0, 1.0
    top = each.agg(F.min(F.when(F.col("m") > 0, F.col("m")))).first()[0] or 1.0
    high = 1.0 / top  # here every probability is 1
    for _ in range(4):
        grid = np.linspace(low, high, 65)
        sums = each.agg(*[F.sum(F.col("t") * F.least(F.lit(1.0), F.col("m") * float(c))).alias(f"c{i}") for i, c in enumerate(grid)]).first()
        k = next((i for i in range(65) if sums[i] >= budget * total), 64)
        low, high = float(grid[max(k - 1, 0)]), float(grid[k])
    return Mix(final.select("source", "x"), {k: float(w[i]) for k, i in number.items()}, high, error)


def described(docs: DataFrame, topic: Column | None, text_col: str = "text") -> DataFrame:
    """The columns that mixing needs, next to all others."""
    out = docs.drop(*[c for c in RESULT if c in docs.columns and not (c == "topic" and topic is None)])
    given = F.col("topic") if topic is None and "topic" in docs.columns else topic if topic is not None else form_topic(F.col(text_col))
    return out.withColumn("topic", F.coalesce(given.cast("string"), F.lit(""))).withColumn("n_tokens", count_words(F.col(text_col)))


def mixed(docs: DataFrame, budget: float = 0.5, powers: tuple[float, float, float] = (0.7, 0.5, 0.7), seed: int = 17, topic: Column | None = None, lang_target: dict[str, float] | None = None, topic_target: dict[str, float] | None = None) -> DataFrame:
    """Every row of ``docs`` with topic, n_tokens, mix_weight, prob, sampled and weight."""
    spark = docs.sparkSession
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = described(docs, topic)
    cells = rows.groupBy(source.alias("source"), lang.alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens"))
    fit = rake(written(cells, "mix-cells"), powers, budget, lang_target, topic_target)
    known = written(fit.sources.select(F.col("source").alias("_source"), F.col("x").alias("_x")), "mix-factors")
    if known.count() <= BROADCAST_SOURCES:  # beyond that the join is a shuffle whose large side can be split
        known = F.broadcast(known)
    pairs = spark.createDataFrame([(a, b, w) for (a, b), w in fit.pair_weight.items()] or [("", "", 1.0)], "_lang string, _topic string, _w double")
    out = rows.join(known, source == F.col("_source"), "left").join(F.broadcast(pairs), (lang == F.col("_lang")) & (F.col("topic") == F.col("_topic")), "left")
    out = out.withColumn("mix_weight", F.coalesce(F.col("_x") * F.col("_w"), F.lit(1.0))).drop("_source", "_x", "_lang", "_topic", "_w")
    out = out.withColumn("prob", F.least(F.lit(1.0), F.col("mix_weight") * F.lit(fit.scale)))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = out.withColumn("sampled", draw < F.col("prob"))
    return out.withColumn("weight", F.when(F.col("prob") > 0, F.col("mix_weight") / F.col("prob")).otherwise(0.0))
