"""Entity names, types and relation orientation as expressions; the fuzzy merge blocks before it compares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvine.functions import vocab as V
from corvine.functions.text import bind, fold_accents, words_of

QUOTES = "[\"'“”«»]"


def _round(t: Column) -> Column:
    t = F.trim(F.regexp_replace(t, f"^{QUOTES}+|{QUOTES}+$", ""))
    t = F.trim(F.regexp_replace(t, "[\\s,;:.\\-–—]+$", ""))

    def parentheses(x: Column) -> Column:
        opens, closes = (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in "()")
        whole = F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")")) & (opens == 1)
        cut = F.when(whole, F.substr(x, F.lit(2), F.length(x) - 2)).when(opens > closes, F.regexp_replace(x, "\\([^(]*$", ""))
        return F.trim(cut.when(closes > opens, F.replace(x, F.lit(")"), F.lit(""))).otherwise(x))

    return bind(t, parentheses)


def normalized(raw: Column, rounds: int = 4) -> Column:
    """Spaces, quotes, end punctuation and stray parentheses removed, repeated until nothing changes in practice."""
    start = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "\\s+", " "))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda t, _: _round(t))


def canonical_type(raw: Column) -> Column:
    """Exact match of the letters, else the first known word contained, else the text in title case."""
    exact = F.create_map(*[F.lit(x) for kv in dict(reversed(V.TYPES)).items() for x in kv])
    table = F.array(*[F.struct(F.lit(a).alias("word"), F.lit(b).alias("type")) for a, b in V.TYPES])

    def of(t: Column) -> Column:
        inside = F.filter(table, lambda s: F.contains(F.lower(t), s["word"]))
        known = F.coalesce(exact[F.regexp_replace(F.lower(t), "[^a-z]", "")], F.get(inside, F.lit(0))["type"])
        return F.when(t == "", "Entity").otherwise(F.coalesce(known, F.initcap(F.lower(F.substring(t, 1, 40)))))

    return bind(F.trim(F.coalesce(raw, F.lit(""))), of)


def distinctive(word: Column) -> Column:
    """A code, a year, an acronym or a capitalised word that is not generic."""

    def token(t: Column) -> Column:
        code = t.rlike("^[\\p{L}\\p{N}_.\\-/]+$") & t.rlike("[0-9]") & t.rlike("[a-zA-Z]")
        year = t.rlike("^(19|20|21)\\d{2}$")
        base = fold_accents(F.lower(F.regexp_replace(t, "[^\\p{L}\\p{N}_]", "")))

        def named(b: Column) -> Column:
            upper = (F.length(t) >= 2) & (t == F.upper(t)) & (t != F.lower(t)) & ~F.array_contains(words_of(V.BLOCKED), b)
            return upper | (t.rlike("^\\p{Lu}") & ~F.array_contains(words_of(V.GENERIC), b) & (F.length(b) >= 3))

        return (F.length(t) > 0) & (code | year | bind(base, named))

    return bind(F.regexp_replace(word, "^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$", ""), token)


def rejection(raw: Column) -> Column:
    """Why a name is no entity; null when it is one."""

    def reason(name: Column) -> Column:
        words = F.filter(F.split(name, "\\s+"), lambda w: w != "")
        return (
            F.when(F.coalesce(F.length(name), F.lit(0)) < 3, "too short")
            .when(F.length(name) > 80, "too long")
            .when(~name.rlike("[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]"), "no letters")
            .when(name.rlike("^[\\d\\s.,;:%€$£+\\-/()]+$"), "number")
            .when(F.array_contains(words_of(V.BLOCKED), F.lower(name)), "business term")
            .when(F.size(words) > 9, "phrase")
            .when(~F.exists(words, distinctive), "generic")
        )

    return bind(raw, reason)


def is_short_variant(short: Column, long: Column) -> Column:
    """``long`` starts with ``short`` word by word and adds only corporate suffixes."""
    a, b = F.split(F.lower(short), " "), F.split(F.lower(long), " ")
    extra = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    bare = F.transform(extra, lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}_.]", ""))
    return (F.size(b) > F.size(a)) & (F.slice(b, 1, F.size(a)) == a) & F.forall(bare, lambda w: F.array_contains(words_of(V.SUFFIXES), w))


def has_code(name: Column) -> Column:
    def code(w: Column) -> Column:
        t = F.regexp_replace(w, "^[,;()\\[\\]]+|[,;()\\[\\]]+$", "")
        return t.rlike("\\d") & t.rlike("[A-Za-z\\-/:.]")

    return F.exists(F.split(name, " "), code)


#: Cells of the table of common subsequences that are held at a time.
CELLS = 1 << 22


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: one step per letter of the first texts, over all pairs and all places of the second.

    The best up to a place is the running maximum of what stood there and, where the letters agree, of what stood one place before plus one.
    """
    n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.argsort(np.maximum(*n), kind="stable")
    out = np.zeros(len(a), np.int64)
    at = 0
    while at < len(order):
        part = order[at : at + 4096]
        part = part[: max(1, np.searchsorted(np.maximum(n[0], n[1])[part] * np.arange(1, len(part) + 1), CELLS))]
        at += len(part)
        tables = []
        for texts, sizes, pad in ((a, n[0], -1), (b, n[1], -2)):
            t = np.full((len(part), int(sizes[part].max())), pad, np.int32)
            t[np.arange(t.shape[1]) < sizes[part, None]] = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.int32)
            tables.append(t)
        x, y = tables
        row = np.zeros((len(part), y.shape[1] + 1), np.int32)
        for k in range(x.shape[1]):
            np.maximum(row[:, 1:], np.where(y == x[:, k : k + 1], row[:, :-1] + 1, 0), out=row[:, 1:])
            np.maximum.accumulate(row, axis=1, out=row)
        out[part] = row[:, -1]
    return out


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 x longest common subsequence / total length of both; 100 for two empty texts."""
    total = (a.str.len() + b.str.len()).to_numpy()
    return pd.Series(np.where(total > 0, 200.0 * common_lengths(a.tolist(), b.tolist()) / np.maximum(total, 1), 100.0))


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "")), " ")


def similar_names(names: DataFrame, known: DataFrame, threshold: float = V.FUZZY) -> DataFrame:
    """``names``: tenant_id, name; ``known``: tenant_id, existing. tenant_id, name, existing, score of pairs with score >= threshold, letter case apart.

    A score of ``threshold`` leaves D = (1 - threshold / 100) x (both lengths) letters to insert or delete. A deletion breaks up three of a text's
    runs of three letters, an insertion two, so all but 3 D of the distinct runs of either text are in the other. Hence the rarest run that
    both share is among the rarest 3 D + 1 of each: pairs meet on those alone, and a run that very many names have ("customer") brings
    nobody together as long as the names have rarer ones. What meets is held against the bounds on length and on shared runs, then scored.
    This holds while 3 D is below the number of runs; texts with fewer runs meet on all of them and, whole, on themselves (thresholds from 92 on need no more: below seven letters only equal texts reach them).
    """
    d = 1 - threshold / 100

    def runs(df: DataFrame, col: str) -> DataFrame:
        t = df.select("tenant_id", F.col(col).alias("_name")).distinct().withColumn("t", sorted_words(F.lower("_name")))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substr("t", i, F.lit(3))))
        return t.withColumn("grams", grams)

    a, b = runs(names, "name"), runs(known, "existing")
    each = b.select("tenant_id", F.explode("grams").alias("gram"))
    often = each.groupBy("tenant_id", "gram").agg(F.count(F.lit(1)).alias("n"))

    def rarest(side: DataFrame) -> DataFrame:
        # the other text is at most (2 / (threshold / 100) - 1) times as long
        most = F.floor(F.lit(3 * d * 2 / (threshold / 100)) * F.length("t") + 1e-9).cast("int") + 1
        counted = side.withColumn("gram", F.explode("grams")).join(often, ["tenant_id", "gram"], "left").select("tenant_id", "_name", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"), most.alias("most"))
        first = counted.groupBy("tenant_id", "_name").agg(F.array_sort(F.collect_list("g")).alias("g"), F.first("most").alias("most"))
        return first.select("tenant_id", "_name", F.explode(F.slice("g", 1, F.col("most"))["gram"]).alias("gram"))

    met = rarest(a).withColumnRenamed("_name", "name").join(rarest(b).withColumnRenamed("_name", "existing"), ["tenant_id", "gram"]).select("tenant_id", "name", "existing").distinct()
    both = met.join(a.select("tenant_id", F.col("_name").alias("name"), F.col("t").alias("x"), F.col("grams").alias("gx")), ["tenant_id", "name"])
    both = both.join(b.select("tenant_id", F.col("_name").alias("existing"), F.col("t").alias("y"), F.col("grams").alias("gy")), ["tenant_id", "existing"])
    changed = F.lit(d) * (F.length("x") + F.length("y")) + 1e-9
    gone = F.abs(F.length("x") - F.length("y"))
    shared = F.size(F.array_intersect("gx", "gy"))
    near = both.filter((gone <= changed) & (shared >= F.greatest(F.size("gx"), F.size("gy")) - 3 * changed))
    return near.select("tenant_id", "name", "existing", indel_ratio("x", "y").alias("score")).filter(F.col("score") >= threshold)


def canonicalize(names: DataFrame, known: DataFrame, threshold: float = V.FUZZY) -> DataFrame:
    """``names``: tenant_id, name; ``known``: tenant_id, existing. Adds canonical.

    Exact and short-variant and code-prefix rules meet on the first word, what is left over on rare runs of letters (``similar_names``).
    """
    k = known.filter(F.length(F.trim("existing")) > 0).distinct()
    first = F.lower(F.substring_index("existing", " ", 1))
    kf = k.withColumn("first", first)
    longer = kf.select("tenant_id", "first", F.col("existing").alias("long"))
    grown = kf.join(longer, ["tenant_id", "first"]).filter(is_short_variant(F.col("existing"), F.col("long")))
    preferred = grown.groupBy("tenant_id", F.lower("existing").alias("low")).agg(F.max_by("long", F.struct(F.length("long"), "long")).alias("preferred"))
    exact = k.groupBy("tenant_id", F.lower("existing").alias("low")).agg(F.max("existing").alias("exact"))
    n = names.select("tenant_id", "name").distinct().withColumn("low", F.lower("name")).withColumn("first", F.lower(F.substring_index("name", " ", 1)))
    met = n.join(preferred, ["tenant_id", "low"], "left").join(exact, ["tenant_id", "low"], "left")
    open_ = met.filter(F.col("preferred").isNull() & F.col("exact").isNull())
    near = open_.select("tenant_id", "name", "low", "first").join(kf, ["tenant_id", "first"])
    short = is_short_variant(F.col("name"), F.col("existing"))
    pasted = has_code(F.col("existing")) & F.startswith(F.col("low"), F.concat(F.lower("existing"), F.lit(" ")))
    ruled = near.filter(short | pasted).groupBy("tenant_id", "name").agg(F.max_by("existing", F.struct(F.length("existing"), "existing")).alias("ruled"))
    left = open_.select("tenant_id", "name", "low").join(ruled, ["tenant_id", "name"], "left_anti")
    scored = similar_names(left, k, threshold)
    fuzzy = scored.groupBy("tenant_id", "name").agg(F.max_by("existing", F.struct("score", "existing")).alias("fuzzy"))
    out = met.join(ruled, ["tenant_id", "name"], "left").join(fuzzy, ["tenant_id", "name"], "left")
    return out.select("tenant_id", "name", F.coalesce("preferred", "exact", "ruled", "fuzzy", "name").alias("canonical"))


def oriented(relations: DataFrame) -> DataFrame:
    """``relations``: src, src_type, dst, dst_type, rel_type and further columns. Adds n_src, n_dst, n_rel, n_src_type, n_dst_type, swapped."""
    rel = F.upper(F.coalesce(F.when(F.col("rel_type") != "", F.col("rel_type")), F.lit("RELATED_TO")))
    unified = F.create_map(*[x for (r, t), u in V.UNIFIED.items() for x in (F.lit(f"{r}|{t}"), F.lit(u))])
    inverse = F.create_map(*[F.lit(x) for kv in V.INVERSE.items() for x in kv])
    wanted = F.create_map(*[x for r, ts in V.TARGETS.items() for x in (F.lit(r), words_of(ts))])
    one = relations.withColumn("_r", rel).withColumn("_r", F.coalesce(unified[F.concat_ws("|", "_r", "src_type")], unified[F.concat_ws("|", "_r", "dst_type")], F.col("_r")))
    two = one.withColumn("_turn", inverse[F.col("_r")].isNotNull()).withColumn("_r", F.coalesce(inverse[F.col("_r")], F.col("_r")))
    st, dt = F.when(F.col("_turn"), F.col("dst_type")).otherwise(F.col("src_type")), F.when(F.col("_turn"), F.col("src_type")).otherwise(F.col("dst_type"))
    three = two.withColumn("_st", st).withColumn("_dt", dt).withColumn("_want", wanted[F.col("_r")])
    again = F.coalesce(F.col("_want").isNotNull() & ~F.array_contains("_want", F.col("_dt")) & F.array_contains("_want", F.col("_st")), F.lit(False))
    four = three.withColumn("swapped", F.col("_turn") != again)
    return four.select(
        *relations.columns,
        F.when(F.col("swapped"), F.col("dst")).otherwise(F.col("src")).alias("n_src"), F.when(F.col("swapped"), F.col("src")).otherwise(F.col("dst")).alias("n_dst"), F.col("_r").alias("n_rel"),
        F.when(F.col("swapped"), F.col("dst_type")).otherwise(F.col("src_type")).alias("n_src_type"), F.when(F.col("swapped"), F.col("src_type")).otherwise(F.col("dst_type")).alias("n_dst_type"), "swapped",
    )


def reoriented(relations: DataFrame) -> DataFrame:
    """One row per tenant (where there is one), undirected pair and type (first by ``ordinal``), turned to canonical orientation."""
    turned = oriented(relations)
    pair = [F.col(c) for c in ("tenant_id",) if c in relations.columns] + [F.least(F.lower("n_src"), F.lower("n_dst")), F.greatest(F.lower("n_src"), F.lower("n_dst")), F.col("n_rel")]
    first = F.row_number().over(Window.partitionBy(*pair).orderBy("ordinal"))
    return turned.withColumn("_n", first).filter("_n = 1").drop("_n")


def filtered(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entities``: tenant_id, ordinal, entity_name, entity_type. (accepted, first of equal lower-case names; rejected with reason)."""
    named = entities.withColumn("name", normalized(F.col("entity_name"))).withColumn("reason", rejection(F.col("name")))
    good = named.filter(F.col("reason").isNull())
    first = F.row_number().over(Window.partitionBy("tenant_id", F.lower("name")).orderBy("ordinal"))
    kept = good.withColumn("_n", first).filter("_n = 1").select("tenant_id", "ordinal", "name", canonical_type(F.col("entity_type")).alias("type"))
    return kept, named.filter(F.col("reason").isNotNull()).select("tenant_id", "ordinal", F.when(F.col("name") != "", F.col("name")).otherwise(F.substring("entity_name", 1, 40)).alias("name"), "reason")


def filtered_relations(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``relations``: tenant_id, ordinal, source, target_name, target_type, relation_type.

    (accepted: the first of each source, target and type, without relations of a name to itself; rejected with reason).
    """
    named = relations.withColumn("target", normalized(F.col("target_name"))).withColumn("reason", rejection(F.col("target")))
    kind = F.substring(F.coalesce(F.when(F.col("relation_type") != "", F.col("relation_type")), F.lit("RELATED_TO")), 1, 40)
    good = named.filter(F.col("reason").isNull() & (F.lower("target") != F.lower("source"))).withColumn("relation_type", kind)
    first = F.row_number().over(Window.partitionBy("tenant_id", F.lower("source"), F.lower("target"), "relation_type").orderBy("ordinal"))
    kept = good.withColumn("_n", first).filter("_n = 1").select("tenant_id", "ordinal", "source", "target", canonical_type(F.col("target_type")).alias("target_type"), "relation_type")
    return kept, named.filter(F.col("reason").isNotNull()).select("tenant_id", "ordinal", F.when(F.col("target") != "", F.col("target")).otherwise(F.substring("target_name", 1, 40)).alias("target"), "reason")


#: Keys of a node that free properties may not overwrite.
RESERVED = ["name", "type", "source_doc", "source_docs", "updated_at", "canonical_id", "canonical_name"]


def clean_properties(props: Column) -> Column:
    """A map without reserved keys and nulls."""
    return F.map_filter(props, lambda k, v: ~F.array_contains(words_of(RESERVED), F.lower(k)) & v.isNotNull())
