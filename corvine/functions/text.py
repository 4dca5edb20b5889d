"""Text expressions: cleaning, tokens, identifiers, guards. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions import vocab as V


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: without it, each mention would repeat the whole expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_text(text: Column) -> Column:
    """NUL, odd spaces, soft hyphens, line ends, hyphenation at line ends, runs of blank lines and spaces."""
    t = F.regexp_replace(text, "\\x00", "")
    t = F.regexp_replace(t, "\\u00A0", " ")
    t = F.regexp_replace(t, "[\\u200B\\u200C\\u200D\\u00AD]", "")
    t = F.regexp_replace(t, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "([a-zA-ZáéíóúÁÉÍÓÚñÑüÜ])-\\n([a-zA-ZáéíóúÁÉÍÓÚñÑüÜ])", "$1$2")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[ \\t]{2,}", " ")
    return F.regexp_replace(t, "^\\s+|\\s+$", "")


def tokens(text: Column) -> Column:
    """Index tokens: lower case, at least two characters, no stop word unless it has a digit or hyphen."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(V.TOKEN), F.lit(0))
    stop = words_of(V.STOPWORDS)
    return F.filter(raw, lambda t: (F.length(t) > 1) & (t.rlike("[0-9-]") | ~F.array_contains(stop, t)))


def any_in(values: list[str], text: Column) -> Column:
    """Whether one of the values is a substring."""
    return F.exists(words_of(values), lambda v: F.contains(text, v))


def exact_identifiers(text: Column) -> Column:
    """Codes of the eight kinds in order of kind, each once."""
    each = [F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in V.IDENTIFIERS]
    return F.array_distinct(F.flatten(F.array(*each)))


def cache_identifiers(text: Column) -> Column:
    """The words with a digit that tell one question from another, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)[\\w][\\w\\-./,%:]*\\d[\\w\\-./,%:]*"), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(F.lower(t), "^[.,;:]+|[.,;:]+$", ""))
    return F.array_sort(F.array_distinct(bare))


def is_abstention(text: Column) -> Column:
    return F.coalesce(any_in(V.ABSTENTION, F.lower(text)), F.lit(False))


def is_injection(text: Column) -> Column:
    t = F.lower(text)
    out = F.lit(False)
    for p in V.INJECTION:
        out = out | t.rlike(p)
    return F.coalesce(out, F.lit(False))


def redact(text: Column) -> Column:
    for pattern, put in V.REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return text


def fold_accents(text: Column) -> Column:
    return F.translate(text, "áéíóúü", "aeiouu")


def tenant_or_default(raw: Column) -> Column:
    t = F.trim(raw)
    return F.when(t.rlike(V.TENANT), t).otherwise(V.DEFAULT_TENANT)


def windows(text: Column, size: int = 10_000, most: int = 20) -> Column:
    """array<struct<number, text>> of consecutive slices, the first ``most``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda s: F.struct((s / size).cast("int").alias("number"), F.substr(text, s + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > 0, F.slice(cut, 1, most))


def file_of_chunk(chunk_id: Column) -> Column:
    """File name inside a stored id: without the tenant and the chunk number."""
    bare = F.regexp_replace(chunk_id, "^[^:]*::", "")
    return F.when(F.instr(bare, "_chunk_") > 0, F.substring_index(bare, "_chunk_", 1)).otherwise(bare)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def relation_type(raw: Column) -> Column:
    """Upper case, other characters than letters, digits and _ replaced; empty or digit first: RELATED_TO."""
    return bind(F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^a-zA-Z0-9_]", "_")), lambda t: F.when((F.length(t) == 0) | t.rlike("^[0-9]"), "RELATED_TO").otherwise(t))


def source_tag(tag: Column) -> Column:
    """struct<kind, title, detail> of a source tag, for display: passages by file and heading, paths with readable relations,
    nodes with their type as detail. Any other tag is a document whose title is the tag; null gives null."""

    def told(path: Column) -> Column:
        names, types = F.split(path, V.PATH_STEP), F.regexp_extract_all(path, F.lit(V.PATH_STEP), F.lit(1))
        steps = F.transform(types, lambda r: F.concat(F.lit("→ "), F.replace(F.lower(r), F.lit("_"), F.lit(" ")), F.lit(" →")))
        line = F.array_join(F.zip_with(names, steps, lambda n, r: F.concat(n, F.coalesce(r, F.lit("")))), "")
        return F.trim(F.regexp_replace(F.regexp_replace(line, "[()]", ""), "\\s+", " "))

    def shown(kind: str, title: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), title.alias("title"), detail.alias("detail"))

    none = F.lit("")
    parts = F.split(F.regexp_extract(tag, V.PASSAGE_TAG, 1), "#")
    return (
        F.when(tag.rlike(V.PASSAGE_TAG), shown(V.PASSAGE_KIND, F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), none)))
        .when(tag.rlike(V.PATH_TAG), shown(V.PATH_KIND, told(F.regexp_extract(tag, V.PATH_TAG, 1)), none))
        .when(tag.rlike(V.NODE_TAG), shown(V.NODE_KIND, F.regexp_extract(tag, V.NODE_TAG, 2), F.regexp_extract(tag, V.NODE_TAG, 1)))
        .when(tag.isNotNull(), shown(V.PASSAGE_KIND, tag, none))
    )
