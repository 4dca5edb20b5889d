"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvine.llm import decontamination, exact_dedup, html_extract, lattice_lm, merkle, mixing, near_dedup, quality, resample, secret_scan, suffix_dedup, token_counts, toxicity
from corvine.session import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "mix_weight", "prob", "sampled", "weight")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting ``corvine.secret.ledger`` may name the folder of a ledger that later runs share; without it every blob is unseen."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), ledger=spark.conf.get("corvine.secret.ledger", ""))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("mark")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("mark")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1,
        "op2_suffix_dedup": op2,
        "op3_secret_scan": op3, "op4_token_counts": op4, "op5_quality": op5, "op6_html_extraction": op6, "op7_decontamination": op7, "op8_exact_dedup": op8, "op9_near_dedup": op9, "op10_toxicity": op10,
        "op11_lattice_lm": op11, "op12_merkle_manifest": op12, "op13_resample": op13}


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": OP3_SQL, "op8_exact_dedup": OP8_SQL, "op9_near_dedup": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_resample": OP13_SQL}


_ASSIGN = "(" + "|".join(map(secret_scan.either_case, secret_scan.KEYWORDS)) + r")[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, 6 AS least, regexp_extract_all(t, '{_ASSIGN}', 0) AS m,
         regexp_extract_all(t, '{_ASSIGN}', 2) AS v, regexp_split_to_array(t, '{_ASSIGN}') AS p FROM d
  UNION ALL SELECT doc_id, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0),
         regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]+', 0),
         regexp_extract_all(t, '[0-9a-f]+', 0), regexp_split_to_array(t, '[0-9a-f]+') FROM d
), f AS (
  SELECT doc_id, rank, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS p FROM k WHERE len(m) > 0
), s AS (
  SELECT doc_id, rank, kind, length(v) >= least AS ok, length(m) AS n,
         sum(length(p) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM f
), j AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
         string_agg(concat(kind, ':', stop - n, ':', stop), ',' ORDER BY stop - n, rank) AS spans
  FROM s WHERE ok GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

#: One row: the 256 remainders of the checksum by bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n : list_reduce(list_prepend(n, range(8)), lambda a, k : CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside ``crc``."""
    each = f"list_transform(range(strlen({text})), lambda i : ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda a, b : xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _levels(name: str, count: int) -> list[str]:
    """Tables name1, name2, ... (g, pos, n, h) of the levels above ``name0``; a sequence of one node stays as it is."""
    step = "SELECT g, pos // 2 AS pos, (n + 1) // 2 AS n, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {0}{1} GROUP BY g, n, pos // 2"
    return [f"{name}{k + 1} AS MATERIALIZED ({step.format(name, k)})" for k in range(count)]


def _climb(rows: str, nodes: str, count: int) -> list[str]:
    """Tables rows1, rows2, ... (doc_id, g, pos, n, f, proof, ...) of ``rows0`` on their way up beside the levels ``nodes``."""
    step = """SELECT d.* REPLACE (d.pos // 2 AS pos, (d.n + 1) // 2 AS n, concat(proof, s.h) AS proof,
      CASE WHEN d.n = 1 THEN f WHEN s.h IS NULL THEN sha256(f) WHEN d.pos % 2 = 1 THEN sha256(s.h || f) ELSE sha256(f || s.h) END AS f)
      FROM {0}{2} d LEFT JOIN {1}{2} s ON s.g = d.g AND s.pos = xor(d.pos, 1)"""
    return [f"{rows}{k + 1} AS ({step.format(rows, nodes, k)})" for k in range(count)]


def _merkle_sql(deep: int = 24, wide: int = 8) -> str:
    """For at most 2**deep rows of a language and 2**wide languages."""

    def leaf(n_chars: str) -> str:
        return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END" for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"

    steps = [
        _CRC_TABLE,
        f"""leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
          count(*) OVER (PARTITION BY lang) AS n, {leaf("n_chars")} AS h, CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS f FROM documents CROSS JOIN crc)""",
        "a0 AS (SELECT g, pos, n, h FROM leaves)",
        *_levels("a", deep),
        f"b0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM a{deep})",
        *_levels("b", wide),
        "d0 AS (SELECT doc_id, g, pos, n, h AS leaf, f, '' AS proof FROM leaves)",
        *_climb("d", "a", deep),
        f"e0 AS (SELECT d.doc_id, 0 AS g, d.g AS pos, b.n, d.leaf, b.h AS subroot, d.f, d.proof FROM d{deep} d JOIN b0 b ON b.pos = d.g)",
        *_climb("e", "b", wide),
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM e{wide} CROSS JOIN (SELECT h FROM b{wide}) r"


OP12_SQL = _merkle_sql()

OP13_SQL = f"""
WITH {_CRC_TABLE},
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
f AS MATERIALIZED (SELECT side, id, feat, count(*) AS n FROM (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) AS feat FROM w) GROUP BY ALL),
b AS MATERIALIZED (SELECT feat, {_crc("feat")} % 10000 AS bucket FROM (SELECT DISTINCT feat FROM f) CROSS JOIN crc),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM f JOIN b USING (feat) GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM c CROSS JOIN a),
m AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN b USING (feat) JOIN g USING (bucket) WHERE side = 's' GROUP BY id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('7:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN m ON id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS draw FROM d WHERE n_features >= 39)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
