"""One query per operator, over its whole table, and DuckDB SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import removed_substrings

    return removed_substrings(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pages import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    """The byte-level vocabulary file; its path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import encoded_digests

    return encoded_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import contrasted, preference_parts

    return preference_parts(contrasted(_table(spark, sf_dir, "conversations")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import proportional_shards

    return proportional_shards(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import predicted_languages

    return predicted_languages(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.leaks import benchmark_leaks

    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_html_extraction, op4_bpe, op5_chat_formatting, op6_substring_dedup, op7_sharding, op8_language_id, op9_benchmark_decontamination, op10_quality_rules)}

#: Words of a text column, and the lower-casing of A-Z.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t AS a JOIN t AS b ON a.token = b.token AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: struct_pack(pos := i, words := array_to_string(w[i:i + 49], ' ')))) AS s FROM w WHERE len(w) >= 50),
f AS (SELECT doc_id, s.pos AS pos, min(doc_id) OVER (PARTITION BY s.words) AS earliest FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM f WHERE earliest < doc_id),
h AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]) AS k
      FROM w LEFT JOIN h ON h.doc_id = w.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM k""",
    "op5_chat_formatting": """
WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
x AS (SELECT c.*, last FROM c JOIN l ON c.conv_id = l.conv_id WHERE turn <= last),
n AS (SELECT conv_id AS pair_id, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS other FROM l),
m AS (SELECT pair_id, other FROM n WHERE other IN (SELECT conv_id FROM l)),
t AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM x
      UNION ALL SELECT conv_id, 1, turn, role, text FROM x WHERE turn < last AND conv_id IN (SELECT pair_id FROM m)
      UNION ALL SELECT m.pair_id, 1, l.last, x.role, x.text FROM m JOIN x ON x.conv_id = m.other AND x.turn = x.last AND x.role = 'assistant' JOIN l ON l.conv_id = m.pair_id),
b AS (SELECT pair_id, turn, list((role, text) ORDER BY role, text) FILTER (side = 0) AS a, list((role, text) ORDER BY role, text) FILTER (side = 1) AS b FROM t GROUP BY pair_id, turn),
d AS (SELECT pair_id, min(turn) AS parted FROM b WHERE a IS DISTINCT FROM b GROUP BY pair_id),
p AS (SELECT t.*, CASE WHEN parted IS NULL OR turn < parted THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part FROM t LEFT JOIN d ON d.pair_id = t.pair_id),
r AS (SELECT pair_id, part, turn, turn // 256 AS segment, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN '1' ELSE '0' END AS mask,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM p WHERE part <> 'prompt' OR side = 0)
SELECT pair_id, part, CAST(segment AS BIGINT) AS segment, min(turn) AS first_turn, count(*) AS n_turns, string_agg(rendered, '' ORDER BY turn, rendered) AS rendered, string_agg(mask, '' ORDER BY turn, rendered) AS loss_mask
FROM r GROUP BY pair_id, part, segment""",
    "op7_sharding": """
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT))) AS c),
x AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, n + 1 AS size, md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
        xor(4294967295, list_reduce(list_transform(range(n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda a, y: xor(a >> 8, c[(xor(a, y) & 255) + 1]), 4294967295)) AS text_crc32 FROM x, c),
p AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY hash, doc_id, text_crc32) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY stratum)) AS place FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY place, stratum, hash, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM p),
s AS (SELECT *, pos * 8 // total AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
