"""The registered queries of this subpackage, each a thin call of its operator with
production parameters, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_codec, decontaminate, html_extract, langid, manifest, perplexity, pii, piece_codec, repeats, runs, sharding, simhash, toxicity
from weftline.llm.tables import key_remainder, read_table

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    number = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *number, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    judged = perplexity.judge(perplexity.measure(docs, perplexity.fit(docs)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = key_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.load_model(TOKENIZER)
    return piece_codec.encode_digests(read_table(spark, sf_dir, "documents"), model)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = key_remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, train=~held_out)
    return langid.predict(docs, model).withColumn("held_out", held_out)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = sharding.shard_layout(read_table(spark, sf_dir, "documents"), [1.0] * 8)
    return layout.withColumn("law", F.lit("key"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_codec.load_ranks(RANKS, public_tokenizers.PATTERN)
    return byte_codec.encode_digests(read_table(spark, sf_dir, "documents"), ranks)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(read_table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_perplexity, op4_repeats, op5_toxicity, op6_sentencepiece, op7_html, op8_langid, op9_simhash, op10_sharding, op11_byte_bpe, op12_manifest, op13_runs)}


def _crc_table() -> str:
    """The 256 remainders of crc32, as a list in SQL."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"CAST({table} AS BIGINT[])"


#: All shards weigh the same, so the largest draw wins; crc32 runs over the bytes of the text.
SHARDING_SQL = f"""
WITH t AS (SELECT {_crc_table()} AS crc),
keyed AS (SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS k, COALESCE(text, '') AS body, ROW_NUMBER() OVER () AS r FROM documents),
drawn AS (SELECT r, s, CAST('0x' || SUBSTR(MD5(k || ':' || CAST(s AS VARCHAR)), 1, 12) AS BIGINT) AS draw FROM keyed, (SELECT UNNEST(RANGE(0, 9)) AS s)),
won AS (SELECT r, ARG_MAX(s, draw) AS grown, ARG_MAX(s, draw) FILTER (WHERE s < 8) AS shard FROM drawn GROUP BY r),
sized AS (
  SELECT keyed.doc_id, keyed.k, CAST(STRLEN(body) + 1 AS BIGINT) AS size, CAST(won.shard AS INTEGER) AS shard, CAST(won.grown AS INTEGER) AS grown_shard,
    CASE WHEN STRLEN(body) = 0 THEN 0 ELSE XOR(LIST_REDUCE(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(HEX(ENCODE(body)), '..'), LAMBDA x: CAST('0x' || x AS BIGINT)), LAMBDA a, b: XOR(a >> 8, t.crc[(XOR(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) END AS text_crc32
  FROM keyed JOIN won ON keyed.r = won.r, t)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  CAST(ROW_NUMBER() OVER (PARTITION BY shard ORDER BY MD5(k), doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM sized
"""


_CRC32_OF_ID = "CASE WHEN doc_id IS NULL THEN 0 ELSE XOR(LIST_REDUCE(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(HEX(ENCODE(CAST(doc_id AS VARCHAR))), '..'), LAMBDA x: CAST('0x' || x AS BIGINT)), LAMBDA a, b: XOR(a >> 8, t.crc[(XOR(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) END"
_FIELD = "COALESCE(CAST(STRLEN(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _levels(name: str, leaves: str) -> str:
    """Nodes (g, level, idx, n, d) of the trees over ``leaves`` (g, idx, n, d), by level; n is the level's number of nodes."""
    return (
        f"{name} AS (SELECT g, 0 AS level, idx, n, d FROM {leaves} UNION ALL SELECT g, level + 1, idx // 8, (ANY_VALUE(n) + 7) // 8, SHA256(STRING_AGG(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 8)"
    )


def _folded(name: str, nodes: str, start: str, levels: str) -> str:
    """The rows of ``start`` (r, g, idx, d) folded with their siblings from level to level; each has what it has folded so far."""
    sides = f"SELECT n.g, n.level, n.idx, COALESCE(STRING_AGG(s.d, '' ORDER BY s.idx) FILTER (WHERE s.idx < n.idx), '') AS l, COALESCE(STRING_AGG(s.d, '' ORDER BY s.idx) FILTER (WHERE s.idx > n.idx), '') AS r FROM {nodes} n JOIN {nodes} s ON n.g = s.g AND n.level = s.level AND n.idx // 8 = s.idx // 8 WHERE n.n > 1 GROUP BY n.g, n.level, n.idx"
    return (
        f"{name}_sides AS MATERIALIZED ({sides}), {name} AS (SELECT r, g, 0 AS level, idx, d, '' AS proof FROM {start} UNION ALL SELECT f.r, f.g, f.level + 1, f.idx // 8, SHA256(s.l || f.d || s.r), f.proof || s.l || s.r FROM {name} f JOIN {name}_sides s ON f.g = s.g AND f.level = s.level AND f.idx = s.idx), "
        f"{levels} AS (SELECT r, ARG_MAX(g, level) AS g, ARG_MAX(d, level) AS d, ARG_MAX(proof, level) AS proof FROM {name} GROUP BY r)"
    )


#: Leaves by language (null as ``''``, others after ``=``), their trees, the tree over those, and every row folded up both.
MANIFEST_SQL = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS crc),
rows AS (SELECT doc_id, COALESCE('=' || lang, '') AS g, {' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head,
  {_FIELD.format('text')} AS body, {_FIELD.format("TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered, ({_CRC32_OF_ID}) % 3 = 0 AS bad FROM documents, t),
hashed AS (SELECT doc_id, g, SHA256(head || body) AS d, SHA256(head || CASE WHEN bad THEN lowered ELSE body END) AS given FROM rows),
leaf AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS r, *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d, given) - 1 AS idx, COUNT(*) OVER (PARTITION BY g) AS n FROM hashed),
{_levels('node', 'leaf')},
sub AS MATERIALIZED (SELECT g AS lang, '' AS g, d, ROW_NUMBER() OVER (ORDER BY g) - 1 AS idx, COUNT(*) OVER () AS n FROM node WHERE n = 1),
{_levels('top', 'sub')},
start AS (SELECT r, g, idx, given AS d FROM leaf),
{_folded('fold', 'node', 'start', 'folded')},
above AS (SELECT folded.r, sub.g, sub.idx, folded.d FROM folded JOIN sub ON folded.g = sub.lang),
{_folded('rise', 'top', 'above', 'risen')},
root AS (SELECT d FROM top WHERE n = 1)
SELECT leaf.doc_id, leaf.d AS leaf, sub.d AS subroot, root.d AS root, SHA256(folded.proof || risen.proof) AS proof_sha256, risen.d AS folded_root, risen.d = root.d AS verified
FROM leaf JOIN folded ON leaf.r = folded.r JOIN risen ON leaf.r = risen.r JOIN sub ON leaf.g = sub.lang, root
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_sharding": SHARDING_SQL, "op12_manifest": MANIFEST_SQL}
