"""The corpus operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, decontamination, filter_audit, forced_bpe, language, line_dedup, oracles, pii, quality, secrets, sharding, simhash, substring_dedup, vector_codes
from tempora.llm._common import table

REGIONS, RACKS, SHARDS = 2, 2, 4


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.uniform_tree(REGIONS, RACKS, SHARDS)
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, 16))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, least=2).select("doc_id", "text", "n_removed_chunks")


def _spans(listed) -> F.Column:
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", _of("assign").alias("n_assign"), _of("access").alias("n_access"), _of("hex").alias("n_hex"), F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans")
    )


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, cache_words=1_000_000)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.identified(docs.select("doc_id", "text", language.held_out("doc_id").alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", *[_of(k).alias(f"n_{k}") for k in pii.BASE], F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return forced_bpe.round_trip(table(spark, sf_dir, "documents"), f.read())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("code"))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_hash_tree, op2_substring, op3_lines, op4_secrets, op5_templates, op6_bpe, op7_simhash, op8_language, op9_pii, op10_quality, op11_filter_audit, op12_forced_bpe, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = oracles.oracle_sql(REGIONS, RACKS, SHARDS)
