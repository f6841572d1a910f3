"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenisation.

Every stage takes what its predecessor kept. The first four return the columns
of documents; the last returns the token ids of every remaining document and
the digest of their decoding.

Defined cases: null, empty and letterless texts go in the first stage, a text
that loses all its lines in the second; texts of any length are handled whole;
rows that repeat an id are told apart by their text; of equal texts, and of ids
that tie, one row stays after the third stage; null ids are ids of their own;
extra columns pass through the first four stages whatever they are named; an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, decontamination, language, line_dedup, near_copies
from tempora.llm._common import col, materialize, table

#: The least calibrated probability with which a language is accepted: it is likelier than all others together.
LEAST_SCORE = 0.5
#: Words that a worker remembers: fewer than op6's query takes, as the workers of five stages share an executor's memory.
CACHE_WORDS = 100_000
#: Rows that go to a Python worker at once: batches lie in the executor's and in the worker's memory, beside all else.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, texts of which no language is likely enough, and texts that are not familiar.

    What is familiar follows from the calibration documents of each language (see ``language``).
    """
    small_batches(spark)
    boxed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), "text")
    told = language.identified(boxed, language.train(docs), familiar_col="familiar")
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & F.col("familiar")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated line chunks out of the texts; n_chars follows, and documents left without a word go."""
    gone = next(name for k in range(len(docs.columns) + 1) if (name := f"removed{k}") not in {c.lower() for c in docs.columns})
    short = line_dedup.dedup_lines(docs, removed_col=gone, least=2)
    kept = short.filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = [F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns]
    return kept.select(*out)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the smallest id."""
    small_batches(spark)
    return near_copies.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a benchmark item leaks."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256."""
    small_batches(spark)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=True, cache_words=CACHE_WORDS)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: The learned stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
