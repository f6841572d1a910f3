"""Quality rules: document statistics and cross-document line frequency.

Each document's lines are normalised (ASCII and other letters lower-cased,
digits as 0, white space collapsed) and hashed. A line is boilerplate on a host
if the number of different documents of that host that hold it is above
``least_docs`` and above ``max_share`` of the host's documents (or above
``most_docs``, where that is given, however large the host). Such lines are
removed; a document left with less than ``keep_share`` of its words is depleted
and rejected, like one that fails a base rule.

Counts run over (host, line, document) before (host, line), so a line that every
document holds is counted by many tasks.

Defined cases: a null text has no words (base_failed); a null host is a host of
its own; repeated rows of one id are one document in the counts, and rows with a
null id are told apart by their text; very long texts are whole; an empty table
gives an empty result; other columns are not read by ``quality`` and pass through
``clean``, whatever they are named.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, row_key, text_slices

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_DIGIT = re.compile("[0-9]")


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    value = code[:n]
    for k in range(1, window):
        # Exact: numbers of prefixes stay below the number of words.
        _, value = np.unique(value * len(ids) + code[k : k + n], return_inverse=True)
    twice = np.bincount(value)[value] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hash and words of each line with a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup, hashes, counts = 0, [], []
    for line in raw.split(b"\n"):
        in_line = line.split()
        if in_line:
            dup += line in seen
            seen.add(line)
            hashes.append(_normal_hash(line))
            counts.append(len(in_line))
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    return len(words), chars, len(raw.translate(None, _NOT_SYMBOL)), dup, repeat_words(words), hashes, counts


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _normal_hash(line: bytes) -> int:
    """The hash of a line in normal form, as a signed long."""
    import xxhash

    normal = _DIGIT.sub("0", b" ".join(line.split()).decode("utf-8", "surrogatepass").lower())
    return xxhash.xxh64_intdigest(normal.encode("utf-8", "surrogatepass")) - (1 << 63)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """rk, doc_id, host, doc_key, the statistics, and the hash and number of words of each line."""
    carried = ["rk", "doc_id", "host", "doc_key"]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                rows = [statistics(t) for t in part.column("text").to_pylist()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
                lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]
                yield pa.record_batch([*map(part.column, carried), *numbers, *lists], names=[*carried, *STATS, "line", "line_words"])

    key = F.when(col(id_col).isNull(), F.xxhash64(F.lit(1), col(text_col))).otherwise(F.xxhash64(F.lit(0), col(id_col)))
    rows = docs.select(row_key(id_col, text_col).alias("rk"), col(id_col).alias("doc_id"), col(host_col).cast("string").alias("host"), key.alias("doc_key"), col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = ", ".join(f"{c} long" for c in STATS)
    return rows.mapInArrow(run, f"rk binary, doc_id {kind}, host string, doc_key long, {stats}, line array<long>, line_words array<long>")


def line_frequency(lines: DataFrame, least_docs: int, max_share: float, most_docs: int | None = None) -> DataFrame:
    """(host, line, docs) of the lines that are in too many documents of their host."""
    sizes = lines.select("host", "doc_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = lines.select("host", "line", "doc_key").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    high = counted.filter(F.col("docs") > least_docs).join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    above = F.col("docs") > F.col("host_docs") * F.lit(max_share)
    if most_docs is not None:
        above = above | (F.col("docs") > most_docs)
    return high.filter(above).select("host", "line", "docs")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int, max_share: float, keep_share: float, most_docs: int | None) -> tuple[DataFrame, DataFrame]:
    """Every row with its statistics and verdict, and the (rid, rk, line) to remove."""
    rows = materialize(document_statistics(docs, id_col, text_col, host_col).withColumn("rid", F.monotonically_increasing_id()), "quality-rows")
    zipped = F.explode(F.arrays_zip("line", "line_words")).alias("l")
    lines = rows.select("rid", "rk", "host", "doc_key", zipped).select("rid", "rk", "host", "doc_key", "l.line", "l.line_words")
    common = materialize(line_frequency(lines, least_docs, max_share, most_docs), "quality-lines").select(F.col("host").alias("h"), F.col("line").alias("c"))
    hits = lines.join(common, (F.col("line") == F.col("c")) & F.col("host").eqNullSafe(F.col("h")))
    removed = hits.groupBy("rid").agg(F.sum("line_words").alias("n_removed_words"))
    n, gone = F.col("n_words"), F.coalesce("n_removed_words", F.lit(0))
    failed = (n < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * n)
    kept = ~failed & ((n - gone) >= n * F.lit(keep_share))
    judged = rows.drop("line", "line_words").join(removed, "rid", "left")
    return judged.select("rk", "doc_id", "host", *STATS, gone.alias("n_removed_words"), failed.alias("base_failed"), kept.alias("kept")), hits


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    least_docs: int = 5, max_share: float = 0.01, keep_share: float = 0.5, most_docs: int | None = None,
) -> DataFrame:
    """doc_id, the statistics, n_removed_words, base_failed and kept of every row."""
    judged, _ = _judged(docs, id_col, text_col, host_col, least_docs, max_share, keep_share, most_docs)
    return judged.drop("rk", "host")


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    least_docs: int = 5, max_share: float = 0.01, keep_share: float = 0.5, most_docs: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are kept, without their boilerplate lines."""
    judged, hits = _judged(docs, id_col, text_col, host_col, least_docs, max_share, keep_share, most_docs)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = []
                for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    away = set(gone)
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    left = [x for x in lines if not (x.split() and _normal_hash(x) in away)]
                    texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                yield pa.record_batch([part.column("rk"), part.column("host"), pa.array(texts, pa.string())], names=["rk", "host", "new"])

    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("rk"), col(host_col).cast("string").alias("host"))
    good = judged.filter("kept").select("rk", "host").distinct()
    same = lambda df: [marked["rk"] == df["rk"], marked["host"].eqNullSafe(df["host"])]
    kept = materialize(marked.join(good, same(good), "left_semi"), "quality-kept")
    gone = hits.groupBy("rk", "host").agg(F.collect_set("line").alias("gone"))
    text = F.col("row").getField(text_col)
    cut = kept.withColumnsRenamed({"rk": "k", "host": "h"}).join(gone, (F.col("k") == F.col("rk")) & F.col("h").eqNullSafe(F.col("host"))).select("rk", "host", text.alias("text"), "gone")
    new = cut.dropDuplicates(["rk", "host"]).mapInArrow(run, "rk binary, host string, new string").withColumnsRenamed({"rk": "k", "host": "h"})
    out = kept.join(new, (F.col("rk") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")), "left")
    return out.select(*[(F.coalesce("new", text) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
