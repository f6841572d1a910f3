"""Substring removal by super-k-mer partitioning of word windows.

A window is ``window`` consecutive words of one document. Its minimiser is the
run of ``minimiser`` words inside it whose hash is least (the leftmost such), so
equal windows have equal minimisers. Consecutive windows with one minimiser form
a super-k-mer; their words travel as one packed string to the bucket of the
minimiser, where the windows are sorted and counted exactly, as words.

Three things keep this linear and even:

* Texts with the same words are one text with a number of copies. If there is
  more than one copy, all its windows repeat; it still meets other texts' windows.
* Only minimisers seen at two or more places can belong to a repeated window.
  They are counted as 8-byte hashes first, so that strings of unique passages
  never travel.
* A minimiser seen at more than ``hot_bucket`` places is not gathered in one
  bucket: its windows are dealt out one by one and counted with partial sums.

What comes back from the buckets are the windows that are *not* repeated, at
most one row for each different window. All other windows of the super-k-mers
that travelled are repeated, so a passage that every document holds makes no
large group on its way back.

Defined cases: a null text has no words; a text of fewer words than a window
loses nothing; repeated rows are copies of each other; rows with a null id are
treated like any other; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, text_slices
from tempora.llm._windows import window_hashes, word_hashes


def super_kmers(raw: bytes, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser's hash and the first window of every super-k-mer of ``raw``, which has ``window`` words or more."""
    words = word_hashes(raw)
    short = window_hashes(words, minimiser)
    width = window - minimiser + 1
    least = np.lib.stride_tricks.sliding_window_view(short, width)
    at = np.concatenate([least[i : i + 8192].argmin(axis=1) for i in range(0, len(least), 8192)]) + np.arange(len(least))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return short[at[first]].view(np.int64), first.astype(np.int32)


def _tokenised(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """doc_id, key (SHA-256 of the words joined by one space), n_words, minis and starts of every row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                keys, counts, minis, starts = [], [], [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    words = (raw or b"").split()
                    joined = b" ".join(words)
                    keys.append(hashlib.sha256(joined).digest())
                    counts.append(len(words))
                    mini, first = super_kmers(joined, window, minimiser) if len(words) >= window else (np.array([], np.int64), np.array([], np.int32))
                    minis.append(mini)
                    starts.append(first)
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in xs])], pa.int32()), pa.array(np.concatenate(xs))) for xs in (minis, starts)]
                yield pa.record_batch([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), *lists], names=["doc_id", "key", "n_words", "minis", "starts"])

    rows = docs.select(col("doc_id"), col("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, n_words long, minis array<long>, starts array<int>")


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """(mini, uid, copies, start, n, words) for every super-k-mer that travels."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                out: list[tuple] = []
                for uid, copies, raw, runs in zip(*(part.column(c).to_pylist() for c in ("uid", "copies", "text", "runs")), strict=True):
                    words = raw.encode().split()
                    out += [(r["mini"], uid, copies, r["start"], r["n"], b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1])) for r in runs]
                for at in range(0, len(out), 5000):
                    columns = zip(*out[at : at + 5000], strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["mini", "uid", "copies", "start", "n", "words"])

    return texts.mapInArrow(run, "mini long, uid long, copies int, start int, n int, words binary")


def _count_bucket(rows: list[tuple[int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Unique windows of one bucket as runs (uid, start, n). rows: (uid, copies, start, n, words)."""
    alike: dict[bytes, tuple[int, int, int, int]] = {}
    for uid, copies, start, n, words in rows:
        alike[words] = (uid, 2 if words in alike else copies, start, n)
    placed = []
    for words, (uid, copies, start, n) in alike.items():
        cuts = [-1, *np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist(), len(words)]
        placed += [(words[cuts[k] + 1 : cuts[k + window]], uid, start + k, copies) for k in range(n)]
    placed.sort()
    last = len(placed) - 1
    alone = sorted((x[1], x[2]) for i, x in enumerate(placed) if x[3] == 1 and (i == 0 or placed[i - 1][0] != x[0]) and (i == last or placed[i + 1][0] != x[0]))
    out: list[tuple[int, int, int]] = []
    for uid, at in alone:
        if out and out[-1][0] == uid and out[-1][1] + out[-1][2] == at:
            out[-1] = (uid, out[-1][1], out[-1][2] + 1)
        else:
            out.append((uid, at, 1))
    return out


def _unique_cold(packed: DataFrame, window: int) -> DataFrame:
    """Buckets of bounded size: each is sorted and counted in memory."""

    def run(batches):
        bucket: list[tuple] = []
        mini = None
        out: list[tuple[int, int, int]] = []

        def flush():
            nonlocal out
            for at in range(0, len(out), 20_000):
                u, s, n = zip(*out[at : at + 20_000], strict=True)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], names=["uid", "start", "n"])
            out = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mini", "uid", "copies", "start", "n", "words")), strict=True):
                if row[0] != mini:
                    out += _count_bucket(bucket, window)
                    bucket, mini = [], row[0]
                    if len(out) >= 20_000:
                        yield from flush()
                bucket.append(row[1:])
        out += _count_bucket(bucket, window)
        yield from flush()

    dealt = packed.repartition("mini").sortWithinPartitions("mini")
    return dealt.select("mini", "uid", "copies", "start", "n", "words").mapInArrow(run, "uid long, start int, n int")


def _unique_hot(packed: DataFrame, window: int) -> DataFrame:
    """Buckets of any size: equal strings become one with its number, then windows are dealt out one by one and counted with partial sums."""
    alike = packed.groupBy("mini", "n", "words").agg(F.sum("copies").alias("copies"), F.max("uid").alias("uid"), F.max("start").alias("start"))
    words = F.split(F.col("words").cast("string"), " ")
    each = alike.select("mini", "uid", "copies", "start", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.array_join(F.slice(words, k, window), " "))).alias("k", "w"))
    counted = each.groupBy("mini", "w").agg(F.sum("copies").alias("places"), F.max("uid").alias("uid"), F.max(F.col("start") + F.col("k")).alias("start"))
    return counted.filter("places = 1").select("uid", F.col("start").cast("int").alias("start"), F.lit(1).alias("n"))


def _removed(texts: DataFrame, window: int) -> DataFrame:
    """uid, n_removed and kept_sha256 of the texts, given their runs of windows and the unique ones."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for uid, raw, runs, alone in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "runs", "alone")), strict=True):
                    words = raw.encode().split()
                    repeated = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        repeated[r["start"] : r["start"] + r["n"]] = 1
                    for r in alone or []:
                        repeated[r["start"] : r["start"] + r["n"]] = 0
                    at = np.flatnonzero(repeated)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                    out.append((uid, int(covered.sum()), b" ".join(kept)))
                uids, gone, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.record_batch([pa.array(uids, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["uid", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "uid long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimiser: int = 8, hot_bucket: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of every row.

    ``kept`` holds the words that stay, joined by one space, for texts that lose
    a part of their words; it is null where nothing or everything was removed.
    """
    plain = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    rows = materialize(_tokenised(plain, window, minimiser), "substring-rows")
    alike = rows.filter(F.col("n_words") >= window).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("head"), F.first("n_words").alias("n_words"), F.first("minis").alias("minis"), F.first("starts").alias("starts"))
    different = materialize(alike.withColumn("uid", F.monotonically_increasing_id()), "substring-texts")
    # Which super-k-mers can hold a repeated window?
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array((F.col("n_words") - (window - 1)).cast("int")))
    runs = different.select("uid", F.explode(F.arrays_zip(F.col("minis"), F.col("starts"), ends.alias("ends"))).alias("r")).select("uid", F.col("r.minis").alias("mini"), F.col("r.starts").alias("start"), (F.col("r.ends") - F.col("r.starts")).alias("n"))
    # Written, so that the join below deals both sides out anew and Spark can split a hot minimiser's rows.
    often = materialize(runs.groupBy("mini").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("mini", (F.col("places") > hot_bucket).alias("hot")), "substring-minimisers")
    gathered = runs.join(often, "mini").groupBy("uid").agg(F.collect_list(F.struct("start", "n", "mini", "hot")).alias("runs"))
    candidates = materialize(gathered.join(different.select("uid", "key", "copies", "head"), "uid"), "substring-candidates")
    # Their texts, one for each, meet them once.
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    keyed = plain.select("doc_id", F.unhex(F.sha2(words, 256)).alias("key"), words.alias("text"))
    met = keyed.join(candidates, "key").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    texts = materialize(met.select("uid", F.least("copies", F.lit(2)).cast("int").alias("copies"), "text", "runs"), "substring-strings")
    cold, hot = (texts.withColumn("runs", F.filter("runs", which)).filter(F.size("runs") > 0) for which in (lambda r: ~r["hot"], lambda r: r["hot"]))
    unique = _unique_cold(_packed(cold, window), window).unionByName(_unique_hot(_packed(hot, window), window))
    alone = unique.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("alone"))
    removed = _removed(texts.filter("copies = 1").select("uid", "text", "runs").join(alone, "uid", "left"), window).filter("n_removed > 0")
    partly = different.select("uid", "key").join(removed, "uid").drop("uid")
    wholly = different.filter("copies > 1").select("key", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    changed = materialize(partly.unionByName(wholly), "substring-changed")
    return (
        rows.select("doc_id", "key", "n_words")
        .join(changed, "key", "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"), "kept")
    )
