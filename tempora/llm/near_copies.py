"""Near copies: SimHash links by multi-index hashing, completed by MinHash bands, every link confirmed.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of ``threshold`` (0.8) or more. Candidates come from two sources:

* the SimHash operator: fingerprints of the same shingles within two bits, by
  multi-index hashing. Pairs at 0.8 differ in about ten bits, so this finds the
  closest pairs only;
* MinHash signatures of ``BANDS`` bands of ``ROWS`` values: texts that share a
  band. A pair at 0.8 shares one with probability 1 - (1 - 0.8 ** 5) ** 24 =
  0.99993, a closer pair with more.

Every link is confirmed by the exact similarity of the two sets. A bucket of
texts that share a band is not expanded into pairs. First every set is compared
with the bucket's centre, the set that shares bands with the most others. Then whatever is outside the
component that holds most of a bucket is compared with the sets of other
components, if a link is possible at all (``_rest``: a prefix filter on the
shingles, which loses no pair). So no pair of a bucket that could join two
components is lost.

Equal sets are one node, whatever their number. Defined cases: fewer than five
words are one shingle; texts without a word (null, empty, blank) have equal,
empty sets; rows that repeat an id are told apart by their text; a component of
rows without any id has a null component_id; other columns pass through,
whatever they are named; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, row_key, text_slices
from tempora.llm._windows import window_hashes, word_hashes
from tempora.llm.simhash import LOWER, fingerprint, keep_heads, links
from tempora.operators.closure import connected_components

BANDS, ROWS = 24, 5
_DRAWN = np.frombuffer(b"".join(hashlib.sha256(f"near:{k}".encode()).digest()[:16] for k in range(BANDS * ROWS)), "<u8").reshape(-1, 2)
_TIMES, _PLUS = (_DRAWN[:, 0] | np.uint64(1))[:, None], np.ascontiguousarray(_DRAWN[:, 1])[:, None]


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted."""
    found = (text or b"").translate(LOWER).split()
    return np.unique(window_hashes(word_hashes(b" ".join(found)), min(words, len(found)))) if found else np.empty(0, np.uint64)


def bands(grams: np.ndarray) -> np.ndarray:
    """One value for each band of the signature of a set that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(least, (grams[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    return window_hashes(least, ROWS)[::ROWS]


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, rk, node (a digest of the set), its size, its bands and the fingerprint, of every row of (doc_id, rk, text)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                sets = [shingles(t, words) for t in texts]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "rk": part.column("rk"),
                    "node": pa.array([hashlib.md5(g.tobytes()).digest() for g in sets], pa.binary()),
                    "size": pa.array(list(map(len, sets)), pa.int64()),
                    "bands": pa.array([bands(g).view(np.int64) if len(g) else [] for g in sets], pa.list_(pa.int64())),
                    "print": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)),
                }
                yield pa.record_batch(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, rk binary, node binary, size long, bands array<long>, print long")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node and the shingles of its text."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = [shingles(t, words).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node binary, grams array<long>")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are within two bits: each with the first of its print, and those with each other."""
    heads = materialize(nodes.groupBy("print").agg(F.min("node").alias("least")), "near-prints")
    same = nodes.join(heads, "print").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = links(heads.select(F.col("print").alias("fp"))).withColumnsRenamed({"a": "pa", "b": "pb"}).distinct()
    ends = lambda x: heads.select(F.col("print").alias(f"p{x}"), F.col("least").alias(x))
    return same.unionByName(near.join(ends("a"), "pa").join(ends("b"), "pb").select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    # Sets are wide: merged, they never lie in one process as a whole.
    ends = lambda x: sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")).hint("merge")
    met = pairs.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("met"), (F.size("ga") + F.size("gb")).alias("total"))
    return met.filter(F.col("met") >= threshold * (F.col("total") - F.col("met"))).select("a", "b")


def _alike(size_a: Column, size_b: Column, threshold: float) -> Column:
    return F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)


def components(plain: DataFrame, rows: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(fp, root, component_id) of every different set of ``rows``, with the node as fp; ``plain`` has the texts by rk."""
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("head"), F.min("rk").alias("rk"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("print").alias("print")), "near-nodes")
    filed = nodes.select("node", "size", F.posexplode("bands").alias("band", "code"))
    bucket = ["band", "code"]
    sizes = filed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(filed.join(sizes, bucket), "near-buckets")
    reach = shared.groupBy("node").agg(F.sum("n").alias("reach"))
    filed_by_reach = materialize(shared.join(reach, "node"), "near-reach")
    centres = filed_by_reach.groupBy(*bucket).agg(F.max(F.struct("reach", "node", "size")).alias("centre"))
    with_centre = materialize(shared.join(centres, bucket).select(*bucket, "node", "size", "n", "centre"), "near-centres")
    star = with_centre.filter(_alike(F.col("size"), F.col("centre.size"), threshold)).select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
    first = materialize(_ordered(star.unionByName(_simhash_pairs(nodes))), "near-pairs")

    used = shared.select("node").unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node"))).distinct()
    texts = plain.join(nodes.join(used, "node").select("node", "rk"), "rk").dropDuplicates(["node"])
    sets = materialize(_sets(texts, words), "near-sets")

    def closed(edges: DataFrame) -> DataFrame:
        return connected_components(edges, "a", "b", lambda df: materialize(df, "near-labels"))

    labels = closed(_confirmed(first, sets, threshold))
    # A bucket's centre has met all the others.
    left = with_centre.filter((F.col("n") > 2) & (F.col("node") != F.col("centre.node")))
    known = left.join(labels.withColumnRenamed("node", "named"), F.col("node") == F.col("named"), "left").select(*bucket, "node", "size", F.coalesce("label", "node").alias("label"))
    rest = materialize(_ordered(_rest(known, sets, threshold)), "near-rest")
    more = materialize(_confirmed(rest, sets, threshold), "near-links")
    placed = nodes.join(labels.withColumnRenamed("node", "named"), F.col("node") == F.col("named"), "left").select(F.col("node").alias("fp"), "head", F.coalesce("label", "node").alias("root"))
    if not more.isEmpty():
        # What joins two components joins their labels.
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        joined = closed(ends).withColumnsRenamed({"node": "old", "label": "new"})
        placed = placed.join(joined, F.col("root") == F.col("old"), "left").select("fp", "head", F.coalesce("new", "root").alias("root"))
    best = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    return materialize(placed.join(best, "root").select("fp", "root", "component_id"), "near-components")


def _rest(known: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different components that may be similar enough, though the stars have not compared them.

    All shingles are ordered by the number of sets that hold them, rare ones
    first. If two sets are similar enough, their first common shingle comes so
    early in both that the rest can hold what the threshold demands for their
    sizes. So a set is filed under its first shingles only, for each class of
    sizes that its partner may have; shingles of one set alone are not filed.
    """
    bucket = ["band", "code"]
    known = materialize(known, "near-known")
    mixed = known.groupBy(*bucket).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select(*bucket)
    here = materialize(known.join(mixed, bucket), "near-mixed")
    most = here.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*bucket).agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    able = here.join(most, bucket).groupBy("node").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.max(F.col("label") != F.col("most")).alias("apart"))
    held = materialize(able.join(sets.hint("merge"), "node"), "near-held")
    grams = held.select("node", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = grams.join(counts.hint("merge"), "gram").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda g: g["gram"]).alias("common"))

    share = threshold / (1 + threshold)
    width = 1.1
    reach = math.ceil(math.log(1 / threshold) / math.log(width))
    kind = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(width)) + F.lit(1e-9)).cast("int")
    sized = held.drop("grams").join(common.hint("merge"), "node").withColumn("own", kind)
    for_each = sized.withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    least = F.pow(F.lit(width), F.col("other").cast("double")) * F.lit(1 - 1e-6)
    last = F.floor(F.col("size") - F.lit(share) * (F.col("size") + least) + F.lit(1e-6))
    n_filed = F.least(last + 1 - (F.col("size") - F.size("common")), F.size("common").cast("long")).cast("int")
    filed = for_each.withColumn("filed", n_filed).filter("filed > 0")
    filed = filed.select("node", "size", "label", "apart", "own", "other", F.size("common").alias("of"), F.posexplode(F.slice("common", F.lit(1), F.col("filed"))).alias("at", "gram"))
    room = (F.col("of") - F.col("at")).cast("long")  # what the set holds from this shingle on
    filed = materialize(filed.select("node", "size", "label", "apart", "own", "other", "gram", room.alias("room")), "near-filed")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("size", "label", "room")]
    left = filed.filter("apart").select("gram", F.col("own").alias("k"), F.col("other").alias("j"), F.col("node").alias("a"), *side("a"))
    right = filed.select("gram", F.col("other").alias("k"), F.col("own").alias("j"), F.col("node").alias("b"), *side("b"))
    enough = F.least("room_a", "room_b") >= F.lit(share) * (F.col("size_a") + F.col("size_b")) - F.lit(1e-6)
    met = left.join(right.hint("merge"), ["gram", "k", "j"]).filter((F.col("label_a") != F.col("label_b")) & enough & _alike(F.col("size_a"), F.col("size_b"), threshold))
    return met.select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each component: its smallest id, as ``simhash.keep_one`` has it."""
    plain = docs.select(col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), col(text_col).alias("text"))
    rows = materialize(_sketches(plain, words), "near-rows")
    final = components(plain.select("rk", "text"), rows, threshold, words)
    return keep_heads(docs, rows.select("doc_id", "rk", F.col("node").alias("fp")), final, id_col, text_col)
