"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two 32-bit segments. If two fingerprints differ in at
most two bits, then either the high segments differ in at most one bit or the
low segments are equal. So every fingerprint is filed under both segments; a
look-up probes the exact low segment and the ball of radius one around the high
segment, and every match is verified by its complete distance. A pair one bit
apart in the high segment is found from the side that has the bit set, which
halves the probes and loses nothing.

Buckets of a table above ``hot_bucket`` different fingerprints (thousands of
near copies of one document share a segment) are not expanded into pairs. There
the remaining distance is found exactly by balls around the other segment:
two values at most two bits apart share a point of their radius-one balls, so
every fingerprint is linked with the smallest fingerprint of each of its 33
points. This keeps the components exact and the rows linear.

Components run over different fingerprints only; documents join at the end.

Defined cases: null, empty and blank texts have fingerprint zero; fewer than
three words hash as one sequence; a component of rows without any id has a null
component_id; repeated rows share their result; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, row_key, text_slices
from tempora.operators.closure import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - shingle + 1
    a, b = starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([h64(joined[i:j], SEED) for i, j in zip(a[at : at + 65536], b[at : at + 65536], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, and the fingerprint as a signed long."""
    carried = ["doc_id", *keep]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([*(part.column(c) for c in carried), pa.array(prints)], names=[*carried, "fp"])

    rows = docs.select(col(id_col).alias("doc_id"), *keep, col(text_col).alias("text"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp long"]))


def _balls(fp: DataFrame) -> DataFrame:
    """Rows (seg, val, fp): the value each fingerprint looks up in each table."""
    high, low = F.shiftrightunsigned("fp", 32).cast("long"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(high, i) == 1)
    lowered = F.transform(flips, lambda i: F.struct(F.lit(0).alias("seg"), high.bitwiseXOR(F.call_function("shiftleft", F.expr("1L"), i)).alias("val")))
    exact = F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))
    return fp.select("fp", F.explode(F.concat(exact, lowered)).alias("p")).select("p.seg", "p.val", "fp")


def links(fp: DataFrame, bits: int = 2, hot_bucket: int = 32) -> DataFrame:
    """Edges (a, b) whose transitive closure equals that of all pairs within ``bits`` (two) bits.

    ``fp`` holds different fingerprints in a column fp.
    """
    if bits != 2:
        raise ValueError("the two segments and their radii are laid out for two bits")
    high, low = F.shiftrightunsigned("fp", 32).cast("long"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    filed = fp.select("fp", F.posexplode(F.array(high, low)).alias("seg", "val"))
    sizes = filed.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    probes = _balls(fp)
    # Ordinary buckets: fetch the matches and verify them. Spark takes the rows that a list unfolds into for as small as
    # the table they come from, so without the hints it would send them all through the driver.
    cold = filed.join(sizes.filter(F.col("n") <= hot_bucket).select("seg", "val").hint("merge"), ["seg", "val"])
    pairs = probes.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b").hint("merge"), ["seg", "val"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    verified = pairs.filter((F.col("a") != F.col("b")) & near).select("a", "b")
    # Hot buckets: balls of the other segment, each tied to its smallest member.
    hot = materialize(sizes.filter(F.col("n") > hot_bucket).select("seg", "val"), "simhash-hot")
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.expr("1L"), i))
    ball = F.concat(F.array(F.lit(0).cast("long")), flips)
    other = F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32).cast("long"))
    members = filed.join(hot, ["seg", "val"])
    points = members.select("seg", "val", "fp", F.explode(F.transform(ball, lambda m: other.bitwiseXOR(m))).alias("point"))
    least = points.groupBy("seg", "val", "point").agg(F.min("fp").alias("b"))
    starred = points.join(least, ["seg", "val", "point"]).filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    # A probe one bit off that hits a hot high bucket: only 33 low segments are left, each a whole fingerprint.
    off = probes.filter((F.col("seg") == 0) & (F.col("val") != F.shiftrightunsigned("fp", 32).cast("long"))).join(hot, ["seg", "val"])
    whole = off.select(
        F.col("fp").alias("a"),
        F.explode(F.transform(ball, lambda m: F.shiftleft("val", 32).bitwiseOR(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(m)))).alias("b"),
    )
    crossed = whole.join(fp.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return verified.unionByName(starred.filter(near)).unionByName(crossed)


def components(rows: DataFrame, hot_bucket: int = 32) -> DataFrame:
    """(fp, root, component_id) of every different fingerprint of ``rows`` (doc_id, fp)."""
    heads = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-heads")
    edges = materialize(links(heads.select("fp"), hot_bucket=hot_bucket), "simhash-links")
    labels = connected_components(edges, "a", "b", lambda df: materialize(df, "simhash-labels"))
    placed = heads.join(labels, heads.fp == labels.node, "left").select("fp", "head", F.coalesce("label", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    return materialize(placed.join(best, "root").select("fp", "root", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot_bucket: int = 32) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    return rows.join(components(rows, hot_bucket), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each component: its smallest id.

    Rows that repeat that id are told apart by fingerprint and text; of wholly
    equal ids and texts one row stays.
    """
    plain = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    rows = materialize(fingerprints(plain.withColumn("rk", row_key("doc_id", "text")), "doc_id", "text", keep=["rk"], **{k: v for k, v in options.items() if k == "shingle"}), "simhash-rows")
    return keep_heads(docs, rows, components(rows, options.get("hot_bucket", 32)), id_col, text_col)


def keep_heads(docs: DataFrame, rows: DataFrame, final: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that head a component; ``rows`` has doc_id, rk and fp, ``final`` what ``components`` gives."""
    heads = rows.join(final, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = heads.groupBy("root").agg(F.min("rk").alias("rk"), F.count(F.lit(1)).alias("n"))
    chosen = materialize(best.select(F.col("rk").alias("__rk"), "n"), "simhash-chosen")
    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"), row_key(id_col, text_col).alias("__rk"))
    held = marked.join(chosen, "__rk")
    once = held.filter("n = 1").select("__row")
    more = held.filter("n > 1").dropDuplicates(["__rk"]).select("__row")
    return once.unionByName(more).select("__row.*")
