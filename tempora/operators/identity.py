"""Ingestion identity, deduplication and event materialisation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.closure import Trees, connected_components, spanning_links

PARSE_VERSION, CANONICAL_VERSION, HASH_VERSION = "parse-1", "url-1", "hash-1"
#: Query parameters that say where a reader came from.
TRACKING = r"^(?:utm_[a-z_]+|ref|gclid|fbclid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Layer 2 (D2): host, path and sorted query parameters.

    Scheme, user, default port, www. and m. of the host, fragment, last slashes
    of the path and tracking parameters do not count. Only the host loses its
    case: paths and parameters that differ in case are different pages.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    before, query = F.split_part(plain, F.lit("?"), F.lit(1)), F.regexp_extract(plain, r"\?(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.split_part(before, F.lit("/"), F.lit(1)), r"^[^@]*@", ""), r":(?:80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(before, r"^[^/]*(/.*)?$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def content_hash(text: Column) -> Column:
    """Layer 3 (D3): SHA-256 of the text, trimmed, lower-cased, with white space collapsed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))), 256)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by a total order (D1). Partial: equal keys meet as one row for each task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*")


def item_key(source: Column, external: Column, text_hash: Column) -> Column:
    """Uniqueness key (D6): source and external id, or the content hash where there is no external id."""
    return F.when(external.isNotNull(), F.concat_ws(":", F.lit("ext"), source, external)).otherwise(F.concat_ws(":", F.lit("txt"), text_hash))


def versions() -> list[Column]:
    """Versions of the functions that gave an item its identity."""
    return [F.lit(PARSE_VERSION).alias("parse_version"), F.lit(CANONICAL_VERSION).alias("canonicalisation_version"), F.lit(HASH_VERSION).alias("hash_version")]


def new_only(batch: DataFrame, stored: DataFrame, layers: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch that no layer knows (D7): within the batch the first of each key stays, then stored keys go.

    A null key in a layer says nothing.
    """
    out = batch
    for key in layers:
        named = first_of(out.filter(F.col(key).isNotNull()), [key], order).select(*batch.columns)
        out = named.unionByName(out.filter(F.col(key).isNull()))
        out = out.join(stored.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*batch.columns)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def blocked_pairs(df: DataFrame, key: str, block: str, vector: str, threshold: float) -> DataFrame:
    """Pairs of one block with a cosine of ``threshold`` or more (D4). Advisory: it proposes, it does not merge."""
    a = df.select(F.col(key).alias("id_a"), F.col(block).alias("block"), F.col(vector).alias("va"))
    b = df.select(F.col(key).alias("id_b"), F.col(block).alias("block"), F.col(vector).alias("vb"))
    scored = a.join(b, "block").filter(F.col("id_a") < F.col("id_b")).withColumn("score", cosine(F.col("va"), F.col("vb")))
    return scored.filter(F.col("score") >= threshold).select("block", "id_a", "id_b", "score")


def hyperplanes(dimensions: int, planes: int, seed: str) -> list[list[float]]:
    """Directions of +1 and -1 drawn from digests: the same in every run."""
    out = []
    for p in range(planes):
        bits = b"".join(hashlib.sha256(f"{seed}:{p}:{k}".encode()).digest() for k in range(dimensions // 256 + 1))
        out.append([1.0 if bits[i // 8] >> (i % 8) & 1 else -1.0 for i in range(dimensions)])
    return out


def hash_codes(df: DataFrame, key: str, vector: str, planes: Sequence[Sequence[float]], bits: int) -> DataFrame:
    """(id, codes): for each band of ``bits`` hyperplanes the signs of the vector as one number. One product of matrices a batch."""
    import numpy as np
    import pyarrow as pa

    directions = np.array(planes).T
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            codes = (((vectors @ directions) >= 0).reshape(len(lists), -1, bits) * weights).sum(axis=2)
            ends = np.arange(len(lists) + 1, dtype=np.int32) * codes.shape[1]
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))], names=["id", "codes"])

    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == directions.shape[0])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, codes array<long>")


def bands_needed(threshold: float, bits: int, recall: float) -> int:
    """Bands of ``bits`` signs at which two vectors with this cosine share one with probability ``recall``."""
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - alike)) if alike < 1 else 1


def hashed_pairs(
    df: DataFrame, key: str, vector: str, threshold: float, dimensions: int,
    bands: int | None = None, bits: int | None = None, seed: str = "planes", recall: float = 0.996, hot: int = 256,
) -> DataFrame:
    """Pairs with a cosine of ``threshold`` or more among those that share a band of hyperplane signs (D4 without a block).

    For tables where no block is small. Unless given, ``bits`` follows from the
    number of rows, so that a bucket holds about two unrelated vectors at every
    size, and ``bands`` is the number at which a pair at the threshold shares a
    band with probability ``recall``: of 8 bits, 17 at 0.9 and 88 at 0.6. A bucket
    of more than ``hot`` rows (many vectors that are alike) is cut into slices,
    and every two slices meet in a task of their own; no pair is left out.
    Vectors of other lengths have no pairs.
    """
    if bits is None:
        bits = max(8, math.ceil(math.log2(max(2, df.count()))) - 1)
    if bands is None:
        bands = bands_needed(threshold, bits, recall)
    coded = hash_codes(df, key, vector, hyperplanes(dimensions, bands * bits, seed), bits)
    filed = coded.select("id", F.posexplode("codes").alias("band", "code"))
    sizes = filed.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = filed.join(sizes, ["band", "code"]).withColumn("of", F.ceil(F.col("n") / F.lit(hot)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("id"), "of").cast("int"))
    left = cut.select("band", "code", F.col("id").alias("ia"), F.col("slice").alias("i"), F.explode(F.expr("sequence(slice, of - 1)")).alias("j"))
    right = cut.select("band", "code", F.col("id").alias("ib"), F.explode(F.expr("sequence(0, slice)")).alias("i"), F.col("slice").alias("j"))
    met = left.join(right, ["band", "code", "i", "j"]).filter((F.col("ia") != F.col("ib")) & ((F.col("i") != F.col("j")) | (F.col("ia") < F.col("ib"))))
    pairs = met.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
    side = lambda x: df.select(F.col(key).alias(f"id_{x}"), F.col(vector).cast("array<double>").alias(f"v{x}"))
    scored = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    return scored.withColumn("score", cosine(F.col("va"), F.col("vb"))).filter(F.col("score") >= threshold).select("id_a", "id_b", "score")


#: Rows of a block of ``tiled_pairs``, and of the part of a block that is compared at a time.
TILE, STRIP = 16_384, 1024


def _blocks(df: DataFrame, key: str, vector: str, dimensions: int, rows: int) -> DataFrame:
    """(block, ids, vectors): rows packed as bytes, at most TILE in a block; ``rows`` is their number."""
    import uuid

    import numpy as np
    import pyarrow as pa

    def packed(ids, flat):
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(flat).tobytes()], pa.binary())], names=["block", "ids", "vectors"])

    def run(batches):
        ids, flat, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TILE - n)
                ids.append(part.column("id").to_numpy())
                flat.append(part.column("v").flatten().to_numpy(zero_copy_only=False))
                at, n = at + part.num_rows, n + part.num_rows
                if n == TILE:
                    yield packed(ids, flat)
                    ids, flat, n = [], [], 0
        if n:
            yield packed(ids, flat)

    sound = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dimensions) & ~F.exists("v", lambda x: x.isNull()))
    return sound.repartition(max(1, -(-rows // TILE))).mapInArrow(run, "block string, ids binary, vectors binary")


class _Tile:
    """Comparison of two packed blocks of vectors."""

    def __init__(self, threshold: float, dimensions: int):
        self.threshold, self.dimensions = threshold, dimensions

    def side(self, ids, vectors):
        """Ids, vectors and unit vectors in single precision of a block."""
        import numpy as np

        v = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, self.dimensions)
        with np.errstate(all="ignore"):
            unit = (v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32)
        return np.frombuffer(ids.as_buffer(), np.int64), v, np.nan_to_num(unit, nan=0.0, posinf=0.0, neginf=0.0)

    def pairs(self, left, right, apart=None):
        """Places i, j and scores of the pairs of two blocks, by parts. ``apart(i, j)`` may drop some before they are scored."""
        import numpy as np

        least = self.threshold - 4e-7 * self.dimensions
        for at in range(0, len(left[0]), STRIP):
            for to in range(at if left is right else 0, len(right[0]), STRIP * 4):
                close = left[2][at : at + STRIP] @ right[2][to : to + STRIP * 4].T
                live = np.nonzero(close.max(axis=1) >= least)[0]
                i, j = np.nonzero(close[live] >= least)
                i, j = live[i] + at, j + to
                if left is right:
                    i, j = i[i < j], j[i < j]
                for part in range(0, len(i), 65_536):
                    x, y = i[part : part + 65_536], j[part : part + 65_536]
                    if apart is not None:
                        kept = apart(x, y)
                        x, y = x[kept], y[kept]
                    score = self.score(left[1][x], right[1][y])
                    kept = (score >= self.threshold) & (left[0][x] != right[0][y])
                    yield x[kept], y[kept], score[kept]

    def score(self, x, y):
        import numpy as np

        def dot(a, b):
            out = np.zeros(len(a))
            for k in range(self.dimensions):  # term by term, as Spark adds them
                out += a[:, k] * b[:, k]
            return out

        with np.errstate(all="ignore"):
            return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def tiled_pairs(df: DataFrame, key: str, vector: str, threshold: float, dimensions: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id_a, id_b, score): all pairs with a cosine of ``threshold`` or more (D4 without a block, complete).

    Every two blocks of rows meet in a task and are compared by products of
    matrices in single precision; what could be a pair within their error is
    scored in double precision, in the order of ``cosine``. Nothing but packed
    blocks is written, and nothing but pairs comes out, so disk follows the rows
    and the answer. The time is quadratic, 64 dimensions at about 4 ns for two rows: where
    that is too much, ``hashed_pairs`` finds them with a probability. Keys are
    integers; vectors of other lengths or of length zero have no pairs.
    ``save`` writes the blocks and rereads them.
    """
    import numpy as np
    import pyarrow as pa

    tile = _Tile(threshold, dimensions)

    def run(batches):
        for batch in batches:
            for a, ids_a, va, b, ids_b, vb in zip(*(batch.column(c) for c in ("a", "ids_a", "va", "b", "ids_b", "vb")), strict=True):
                left = tile.side(ids_a, va)
                right = left if a == b else tile.side(ids_b, vb)
                for i, j, score in tile.pairs(left, right):
                    p, q = left[0][i], right[0][j]
                    yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(score)], names=["id_a", "id_b", "score"])

    blocks = save(_blocks(df, key, vector, dimensions, df.count()))
    side = lambda x: blocks.select(F.col("block").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("vectors").alias(f"v{x}"))
    return side("a").join(side("b"), F.col("a") <= F.col("b")).mapInArrow(run, "id_a long, id_b long, score double")


def tiled_components(df: DataFrame, key: str, vector: str, threshold: float, dimensions: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label): the components of ``tiled_pairs`` at ``threshold``, without its pairs; label is the smallest key.

    A block is written with labels of its own components, their smallest keys. Two blocks then return
    a link for each two labels that they tie for the first time, and none that
    follows from others: among n vectors that are all alike there are n * n / 2
    pairs, but fewer links than labels. Every row that a block takes has a label.
    """
    import numpy as np
    import pyarrow as pa

    tile = _Tile(threshold, dimensions)

    def own(batches):
        for batch in batches:
            for block, ids, v in zip(batch.column("block"), batch.column("ids"), batch.column("vectors"), strict=True):
                side = tile.side(ids, v)
                trees = Trees(len(side[0]))
                for i, j, _ in tile.pairs(side, side, lambda x, y: trees.root[x] != trees.root[y]):  # noqa: B023
                    trees.tie(i, j)
                least = side[0].copy()
                np.minimum.at(least, trees.root, side[0])
                columns = [block.as_py().encode(), ids.as_py(), v.as_py(), least[trees.root].tobytes()]
                yield pa.record_batch([pa.array([c], pa.binary()) for c in columns], names=["block", "ids", "vectors", "labels"])

    def run(batches):
        for batch in batches:
            for columns in zip(*(batch.column(c) for c in ("ids_a", "va", "la", "ids_b", "vb", "lb")), strict=True):
                left, right = tile.side(*columns[:2]), tile.side(*columns[3:5])
                labels, at = np.unique(np.concatenate([np.frombuffer(columns[c].as_buffer(), np.int64) for c in (2, 5)]), return_inverse=True)
                trees, mine, other = Trees(len(labels)), at[: len(left[0])], at[len(left[0]) :]
                for i, j, _ in tile.pairs(left, right, lambda x, y: trees.root[mine[x]] != trees.root[other[y]]):  # noqa: B023
                    new = trees.tie(mine[i], other[j])
                    if len(new):
                        yield pa.record_batch([pa.array(labels[mine[i[new]]]), pa.array(labels[other[j[new]]])], names=["a", "b"])

    def unpacked(batches):
        for batch in batches:
            for ids, labels in zip(batch.column("ids"), batch.column("labels"), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (ids, labels)], names=["node", "own"])

    blocks = save(_blocks(df, key, vector, dimensions, df.count()).mapInArrow(own, "block binary, ids binary, vectors binary, labels binary"))
    side = lambda x: blocks.select(F.col("block").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("vectors").alias(f"v{x}"), F.col("labels").alias(f"l{x}"))
    tied = save(spanning_links(side("a").join(side("b"), F.col("a") < F.col("b")).mapInArrow(run, "a long, b long")))
    # A key of several rows is one node, whatever their labels.
    rows = save(blocks.select("ids", "labels").mapInArrow(unpacked, "node long, own long").groupBy("node").agg(F.sort_array(F.collect_set("own")).alias("own")))
    same = rows.select(F.col("own")[0].alias("a"), F.explode("own").alias("b"))
    labels = connected_components(spanning_links(tied.coalesce(8)).unionByName(same.filter("a != b")), "a", "b", save).withColumnsRenamed({"node": "named"})
    return rows.join(labels, F.col("own")[0] == F.col("named"), "left").select("node", F.coalesce("label", F.col("own")[0]).alias("label"))


def time_matches(df: DataFrame, key: str, on: Sequence[str], time_col: str, seconds: int) -> DataFrame:
    """Pairs that agree on ``on`` and are at most ``seconds`` apart.

    Times are cut into slots of that length; a row meets its own slot and the next.
    """
    slot = F.floor(F.unix_micros(time_col) / F.lit(seconds * 1_000_000)).cast("long")
    a = df.select(*on, F.col(key).alias("id_a"), F.col(time_col).alias("ta"), F.explode(F.array(slot, slot + 1)).alias("slot"), slot.alias("own"))
    b = df.select(*on, F.col(key).alias("id_b"), F.col(time_col).alias("tb"), slot.alias("slot"))
    gap = F.unix_micros("tb") - F.unix_micros("ta")
    later = (gap > 0) | ((gap == 0) & (F.col("id_a") < F.col("id_b")))
    return a.join(b, [*on, "slot"]).filter(later & (gap <= seconds * 1_000_000)).select(*on, "id_a", "id_b", (gap / F.lit(1_000_000)).alias("seconds"))


def array_matches(df: DataFrame, key: str, entities: str, topics: str, time_col: str, seconds: int) -> DataFrame:
    """Pairs that share an entity and a topic and are at most ``seconds`` apart (D5 on arrays).

    Entity, topic and time slot are all part of the key, so rows that share no
    topic never meet, however common their entity is.
    """
    slot = F.floor(F.unix_micros(time_col) / F.lit(seconds * 1_000_000)).cast("long")
    rows = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(entities)).alias("entity"), F.array_distinct(topics).alias("topics"), F.unix_micros(time_col).alias("us"), slot.alias("slot"))
    rows = rows.select("id", "entity", F.explode("topics").alias("topic"), "us", "slot")
    a = rows.withColumnsRenamed({"id": "id_a", "us": "us_a"}).withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))
    b = rows.withColumnsRenamed({"id": "id_b", "us": "us_b"})
    gap = F.col("us_b") - F.col("us_a")
    later = (gap > 0) | ((gap == 0) & (F.col("id_a") < F.col("id_b")))
    met = a.join(b, ["entity", "topic", "slot"]).filter(later & (gap <= seconds * 1_000_000))
    return met.groupBy("id_a", "id_b").agg(F.array_sort(F.collect_set("entity")).alias("shared_entities"))


def review_proposals(proposals: DataFrame, registry: DataFrame, key: str, least: float) -> DataFrame:
    """What a model proposes (D19), with a verdict: proposals are never state, and at best go to a reviewer."""
    known = proposals.join(registry.filter("enabled").select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    verdict = F.when(F.col("__known").isNull(), "unknown_subject").when(F.col("confidence").isNull() | (F.col("confidence") < least), "too_unsure").otherwise("to_review")
    return known.withColumn("verdict", verdict).drop("__known")


def propose_merges(pairs: DataFrame, threshold: float, rejected: DataFrame | None = None) -> DataFrame:
    """Merge proposals with their decision (D8, D9); a rejected pair is not proposed again."""
    pair = pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "score")
    if rejected is not None:
        gone = rejected.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
        pair = pair.join(gone, ["id_a", "id_b"], "left_anti")
    return pair.withColumn("decision", F.when(F.col("score") >= threshold, "auto_accepted").otherwise("pending"))


def resolve_merges(ids: DataFrame, key: str, accepted: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each id with the smallest id it is merged with, transitively."""
    labels = connected_components(accepted, "id_a", "id_b", save)
    return ids.select(key).join(labels, F.col(key) == F.col("node"), "left").select(key, F.coalesce("label", key).alias("canonical_id"))


def corroboration(items: DataFrame, event: str, source: str) -> DataFrame:
    """Independent sources of each event (D13): a source that repeats itself counts once."""
    return items.groupBy(event).agg(F.count(F.lit(1)).alias("items"), F.count_distinct(source).alias("independent_sources"))


def materialize_events(items: DataFrame, event: str, time_col: str, arrays: Sequence[str]) -> DataFrame:
    """One row for each event: first and last report, number of items, merged sorted arrays."""
    merged = [F.array_sort(F.collect_set(c)).alias(c) for c in arrays]
    return items.groupBy(event).agg(F.min(time_col).alias("first_reported"), F.max(time_col).alias("last_updated"), F.count(F.lit(1)).alias("items"), *merged)


def may_move_state(reliability: Column, sources: Column, materiality: Column | None = None, threshold: float = 0.0) -> Column:
    """Reliability gate (D16): A moves state; B with a second source; C is evidence; D is radar only.

    With ``materiality`` also the anti-hype gate (D17): what is below ``threshold``
    or unknown moves no state, however reliable; of A and B it is evidence.
    """
    reliable = (reliability == "A") | ((reliability == "B") & (sources >= 2))
    moves = reliable if materiality is None else reliable & (materiality >= threshold)
    return F.when(moves, "moves_state").when(reliability.isin("A", "B", "C"), "evidence").otherwise("radar")


def source_learning(items: DataFrame, source: str, event: str, time_col: str, tie: str, noise: str) -> DataFrame:
    """Rates at which a source is corroborated, leads, and is noise."""
    per_event = items.groupBy(event).agg(F.count_distinct(source).alias("sources"), F.min_by(F.col(source), F.struct(time_col, tie)).alias("leader"))
    rows = items.join(per_event, event)
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg((F.col("sources") >= 2).cast("double")).alias("corroborated_rate"),
        F.avg((F.col("leader") == F.col(source)).cast("double")).alias("led_rate"),
        F.avg(F.col(noise).cast("double")).alias("noise_rate"),
    )


def validate(proposals: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Proposals with the names of the checks they fail, and whether they are accepted (V1). A check that is null fails."""
    failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return proposals.withColumn("failed", failed).withColumn("accepted", F.size("failed") == 0)


def known_keys(proposals: DataFrame, registry: DataFrame, key: str, known: bool = True) -> DataFrame:
    """Proposals whose key is (or is not) in the enabled registry (V3)."""
    return proposals.join(registry.filter("enabled").select(key), key, "left_semi" if known else "left_anti")


def active_objectives(objectives: DataFrame) -> DataFrame:
    """Objectives an engine may read (V4, V5): accepted, not drafts, and not written by a model in the owner's name."""
    return objectives.filter(F.col("accepted_at").isNotNull() & (F.col("status") != "draft") & ~((F.col("authored_by") == "owner") & F.col("from_model")))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key by a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
