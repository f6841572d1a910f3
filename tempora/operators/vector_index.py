"""A vector index: inverted lists of trained centroids, product-quantised residuals, exact re-ranking (M2).

``fit`` trains on a bounded sample; ``build`` files every vector under its nearest
centroid with a code of what remains, and the length of what the code leaves out.
The postings of a list are packed, with their vectors, into blocks of about
``BLOCK``; a list that holds a third of all vectors is many blocks. Queries are
packed too, and every block of queries meets every block of postings: nothing
but packed blocks is shuffled, and a task gives back what can still be among the
k best, not what it compared.

``search`` looks into the ``probes`` nearest lists, takes the ``rerank`` best
estimates of a block (by look-up tables) and ranks them by their cosine. With
``exact`` a second pass makes the answer complete: the distance to the k-th
answer so far bounds what could still be missing. A list is opened if its
centroid's distance less its radius is within the bound (the triangle
inequality), and then all of its vectors are compared by one product of matrices.
Products are in single precision; what is within their error of the k-th answer
stays, and Spark ranks it by the cosine in double precision. No partner is lost.

Vectors are compared by cosine: they are scaled to length one, where the order by
distance is the order by cosine. Null vectors, those of length zero and of other
sizes are not filed and not found. Ties go to the smaller key. Keys are integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.identity import cosine

BLOCK, QUERIES = 4096, 2048
#: Blocks of queries that a task keeps at a time.
HELD = 12
#: What rounding may add to a distance.
_SLACK = 1e-6


@dataclass
class Model:
    """Centroids (lists x size) and one codebook (entries x size / parts) for each part of the residual."""

    centroids: np.ndarray
    books: list[np.ndarray]
    #: What a search looks at unless told otherwise.
    probes: int = 8
    rerank: int = 100

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centroids)

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(p, b) for p, b in zip(np.split(residuals, len(self.books), axis=1), self.books, strict=True)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0)


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(a[at : at + 8192], b).argmin(axis=1) for at in range(0, len(a), 8192)]) if len(a) else np.empty(0, np.int64)


def _kmeans(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres after ``rounds`` of Lloyd's steps from evenly spread first points; an empty centre stays."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(points, centres)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, points)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centres


def _unit(column: pa.Array, size: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & sound)


def _calibrated(model: Model, points: np.ndarray, rows: int, k: int, recall: float) -> Model:
    """The model with the probes and the re-ranked estimates that find ``recall`` of the true neighbours inside the sample.

    A sample's neighbours are further away than those of the whole table, and so
    lie in more lists: what suffices here suffices there.
    """
    part = (1 + recall) / 2  # either step may lose half of what may be lost
    asked = points[:: max(1, len(points) // 200)]
    away = _distances(asked, points)
    true = np.argsort(away, axis=1, kind="stable")[:, :k]
    order = np.argsort(np.argsort(_distances(asked, model.centroids), axis=1), axis=1)
    in_list = model.lists_of(points)
    place = np.take_along_axis(order, in_list[true], axis=1)
    kept = model.centroids[in_list] + model.decoded(model.codes(points - model.centroids[in_list]))
    estimate = _distances(asked, kept)
    better = np.stack([(estimate < np.take_along_axis(estimate, true[:, j : j + 1], axis=1)).sum(axis=1) for j in range(true.shape[1])], axis=1)
    model.probes = int(np.quantile(place, part, method="higher")) + 1
    model.rerank = max(2 * k, math.ceil((int(np.quantile(better, part, method="higher")) + 1) * max(1.0, rows / len(points))))
    return model


def fit(
    df: DataFrame, key: str, vector: str, size: int,
    lists: int | None = None, parts: int = 8, sample: int = 20_000, rounds: int = 8, k: int = 10, recall: float = 0.95,
) -> Model:
    """Centroids and codebooks from at most ``sample`` vectors, drawn by a hash of their keys.

    Unless given, the number of lists is the square root of the number of
    vectors, and at most a sixteenth of the sample. How many lists a search opens
    and how many estimates it checks follow from the sample too, so that the
    ``k`` nearest are found with probability ``recall``.
    """
    usable = _usable(df, key, vector, size)
    drawn = usable.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not drawn.num_rows:
        return Model(np.zeros((1, size)), [np.zeros((1, size // parts))] * parts)
    points = _unit(drawn.column("v").combine_chunks(), size)
    count = usable.count()
    n = max(1, min(lists or round(math.sqrt(count)), -(-len(points) // 16)))
    centroids = _kmeans(points, n, rounds)
    rest = points - centroids[_nearest(points, centroids)]
    entries = max(1, min(256, len(points) // 4))
    model = Model(centroids, [_kmeans(p, entries, rounds) for p in np.split(rest, parts, axis=1)])
    return _calibrated(model, points, count, min(k, len(points)), recall)


def build(df: DataFrame, key: str, vector: str, model: Model) -> DataFrame:
    """(list, block, radius, entries): the packed postings of every vector by id; radius is the largest distance from the centroid in the list."""
    size = model.centroids.shape[1]

    def run(batches):
        for batch in batches:
            unit = _unit(batch.column("v"), size)
            at = model.lists_of(unit)
            rest = unit - model.centroids[at]
            codes = model.codes(rest)
            lost = np.sqrt(((rest - model.decoded(codes)) ** 2).sum(axis=1))
            away = np.sqrt((rest * rest).sum(axis=1))
            plain = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            packed = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, plain)]
            yield pa.record_batch([pa.array(at, pa.int32()), batch.column("id"), packed[0], pa.array(lost), pa.array(away), packed[1]], names=["list", "id", "code", "lost", "away", "v"])

    filed = _usable(df, key, vector, size).mapInArrow(run, "list int, id long, code binary, lost double, away double, v binary")
    sizes = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"), F.max("away").alias("radius"))
    dealt = filed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return dealt.groupBy("list", "block").agg(F.max("radius").alias("radius"), F.array_sort(F.collect_list(F.struct("id", "code", "lost", "v"))).alias("entries"))


def _estimates(model: Model, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
    """Distances (queries x vectors) to what the codes of one list stand for, by look-up tables."""
    near = queries - model.centroids[at]
    out = np.zeros((len(queries), len(codes)))
    for p, (q, b) in enumerate(zip(np.split(near, len(model.books), axis=1), model.books, strict=True)):
        out += _distances(q, b)[:, codes[:, p]]
    return np.sqrt(out)


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors with fewer than k equal ones before them: of equal vectors only the smallest keys can be answers."""
    if np.unique(vectors[:, 0], return_counts=True)[1].max() <= k:
        return np.arange(len(vectors))
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    starts = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return np.sort(order[nth < k])


class _Best:
    """A block of queries and what can still be among their k best, while blocks of postings pass by."""

    def __init__(self, asked: pa.StructArray, model: Model, k: int, probes: int | None, rerank: int):
        size = model.centroids.shape[1]
        self.model, self.k, self.rerank, self.error = model, k, rerank, 4e-7 * size
        self.qid, self.bound = asked.field("qid").to_numpy(), asked.field("bound").to_numpy()
        self.unit = _unit(asked.field("v"), size)
        self.away = np.sqrt(_distances(self.unit, model.centroids))
        self.single = self.unit.astype(np.float32)
        self.probed = None
        if probes is not None:
            take = min(probes, len(model.centroids))
            self.probed = np.zeros(self.away.shape, bool)
            np.put_along_axis(self.probed, np.argpartition(self.away, take - 1, axis=1)[:, :take], True, axis=1)
        # The k best scores so far; what is known beforehand stands for the k-th.
        self.best = np.repeat((1 - self.bound**2 / 2 - self.error).astype(np.float32)[:, None], k, axis=1)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, at: int, radius: float, entries: pa.StructArray) -> None:
        opened = np.nonzero(self.probed[:, at] if self.probed is not None else self.away[:, at] - radius <= self.bound + _SLACK)[0]
        if not len(opened):
            return
        ids = entries.field("id").to_numpy()
        vectors = np.frombuffer(b"".join(entries.field("v").to_pylist()), np.float64).reshape(len(ids), -1)
        kept = _first_copies(vectors, self.k)
        ids, vectors = ids[kept], vectors[kept]
        unit = (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]).astype(np.float32)
        scores = self.single[opened] @ unit.T
        if self.probed is not None and len(ids) > self.rerank:
            codes = np.frombuffer(b"".join(entries.field("code").to_pylist()), np.uint8).reshape(len(entries), -1)[kept]
            estimated = _estimates(self.model, self.unit[opened], at, codes)
            np.put_along_axis(scores, np.argpartition(estimated, self.rerank - 1, axis=1)[:, self.rerank :], -np.inf, axis=1)
        live = scores.max(axis=1) >= self.best[opened, 0] - self.error
        opened, scores = opened[live], scores[live]
        hit = scores >= (self.best[opened, 0] - self.error)[:, None]
        many = np.nonzero(hit.sum(axis=1) > 4 * self.k)[0]
        if len(many):
            hit[many] &= scores[many] >= np.partition(scores[many], -self.k, axis=1)[:, -self.k, None] - self.error
        row, col = np.nonzero(hit)
        if not len(row):
            return
        n = np.bincount(row, minlength=len(opened))
        wide = np.full((len(opened), n.max()), -np.inf, np.float32)
        wide[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = scores[row, col]
        self.best[opened] = np.sort(np.concatenate([self.best[opened], wide], axis=1), axis=1)[:, -self.k :]
        self.found.append((opened[row], ids[col], scores[row, col]))

    def batch(self) -> pa.RecordBatch:
        q, i, s = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)), *self.found, strict=True))
        stay = s >= self.best[q, 0] - self.error
        return pa.record_batch([pa.array(self.qid[q[stay]]), pa.array(i[stay]), pa.array(s[stay].astype(np.float64))], names=["qid", "id", "score"])


def _candidates(asked: DataFrame, postings: DataFrame, model: Model, k: int, probes: int | None, rerank: int) -> DataFrame:
    """(qid, id): what can be among the k best of each query, in the ``probes`` nearest lists or, without, in all that are within its bound."""

    def run(batches):
        held: dict[int, _Best] = {}
        for batch in batches:
            for chunk, a, at, radius, e in zip(batch.column("chunk").to_pylist(), batch.column("asked"), batch.column("list").to_pylist(), batch.column("radius").to_pylist(), batch.column("entries"), strict=True):
                if chunk not in held and len(held) == HELD:  # met again, it begins anew and only gives back more
                    yield held.pop(next(iter(held))).batch()
                if chunk not in held:
                    held[chunk] = _Best(a.values, model, k, probes, rerank)
                held[chunk].meet(at, radius, e.values)
        for best in held.values():
            yield best.batch()

    met = asked.crossJoin(postings.select("list", "radius", "entries")).mapInArrow(run, "qid long, id long, score double")
    kth = F.nth_value("score", k).over(Window.partitionBy("qid").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return met.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("score") >= F.col("kth") - 4e-7 * model.centroids.shape[1])).select("qid", "id")


def _packed(asked: DataFrame, n: int) -> DataFrame:
    """(chunk, asked): n queries of (id, v, bound), about QUERIES in a block."""
    chunks = max(1, -(-n // QUERIES))
    rows = asked.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.struct(F.col("id").alias("qid"), "v", "bound").alias("q"))
    return rows.groupBy("chunk").agg(F.collect_list("q").alias("asked")).coalesce(chunks)


def _ranked(found: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query by their true cosine."""
    v, q = vectors.withColumnRenamed("v", "vb"), asked.select(F.col("id").alias("qid"), F.col("v").alias("va"))
    scored = found.select("qid", "id").join(v, "id").join(q, "qid").select("qid", "id", cosine(F.col("va"), F.col("vb")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(
    postings: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int,
    probes: int | None = None, rerank: int | None = None, exact: bool = False,
) -> DataFrame:
    """(qid, id, score, rank): the k vectors of highest cosine for each row of ``queries`` (one row for each key)."""
    size = model.centroids.shape[1]
    probes, rerank = probes or model.probes, rerank or model.rerank
    base, asked = _usable(vectors, key, vector, size), _usable(queries, key, vector, size)
    n = asked.count()
    top = _ranked(_candidates(_packed(asked.withColumn("bound", F.lit(2.0)), n), postings, model, k, probes, rerank), base, asked, k)
    if not exact:
        return top
    # The k-th best so far, as a distance of vectors of length one; a query with fewer answers has no bound yet.
    worst = top.groupBy("qid").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
    limit = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))).otherwise(F.lit(2.0))
    bounded = asked.join(worst.select(F.col("qid").alias("id"), limit.alias("bound")), "id", "left").select("id", "v", F.coalesce("bound", F.lit(2.0)).alias("bound"))
    return _ranked(_candidates(_packed(bounded, n), postings, model, k, None, rerank), base, asked, k)
