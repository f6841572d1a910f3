"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

Vectors become integers, ``floor(4096 * x)``, and are cut into equal parts; every
part position has a codebook of 16 entries, trained by rounds of assigning each
part to its nearest entry and replacing entries by the floor of their parts'
mean. All arithmetic is on integers, so every run and every partitioning gives
the same codes.

The nearest entry is found by a vector-approximation file. The coordinates of a
codebook's entries are quantised to ``BITS`` bits, so an entry is a row of cells.
For a query part, one table for each coordinate has the squared distances to the
near and to the far edge of every cell; sums over an entry's cells are a lower and
an upper bound of its distance. Only entries whose lower bound does not exceed the
least upper bound can be nearest, and only those are compared by their integer
distances, of which ties go to the lower index.

A round is one scan. Each task adds up its own parts by entry and hands over one
row for each entry, so what is shuffled and what the driver gets (the sums of 128
entries) does not grow with the table. The first 16 vectors, by id, are the only
rows that the driver ever sees.

``label_error`` adds up errors over a label. Labels that hold more than one in
``HOT`` of all rows (so there are fewer than ``HOT`` of them, whatever the table)
are broadcast; all others are joined.

Defined cases: rows whose vector is null or holds a null, NaN or infinite
component go; ids that are null come last among the first 16, and of equal ids the
smaller vector comes first; repeated rows are rows of their own; fewer than 16
rows make a codebook of as many entries; null labels are one label; an empty table
gives an empty result; other columns are not read. Vectors of different lengths,
or of a length that the number of parts does not divide, raise. Components may be
as large as 2 ** 40 as integers: where the distances may not fit into 64 bits, Python's
integers work them out, and an error, or a sum of errors, beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a coordinate's cell.
BITS = 3
#: A label with more than one in so many rows is broadcast.
HOT = 1000
_LIMIT = 1 << 40


def integers(column: pa.Array, length: int | None) -> np.ndarray:
    """The vectors of a list column without nulls as rows of ``floor(SCALE * x)``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != (sizes[0] if length is None else length)).any():
        raise ValueError("vectors of different lengths")
    out = np.floor(flat * SCALE)
    if len(out) and np.abs(out).max() > _LIMIT:
        raise ValueError("a component is too large")
    return out.astype(np.int64).reshape(len(sizes), -1)


class Cells:
    """The vector-approximation file of one codebook (rows of integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = 1 << BITS
        low, high = entries.min(axis=0), entries.max(axis=0)
        width = (high - low) // n + 1
        self.cell = (entries - low) // width
        steps = np.arange(n)[None, :]
        #: First and last integer of every cell of every coordinate.
        self.first = low[:, None] + steps * width[:, None]
        self.last = self.first + width[:, None] - 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, and its squared distance."""
        rows, k = len(parts), len(self.entries)
        lower, upper = np.zeros((rows, k), parts.dtype), np.zeros((rows, k), parts.dtype)
        for j in range(parts.shape[1]):
            x = parts[:, j, None]
            below, above = self.first[j] - x, x - self.last[j]
            outside = np.maximum(np.maximum(below, above), 0)
            furthest = np.maximum(np.abs(below), np.abs(above))
            near, far = outside * outside, furthest * furthest  # the look-up tables of this coordinate
            lower += near[:, self.cell[:, j]]
            upper += far[:, self.cell[:, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        away = parts[row] - self.entries[entry]
        distance = (away * away).sum(axis=1)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(distance, start) if rows else distance
        hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.r_[start, len(row)])))
        first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if rows else hit
        return entry[first], best


def assign(vectors: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, a column for each part."""
    width = vectors.shape[1] // len(books)
    large = max([int(np.abs(vectors).max(initial=0)), *(int(np.abs(b.entries).max(initial=0)) for b in books)])
    exact = vectors.astype(object) if (2 * large + 2) ** 2 * vectors.shape[1] * 4 >= 1 << 63 else vectors
    found = [b.nearest(exact[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(kept: DataFrame, books: list[np.ndarray], length: int) -> list:
    """(part, entry, n, sums) of every entry that some part is nearest to."""
    width = length // PARTS
    names = [f"s{j}" for j in range(width)]

    def run(batches):
        cells = [Cells(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            vectors = integers(batch.column("vector"), length)
            index, _ = assign(vectors, cells)
            for p in range(PARTS):
                n[p] += np.bincount(index[:, p], minlength=len(books[p]))
                added = np.zeros(books[p].shape, np.int64)
                np.add.at(added, index[:, p], vectors[:, p * width : (p + 1) * width])
                total[p] += added.astype(object)
        rows = [(p, e, int(n[p][e]), *map(int, total[p][e])) for p in range(PARTS) for e in range(len(books[p])) if n[p][e]]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.decimal128(38)] * width]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "n", *names])

    shares = kept.select("vector").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{s} decimal(38,0)" for s in names))
    return shares.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect()


def finite(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """The rows whose vector is not null and has finite components only."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("vector"), *[col(c).alias(a) for c, a in zip(others, ("label",), strict=False)])
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", odd))


def train(kept: DataFrame) -> list[np.ndarray]:
    """The codebooks of rows (vec_id, vector): one for each part position."""
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    if not first:
        return []
    vectors = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), None)
    length = vectors.shape[1]
    if not length or length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} parts")
    books = [b.copy() for b in np.split(vectors, PARTS, axis=1)]
    for _ in range(ROUNDS):
        for r in _sums(kept, books, length):
            books[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(length // PARTS)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (binary, an index for each part) and error of every row of (vec_id, vector, label)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    length = sum(b.shape[1] for b in books)

    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in batches:
            index, distance = assign(integers(batch.column("vector"), length), cells)
            error = [e if e < 1 << 63 else None for e in distance.sum(axis=1).tolist()]
            code = pa.array(list(map(bytes, index.tolist())), pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), code, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(coded: DataFrame, books: list[np.ndarray], code_col: str = "code", out_col: str = "vector") -> DataFrame:
    """The rows with the vector that their code stands for, as numbers."""
    tables = [F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in b.tolist()]) for b in books]
    places = [F.conv(F.hex(F.substring(col(code_col), p + 1, 1)), 16, 10).cast("int") + 1 for p in range(len(books))]
    return coded.withColumn(out_col, F.concat(*[F.element_at(t, k) for t, k in zip(tables, places, strict=True)]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows of (label, error, ...) with the sum of the errors of their label; null errors are left out of it."""
    sums = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n")), "codes-labels")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    total = F.col("total").try_cast("long").alias("label_error")
    side = lambda df: df.select(F.col("label").alias("of"), total)
    hot, cold = side(sums.filter(F.col("n") * HOT > rows)), side(sums.filter(F.col("n") * HOT <= rows))
    same = F.col("label").eqNullSafe(F.col("of"))
    often = coded.join(F.broadcast(hot), same).drop("of")
    seldom = coded.join(F.broadcast(hot), same, "left_anti").join(cold.hint("merge"), same).drop("of")
    return often.unionByName(seldom)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error and label_error of every kept row, and the codebooks."""
    kept = finite(df, id_col, vector_col, label_col)
    books = train(kept)
    if not books:
        none = kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.filter("false"), books
    return with_label_error(materialize(encode(kept, books), "codes")), books
