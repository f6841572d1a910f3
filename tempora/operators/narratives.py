"""Assignment of events to narratives, run by run.

A narrative is the sum of the vectors (of length one) of its events, and their
number; its direction is its centroid. A run assigns each new event to the
narrative whose centroid has the highest cosine with it, if that is ``threshold``
or more; no narrative is the answer otherwise. What is left over is grouped by
leaders: in an order drawn by a hash, an event leads if no event that leads
already is like it, and others follow the leader they are most like. Groups of
``least`` events become candidate narratives. Old events are never read again: a
run adds its own sums to those of the version before.

The greedy choice of leaders is made by all tasks at once: of the events not yet
decided, those without an undecided neighbour before them lead, and what is like
them follows. In a random order this takes a number of rounds logarithmic in the
number of events, and gives what one pass in that order would give.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators import vector_index

#: Numbers in the centroids that are sent to every task; more centroids than that are looked up in an index.
MOST_SENT = 1 << 22


def _sound(df: DataFrame, key: str, vector: str, size: int, *others: str) -> DataFrame:
    v = F.col("v")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *others)
    return rows.filter((F.size(v) == size) & ~odd & F.exists(v, lambda x: x != 0))


def sums(events: DataFrame, narrative: str, key: str, vector: str, size: int) -> DataFrame:
    """(narrative, total, n) of the events that have a narrative: a row for each task and narrative, then one for each narrative."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy().reshape(-1, size)
            rows = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
            for name, row in zip(batch.column(narrative).to_pylist(), rows, strict=True):
                held = total.setdefault(name, [np.zeros(size), 0])
                held[0] += row
                held[1] += 1
        schema = pa.schema([batch_field, ("total", pa.list_(pa.float64())), ("n", pa.int64())])
        yield pa.record_batch([pa.array(list(total), batch_field.type), pa.array([t.tolist() for t, _ in total.values()], pa.list_(pa.float64())), pa.array([n for _, n in total.values()], pa.int64())], schema=schema)

    rows = _sound(events.filter(F.col(narrative).isNotNull()), key, vector, size, narrative)
    kind = rows.schema[narrative].dataType.simpleString()
    batch_field = pa.field(narrative, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind])
    return merged(rows.select(narrative, "v").mapInArrow(run, f"{narrative} {kind}, total array<double>, n long"), narrative)


def merged(parts: DataFrame, narrative: str) -> DataFrame:
    """One row for each narrative of (narrative, total, n) rows, such as two versions' or many tasks'."""
    n = parts.groupBy(narrative).agg(F.sum("n").alias("n"))
    at = parts.select(narrative, F.posexplode("total").alias("at", "x")).groupBy(narrative, "at").agg(F.sum("x").alias("x"))
    total = at.groupBy(narrative).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("total"))
    return total.join(n, narrative).select(narrative, "total", "n")


def assign(events: DataFrame, centroids: DataFrame, narrative: str, key: str, vector: str, size: int, threshold: float) -> DataFrame:
    """(id, v, narrative, score) of every sound event: its nearest narrative, or null where none is near enough; ties go to the smaller name."""
    rows = _sound(events, key, vector, size)
    kind = centroids.schema[narrative].dataType.simpleString()
    known = centroids.filter("n > 0").count()
    if known * size > MOST_SENT:
        return _assigned_by_index(rows, centroids, narrative, size, threshold)
    named = sorted(((r[narrative], r["total"]) for r in centroids.filter("n > 0").select(narrative, "total").collect()), key=lambda r: r[0])
    names = pa.array([n for n, _ in named], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind])
    matrix = np.array([t for _, t in named]).reshape(-1, size)
    matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-300)[:, None]

    def run(batches):
        for batch in batches:
            unit = batch.column("v").flatten().to_numpy().reshape(-1, size)
            unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
            score = unit @ matrix.T if len(matrix) else np.full((len(unit), 1), -2.0)
            best = score.argmax(axis=1)
            top = score[np.arange(len(unit)), best]
            near = top >= threshold
            found = names.take(pa.array(best, mask=~near)) if len(matrix) else pa.nulls(len(unit), names.type)
            yield pa.record_batch([batch.column("id"), batch.column("v"), found, pa.array(top, mask=~near)], names=["id", "v", narrative, "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, {narrative} {kind}, score double")


def _assigned_by_index(rows: DataFrame, centroids: DataFrame, narrative: str, size: int, threshold: float) -> DataFrame:
    numbered = centroids.filter("n > 0").select(narrative, "total", F.xxhash64(narrative).alias("number"))
    model = vector_index.fit(numbered, "number", "total", size)
    asked = rows.select(F.xxhash64("id").alias("q"), "id", "v")
    found = vector_index.search(vector_index.build(numbered, "number", "total", model), model, numbered.select("number", "total"), asked.select("q", F.col("v").alias("total")).withColumnRenamed("q", "number"), "number", "total", 1, exact=True)
    near = found.filter(F.col("score") >= threshold).join(numbered.select(F.col("number").alias("id"), narrative), "id").select(F.col("qid").alias("q"), narrative, "score").dropDuplicates(["q"])
    return asked.join(near, "q", "left").select("id", "v", narrative, "score")


def drawn(key: str) -> list[Column]:
    """The order in which events may lead: by a digest of their key, then the key."""
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def followers(pairs: DataFrame, save: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """(id, leader, score) of the events that follow one; ``pairs`` has (id_a, id_b, score) of all events that are alike, each pair once.

    Whoever is not in the result leads. Raises if the rounds do not suffice.
    """
    first = F.struct(F.md5(F.col("id_a").cast("string")), F.col("id_a")) < F.struct(F.md5(F.col("id_b").cast("string")), F.col("id_b"))
    ends = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    ordered = save(pairs.filter("id_a IS NOT NULL AND id_b IS NOT NULL AND id_a != id_b").select(ends("id_a", "id_b").alias("a"), ends("id_b", "id_a").alias("b"), "score"))
    edges, covered = ordered, ordered.select(F.col("b").alias("id")).filter("false")
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        # Those that nothing undecided comes before lead; who is like one of them follows.
        lead = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = save(edges.join(lead, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        covered = covered.unionByName(now)
        edges = edges.join(lead, "a", "left_anti")
        for end in ("a", "b"):
            edges = edges.join(now.withColumnRenamed("id", end), end, "left_anti")
        edges = save(edges.select("a", "b", "score"))
    else:
        raise RuntimeError(f"the leaders are not decided in {max_rounds} rounds")
    covered = save(covered)
    led = ordered.join(covered.withColumnRenamed("id", "a"), "a", "left_anti").join(covered.withColumnRenamed("id", "b"), "b", "left_semi")
    nearest = F.max_by(F.struct("a", "score"), F.struct(F.col("score"), -F.col("a"))).alias("to")
    return led.groupBy(F.col("b").alias("id")).agg(nearest).select("id", F.col("to.a").alias("leader"), F.col("to.score").alias("score"))


def candidates(left_over: DataFrame, key: str, pairs: DataFrame, save: Callable[[DataFrame], DataFrame], least: int = 2) -> DataFrame:
    """(key, narrative) of the events of new narratives: groups of ``least`` or more, named after their leader."""
    led = save(followers(pairs, save))
    every = left_over.select(F.col(key).alias("id")).distinct().join(led.select("id", "leader"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    large = every.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return every.join(large, "leader").select(F.col("id").alias(key), F.concat(F.lit("candidate:"), F.col("leader").cast("string")).alias("narrative"))
