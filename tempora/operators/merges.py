"""Stored merge decisions, their replay, and components that are kept up as edges arrive.

A proposal is a row of ``event_merge_proposal``: the pair, how it was found, the
threshold that was applied and the decision. A pair that has a stored decision
is not judged again, whatever model or threshold a later run has, so a replay
reads decisions and recomputes no similarity. Decisions are appended; the last
one at an instant holds, and of two at the same instant the owner's.

Components are two append-only tables below a folder:

* ``member``: a node and the label of its component when it was first linked;
* ``move``: a label that was absorbed, and the label that now stands for it.

A run maps the ends of its edges to current labels, closes the few labels that
its edges tie together, and appends what that changes. Old edges are never read
again, nodes that are not ends of a new edge are not touched, and a label that
moves costs one row, not one for each of its nodes. Both tables are dealt into
buckets by a hash, each a folder, so nodes and labels are looked up in the buckets
of the new ends only. The moves, one row for each absorbed label, are read whole
only to let labels absorbed before follow those that move now.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.closure import connected_components
from tempora.operators.temporal import instant, latest_as_of
from tempora.sources.tables import exists

#: What can be decided about a proposal, and who decides.
DECISIONS, DECIDERS = ("auto_accepted", "pending", "accepted", "rejected"), ("system", "owner")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("source_event_id"), F.greatest(a, b).alias("target_event_id")]


def record_proposals(pairs: DataFrame, stored: DataFrame, run_id: str, decided_at: str, method: str, threshold: float, model_version: str | None = None) -> DataFrame:
    """The proposals to append for (id_a, id_b, score): those pairs that no stored proposal knows.

    At or above ``threshold`` a pair is accepted by the system (D9), else it waits
    for the owner. A rejected pair is known too, so it is not proposed again (D10).
    """
    ends = ["source_event_id", "target_event_id"]
    text = pairs.select(F.col("id_a").cast("string").alias("a"), F.col("id_b").cast("string").alias("b"), "score").filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    best = text.select(*_pair("a", "b"), "score").groupBy(*ends).agg(F.max("score").alias("score"))
    new = best.join(stored.select(*_pair(*ends)).distinct(), ends, "left_anti")
    return new.select(
        F.sha2(F.to_json(F.struct(*ends)), 256).alias("id"), F.lit(run_id).alias("run_id"), *ends, F.lit(method).alias("method"), "score", F.lit(model_version).cast("string").alias("model_version"),
        F.lit(threshold).cast("double").alias("threshold_applied"), F.when(F.col("score") >= threshold, "auto_accepted").otherwise("pending").alias("decision"), instant(decided_at).alias("decided_at"), F.lit("system").alias("decided_by"),
    )


def record_decisions(stored: DataFrame, chosen: DataFrame, run_id: str, decided_at: str) -> DataFrame:
    """The rows to append for what the owner decides of stored proposals: ``chosen`` has (id, decision)."""
    first = stored.groupBy("id").agg(F.min_by(F.struct(*[c for c in stored.columns if c != "id"]), F.struct("decided_at", "run_id")).alias("p")).select("id", "p.*")
    said = chosen.select("id", F.col("decision").alias("said")).filter(F.col("said").isin("accepted", "rejected"))
    by_owner = {"run_id": F.lit(run_id), "decision": F.col("said"), "decided_at": instant(decided_at), "decided_by": F.lit("owner")}
    return first.join(said, "id").withColumns(by_owner).select(*stored.columns)


def decisions_as_of(stored: DataFrame, as_of: str) -> DataFrame:
    """Every pair with the decision that held at ``as_of`` (D8): read, not recomputed."""
    owner = stored.withColumn("rank", F.when(F.col("decided_by") == "owner", 1).otherwise(0))
    return latest_as_of(owner, ["source_event_id", "target_event_id"], "decided_at", as_of, ["rank", "run_id"]).drop("rank")


def accepted_as_of(stored: DataFrame, as_of: str) -> DataFrame:
    """(id_a, id_b) of the merges in force at ``as_of``."""
    held = decisions_as_of(stored, as_of).filter(F.col("decision").isin("auto_accepted", "accepted"))
    return held.select(F.col("source_event_id").alias("id_a"), F.col("target_event_id").alias("id_b"))


class Components:
    """Labels of connected components below ``root``, extended run by run.

    Runs are numbered; what a run appends is a folder of its own, which a retry
    replaces. A label is the smallest node of its component. Edges are only
    added: after a decision is withdrawn, build the components anew from the
    decisions in another folder.
    """

    def __init__(self, spark: SparkSession, root: str, node_type: str = "bigint", buckets: int = 256):
        self.spark, self.root, self.kind, self.buckets = spark, root.rstrip("/"), node_type, buckets

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, columns: Sequence[str], before: int | None, only: Sequence[int] | None = None) -> DataFrame:
        schema = ", ".join(f"{c} {self.kind}" for c in columns) + ", run int, bucket int"
        if not exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        df = df if before is None else df.filter(F.col("run") < before)
        return df if only is None else df.filter(F.col("bucket").isin(list(only)))

    def _append(self, df: DataFrame, name: str, key: str, run: int) -> None:
        dealt = df.withColumn("bucket", self._bucket(key)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/run={run}")

    def _moves(self, before: int | None, only: Sequence[int] | None = None) -> DataFrame:
        """(label, now): the last move of each label."""
        rows = self._read("move", ["label", "now"], before, only)
        return rows.groupBy("label").agg(F.max_by("now", "run").alias("now"))

    def _buckets_of(self, df: DataFrame, c: str) -> list[int]:
        return sorted(r[0] for r in df.select(self._bucket(c)).distinct().collect())

    def add(self, edges: DataFrame, run: int, save: Callable[[DataFrame], DataFrame], src: str = "id_a", dst: str = "id_b") -> None:
        """Take in the edges of one run. ``save`` cuts the lineage of a step (it writes and rereads)."""
        new = save(edges.select(F.col(src).cast(self.kind).alias("a"), F.col(dst).cast(self.kind).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct())
        ends = save(new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct())
        member = self._read("member", ["node", "label"], run, self._buckets_of(ends, "node")).select("node", "label")
        named = save(ends.join(member, "node", "left"))
        moves = self._moves(run, self._buckets_of(named.filter("label IS NOT NULL"), "label"))
        now = save(named.join(moves, "label", "left").select("node", F.col("label").isNull().alias("fresh"), F.coalesce("now", "label", "node").alias("label")))
        # The new edges between current labels; only these few are closed.
        of = lambda x: now.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        tied = new.join(of("a"), "a").join(of("b"), "b").select("la", "lb")
        closed = save(connected_components(tied, "la", "lb", save).withColumnsRenamed({"node": "old", "label": "least"}))
        fresh = now.filter("fresh").join(closed, F.col("label") == F.col("old"), "left").select("node", F.coalesce("least", "label").alias("label"))
        # A fresh node that is a label only of itself has no members to move; one that was known moves, and so do those it had absorbed.
        known = now.filter("NOT fresh").select("label").distinct()
        moved = save(closed.filter("old != least").join(known, F.col("old") == F.col("label"), "left_semi"))
        through = self._moves(run).join(moved, F.col("now") == F.col("old")).select("label", F.col("least").alias("now"))
        self._append(fresh, "member", "node", run)
        self._append(through.unionByName(moved.select(F.col("old").alias("label"), F.col("least").alias("now"))), "move", "label", run)

    def labels(self, before: int | None = None) -> DataFrame:
        """(node, label) of every node that has a link, after all runs, or those numbered below ``before``."""
        member = self._read("member", ["node", "label"], before).select("node", "label")
        return member.join(self._moves(before), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
