"""Queries of stored merge decisions and their replay."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import merges
from tempora.operators.closure import spanning_links
from tempora.plans.registry import Tables, query
from tempora.plans.time_and_identity import _PAIRS, _pairs, _reported
from tempora.sources import tables

#: The first model sees half of the pairs; the owner rejects some and accepts others; a second model then sees all, with another threshold.
FIRST, SECOND = 0.98, 0.92
_T1, _T2, _T3 = "2024-02-01 00:00:00", "2024-02-02 00:00:00", "2024-02-03 00:00:00"

_HELD = f"""h AS (SELECT id_a, id_b, CASE WHEN id_a % 2 = 0 THEN CASE WHEN id_a % 5 = 0 THEN 'rejected' WHEN score < {FIRST} AND id_b % 3 = 0 THEN 'accepted' WHEN score >= {FIRST} THEN 'auto_accepted' ELSE 'pending' END
    WHEN score >= {SECOND} THEN 'auto_accepted' ELSE 'pending' END AS decision,
    CASE WHEN id_a % 2 = 0 AND (id_a % 5 = 0 OR (score < {FIRST} AND id_b % 3 = 0)) THEN 'owner' ELSE 'system' END AS decided_by, CASE WHEN id_a % 2 = 0 THEN 'first' ELSE 'second' END AS model_version FROM p)"""


#: Pairs that pass through the three runs together: about so many have their shuffles and stored rows on disk at a time.
PART = 2_000_000


def _decided(spark, pairs: DataFrame, root: str) -> DataFrame:
    """Three runs below ``root``: proposals of the first model, the owner's decisions, proposals of the second model."""
    stored = lambda: tables.read(spark, root, "event_merge_proposal")
    tables.create_all(spark, root, ["event_merge_proposal"])
    tables.append(merges.record_proposals(pairs.filter("id_a % 2 = 0"), stored(), "1", _T1, "semantic_similarity", FIRST, "first"), root, "event_merge_proposal", "1")
    first = stored().filter("run_id = '1'")
    low, high = F.least(*(F.col(c).cast("long") for c in ("source_event_id", "target_event_id"))), F.greatest(*(F.col(c).cast("long") for c in ("source_event_id", "target_event_id")))
    chosen = first.select("id", F.when(low % 5 == 0, "rejected").when((F.col("score") < FIRST) & (high % 3 == 0), "accepted").alias("decision")).filter("decision IS NOT NULL")
    tables.append(merges.record_decisions(first, chosen, "2", _T2), root, "event_merge_proposal", "2")
    tables.append(merges.record_proposals(pairs, stored(), "3", _T3, "semantic_similarity", SECOND, "second"), root, "event_merge_proposal", "3")
    return stored()


def _by_parts(t: Tables, read: Callable[[DataFrame], list[DataFrame]]) -> list[DataFrame]:
    """What ``read`` takes from the stored decisions, of all pairs.

    A pair's decisions depend on no other pair, so the pairs are dealt into
    parts, and each part's three runs are stored, read and removed in turn.
    """
    spark = t.spark
    pairs = tables.save(_pairs(t), "pairs")
    n = max(1, -(-pairs.count() // PART))
    out = []
    for k in range(n):
        root = tables.own_folder(spark, "proposals")
        stored = _decided(spark, pairs.filter(F.pmod(F.xxhash64("id_a", "id_b"), F.lit(n)) == k), root)
        out.append([tables.save(df, "decided") for df in read(stored)])
        tables.remove(spark, root)
    return [reduce(DataFrame.unionByName, parts) for parts in zip(*out, strict=True)]


@query(f"WITH {_PAIRS}, {_HELD} SELECT * FROM h")
def merge_decisions(spark, d):
    a, b = F.col("source_event_id").cast("long"), F.col("target_event_id").cast("long")
    columns = [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "decision", "decided_by", "model_version"]
    return _by_parts(Tables(spark, d), lambda stored: [merges.decisions_as_of(stored, _T3).select(*columns)])[0]


@query(f"""WITH RECURSIVE {_PAIRS}, {_HELD}, e AS (SELECT id_a AS x, id_b AS y FROM h WHERE decision IN ('auto_accepted', 'accepted') UNION SELECT id_b, id_a FROM h WHERE decision IN ('auto_accepted', 'accepted')),
    r AS (SELECT vec_id AS x, vec_id AS y FROM x UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS vec_id, min(y) AS canonical_id FROM r GROUP BY x""")
def merge_replay(spark, d):
    """Components from decisions as they came in: those in force after the owner's run, then those of the second model."""
    t = Tables(spark, d)
    known = merges.Components(spark, tables.own_folder(spark, "components"), buckets=16)
    links = lambda df: spanning_links(df.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))

    def accepted(stored: DataFrame) -> list[DataFrame]:
        """Of the merges in force after each run, links that tie the same components."""
        before, after = merges.accepted_as_of(stored, _T2), merges.accepted_as_of(stored, _T3)
        return [links(before), links(after.join(before, ["id_a", "id_b"], "left_anti"))]

    for run, tied in enumerate(_by_parts(t, accepted)):
        known.add(spanning_links(tied.coalesce(8)), run, tables.save, "a", "b")
    ids = _reported(t).select("vec_id")
    return ids.join(known.labels(), F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("label", "vec_id").alias("canonical_id"))
