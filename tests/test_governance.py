"""Tiers of rows, gates, observed runs, sent alerts, and the validation of candidates."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tempora.operators import governance as G
from tempora.operators import impact as M
from tempora.operators import scans
from tempora.sources.tables import save


def test_the_highest_tier_of_the_inputs(spark):
    rows = [("a", "L0"), ("a", "L2"), ("b", "L3"), ("b", None), ("c", "L9"), ("d", "L1"), (None, "L1")]
    got = {r["k"]: r["tier"] for r in G.highest_tier(spark.createDataFrame(rows, "k string, tier string"), ["k"], "tier").collect()}
    assert got == {"a": "L2", "b": None, "c": None, "d": "L1", None: "L1"}


def test_calls_over_their_clearance(spark):
    rows = [(1, "L0", "L0"), (2, "L2", "L1"), (3, "L1", "L2"), (4, None, "L3"), (5, "L1", None), (6, "L7", "L3"), (7, "L1", "L7")]
    got = {r["id"] for r in G.over_clearance(spark.createDataFrame(rows, "id int, tier string, clearance string"), "tier", "clearance").collect()}
    assert got == {2, 4, 5, 6, 7}


def test_a_run_counts_while_it_writes(spark):
    reads = spark.sparkContext.accumulator(0)

    def counting(s, _):
        return spark.range(6).selectExpr("CASE WHEN id < 2 THEN 'unknown' WHEN id < 3 THEN NULL ELSE 'ok' END AS status", "id").filter(F.udf(lambda x: (reads.add(1), True)[1], "boolean")("id"))

    stages = {"ingest_due_sources": counting, "materialize_events": lambda s, _: s["ingest_due_sources"].filter("id > 99"), "update_narratives": lambda s, _: spark.createDataFrame([], "result string"), "build_world_state": lambda s, _: s["no such"]}
    state, log = G.run_cycle(stages, {"t": spark.range(1)}, "2024-01-01 00:00:00", "r", save)
    by = {r["stage"]: r for r in log}
    assert (by["ingest_due_sources"]["rows"], by["ingest_due_sources"]["missing"]) == (6, 3) and reads.value == 6
    assert (by["materialize_events"]["rows"], by["update_narratives"]["rows"], by["update_narratives"]["missing"]) == (0, 0, 0)
    assert by["build_world_state"]["status"] == "failed" and by["update_scenarios"]["status"] == "skipped"


def test_costs_come_from_the_calls(spark):
    assert G.call_totals(spark.createDataFrame([(0.5,), (None,), (0.25,)], "cost double"), "cost") == (3, 0.75)
    assert G.call_totals(spark.createDataFrame([], "cost double"), "cost") == (0, 0.0)


def test_what_was_sent_is_not_sent_again(spark):
    alerts = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 4), (3, "a", "y", 1), (4, "b", "x", 1)], "id int, who string, kind string, at int")
    sent = spark.createDataFrame([("b", "z"), ("b", "z")], "who string, kind string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(M.unsent(alerts, sent, ["who", "kind"], [F.col("at")])) == [2, 3, 4]
    assert ids(M.unsent(alerts, sent, ["who", "kind"], [F.col("at")], ["who"])) == [2, 3]


def weight(key, draw):
    u = int(hashlib.md5(f"{draw}:{key}".encode()).hexdigest()[:13], 16) / 16**13
    return next((k for k, x in enumerate(G._POISSON) if u < x), len(G._POISSON))


@pytest.mark.parametrize("better, verdict", [(0.1, "improves"), (0.9, "worse"), (0.5, "undecided")])
def test_a_candidate_must_improve_past_outcomes(spark, better, verdict):
    rows = [(i, i % 2, 0.5 if better != 0.5 else (0.4 if i % 4 < 2 else 0.6), better if i % 2 == 0 else 1 - better) for i in range(120)] + [(500, None, 0.5, 0.5), (501, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "id long, y int, old double, new double").withColumn("g", F.lit("all")).repartition(5)
    got = G.validate_candidate(df, ["g"], "id", "old", "new", "y", draws=100).collect()[0]
    assert got["verdict"] == verdict and got["cases"] == 120
    gain = {i: (o - y) ** 2 - (n - y) ** 2 for i, y, o, n in rows[:120]}
    means = sorted(sum(weight(i, b) * x for i, x in gain.items()) / sum(weight(i, b) for i in gain) for b in range(1, 101))
    assert abs(got["low"] - means[2]) < 1e-9 and abs(got["high"] - means[97]) < 1e-9


def test_no_past_cases(spark):
    df = spark.createDataFrame([(1, None, 0.5, 0.5, "g")], "id long, y int, old double, new double, g string")
    assert G.validate_candidate(df, ["g"], "id", "old", "new", "y").collect() == []


def test_totals_before_a_row(spark):
    rows = [("hot", i, i % 7, 1) for i in range(400)] + [("b", 3, None, 1), ("b", 5, 2, 1), (None, 1, 4, 1)]
    df = spark.createDataFrame(rows, "k string, n long, v int, one int").withColumn("at", F.timestamp_seconds(F.col("n") * 600))
    got = {(r["k"], r["n"]): (r["s"], r["c"]) for r in scans.running_total(df, ["k"], "at", ["n"], ["v", "one"], ["s", "c"], "hour").collect()}
    want = {}
    for k, n, *_ in rows:
        before = [(v or 0, o) for kk, m, v, o in rows if kk == k and m < n]
        want[k, n] = (sum(v for v, _ in before), sum(o for _, o in before))
    assert got == want
