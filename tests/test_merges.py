"""Hashed pairs, stored merge decisions and components that grow."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import closure
from tempora.operators import identity as I
from tempora.operators import merges
from tempora.sources import tables

T1, T2, T3 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], tables.SCHEMAS["event_merge_proposal"])


def pairs(spark, *rows):
    return spark.createDataFrame([(a, b, s) for a, b, s in rows], "id_a string, id_b string, score double")


def held(df):
    return {(r["source_event_id"], r["target_event_id"]): (r["decision"], r["decided_by"], r["model_version"], r["threshold_applied"]) for r in df.collect()}


def test_a_stored_pair_is_not_judged_again(spark, nothing):
    first = merges.record_proposals(pairs(spark, ("a", "b", 0.99), ("c", "a", 0.9), ("b", "a", 0.97), ("x", "x", 1.0), (None, "a", 1.0)), nothing, "1", T1, "semantic_similarity", 0.98, "m1")
    assert held(first) == {("a", "b"): ("auto_accepted", "system", "m1", 0.98), ("a", "c"): ("pending", "system", "m1", 0.98)}
    # Another model finds the same pairs less alike, and a lower threshold would take both: history stands.
    second = merges.record_proposals(pairs(spark, ("b", "a", 0.5), ("a", "c", 0.95), ("d", "a", 0.95)), first, "2", T2, "semantic_similarity", 0.9, "m2")
    assert held(second) == {("a", "d"): ("auto_accepted", "system", "m2", 0.9)}
    stored = first.unionByName(second)
    assert held(merges.decisions_as_of(stored, T1)) == held(first)
    assert len(held(merges.decisions_as_of(stored, T2))) == 3


def test_the_owners_decision_holds_from_its_time_on(spark, nothing):
    first = merges.record_proposals(pairs(spark, ("a", "b", 0.99), ("a", "c", 0.9)), nothing, "1", T1, "semantic_similarity", 0.98)
    ids = {(r["source_event_id"], r["target_event_id"]): r["id"] for r in first.collect()}
    chosen = spark.createDataFrame([(ids["a", "b"], "rejected"), (ids["a", "c"], "accepted"), ("no such", "accepted")], "id string, decision string")
    stored = first.unionByName(merges.record_decisions(first, chosen, "2", T2))
    accepted = lambda at: {(r["id_a"], r["id_b"]) for r in merges.accepted_as_of(stored, at).collect()}
    assert accepted(T1) == {("a", "b")} and accepted(T3) == {("a", "c")}
    # Neither the rejected nor the accepted pair comes up again.
    assert merges.record_proposals(pairs(spark, ("b", "a", 1.0), ("c", "a", 1.0)), stored, "3", T3, "semantic_similarity", 0.98).isEmpty()
    same_time = first.unionByName(merges.record_decisions(first, chosen, "0", T1))
    assert {d[0] for d in held(merges.decisions_as_of(same_time, T1)).values()} == {"rejected", "accepted"}


def full(spark, edges):
    labels = closure.connected_components(spark.createDataFrame(edges, "id_a long, id_b long"), "id_a", "id_b", tables.save)
    return {r["node"]: r["label"] for r in labels.collect()}


def now(known, before=None):
    return {r["node"]: r["label"] for r in known.labels(before).collect()}


def test_components_grow_to_the_full_closure(spark, tmp_path):
    r = random.Random(4)
    known, edges = merges.Components(spark, f"file://{tmp_path}", buckets=8), []
    batches = [[(r.randrange(60, 120), r.randrange(60, 120)) for _ in range(25)], [(r.randrange(40, 120), r.randrange(40, 120)) for _ in range(15)], [], [(r.randrange(120), r.randrange(120)) for _ in range(20)], [(5, 5), (None, 3)]]
    states = []
    for run, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "id_a long, id_b long")
        known.add(df, run, tables.save)
        edges += [(a, b) for a, b in batch if a is not None and a != b]
        states.append(now(known))
        assert states[-1] == full(spark, edges)
        if run == 1:  # the same run again replaces what it wrote
            known.add(df, run, tables.save)
            assert now(known) == states[-1]
    for run, state in enumerate(states):
        assert now(known, run + 1) == state


def test_a_run_costs_no_pass_over_old_edges(spark, tmp_path):
    """Old edges are gone from disk, and only the rows that the new edges touch are written."""
    known = merges.Components(spark, f"file://{tmp_path}", buckets=32)
    old = spark.range(1000, 3000, 2).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    known.add(old, 0, tables.save)
    known.add(spark.createDataFrame([(1000, 1002), (1, 2001), (7, 8)], "id_a long, id_b long"), 1, tables.save)
    written = {name: spark.read.parquet(f"file://{tmp_path}/{name}/run=1").count() for name in ("member", "move")}
    assert written == {"member": 3, "move": 2}  # members 1, 7, 8; labels 1002 and 2000 move
    got = now(known)
    assert len(got) == 2003 and got[1003] == 1000 and got[2000] == got[2001] == 1 and got[7] == got[8] == 7


def test_a_chain_of_moves_is_followed(spark, tmp_path):
    known = merges.Components(spark, f"file://{tmp_path}", buckets=4)
    for run, edge in enumerate([(50, 51), (40, 50), (30, 51), (20, 40), (10, 51)]):
        known.add(spark.createDataFrame([edge], "id_a long, id_b long"), run, tables.save)
    assert set(now(known).values()) == {10}


def vectors(n, copies, seed=2, size=32):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(size)]) for i in range(n)]
    return rows + [(10_000 + i, [x + r.gauss(0, 0.05) for x in rows[i % n][1]]) for i in range(copies)]


def near(rows, least):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    return {(i, j) for i, a in rows for j, b in rows if i < j and dot(a, b) >= least * (dot(a, a) * dot(b, b)) ** 0.5}


@pytest.mark.parametrize("hot", [256, 3])
def test_pairs_of_a_hot_bucket_are_all_found(spark, hot):
    r = random.Random(1)
    one = [r.gauss(0, 1) for _ in range(32)]
    rows = vectors(60, 30) + [(20_000 + i, [x + r.gauss(0, 0.02) for x in one]) for i in range(40)]
    df = spark.createDataFrame([*rows, (30_000, None), (30_001, [1.0])], "id long, v array<double>")
    got = [(p["id_a"], p["id_b"]) for p in I.hashed_pairs(df, "id", "v", 0.9, 32, recall=0.99999, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == near(rows, 0.9)


def test_candidates_follow_the_rows(spark):
    """Twice the bits for the square of the rows: the buckets stay small."""
    sizes = []
    for n in (500, 2000):
        df = spark.createDataFrame(vectors(n, 0), "id long, v array<double>")
        bits = max(8, n.bit_length() - 1)
        codes = I.hash_codes(df, "id", "v", I.hyperplanes(32, bits, "planes"), bits).select(F.col("codes")[0].alias("c"))
        met = codes.groupBy("c").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
        sizes.append(met / n)
    assert sizes[1] < 2 * sizes[0] + 1


def test_building_pairs_is_quick(spark):
    import time

    df = spark.createDataFrame(vectors(50, 0, size=64), "id long, v array<double>")
    I.hashed_pairs(df, "id", "v", 0.9, 64, bits=8, recall=0.99999)
    began = time.perf_counter()
    I.hashed_pairs(df, "id", "v", 0.9, 64, bits=8, recall=0.99999)
    assert time.perf_counter() - began < 5


def test_rows_meet_only_on_a_shared_topic(spark):
    rows = [(i, ["k"], [f"t{i % 50}"], 1000 + i) for i in range(200)] + [(900, ["k", "k", "j"], ["t1", "t2", "t1"], 1001), (901, None, ["t1"], 1001), (902, ["k"], None, 1001)]
    df = spark.createDataFrame(rows, "id long, e array<string>, t array<string>, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["id_a"], r["id_b"]): r["shared_entities"] for r in I.array_matches(df, "id", "e", "t", "ts", 60).collect()}
    whole = [r for r in rows if r[1] and r[2]]
    later = lambda a, b: (a[3], a[0]) < (b[3], b[0]) and b[3] - a[3] <= 60
    assert got == {(a[0], b[0]): sorted(set(a[1]) & set(b[1])) for a in whole for b in whole if later(a, b) and set(a[1]) & set(b[1]) and set(a[2]) & set(b[2])}


def test_a_write_that_died_can_be_tried_again(spark, tmp_path, nothing):
    root = f"file://{tmp_path}"
    tables.append(nothing, root, "event_merge_proposal", "7")
    with pytest.raises(FileExistsError):
        tables.append(nothing, root, "event_merge_proposal", "7")
    (tmp_path / "event_merge_proposal/run_id=7/_SUCCESS").unlink()
    row = merges.record_proposals(pairs(spark, ("a", "b", 0.99)), nothing, "7", T1, "semantic_similarity", 0.98)
    tables.append(row, root, "event_merge_proposal", "7")
    assert tables.read(spark, root, "event_merge_proposal").count() == 1


@pytest.mark.parametrize("tile", [16_384, 32])
def test_tiled_pairs_are_complete(spark, monkeypatch, tile):
    monkeypatch.setattr(I, "TILE", tile)
    monkeypatch.setattr(I, "STRIP", 20)
    r = random.Random(1)
    one = [r.gauss(0, 1) for _ in range(32)]
    rows = vectors(60, 30) + [(20_000 + i, [x + r.gauss(0, 0.02) for x in one]) for i in range(40)] + [(30_010, [x * 3e30 for x in one])]
    odd = [(30_000, None), (30_001, [1.0]), (30_002, [0.0] * 32), (30_003, [float("nan")] * 32), (30_004, [float("inf")] * 32), (30_005, [None] + [1.0] * 31), (None, one)]
    df = spark.createDataFrame([*rows, *odd], "id long, v array<double>")
    found = I.tiled_pairs(df, "id", "v", 0.9, 32, tables.save)
    got = {(p["id_a"], p["id_b"]): p["score"] for p in found.collect()}
    assert len(got) == found.count() and set(got) == near(rows, 0.9)
    scored = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = (scored.select(F.col("id").alias(f"id_{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    want = a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", I.cosine(F.col("va"), F.col("vb")).alias("score")).filter("score >= 0.9")
    assert got == {(p["id_a"], p["id_b"]): p["score"] for p in want.collect()}


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))


@pytest.mark.parametrize("name", ["semantic_pairs", "merge_auto_accept", "merge_closure", "merge_decisions", "merge_replay"])
def test_pairs_shuffle_their_vectors_once(spark, name):
    """Not once for each band of a hash, nor once for each pair."""
    from tempora import plans

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    before = shuffled(spark)
    try:
        assert len(plans.QUERIES[name](spark, "/root/testdata/sf0.1").collect()) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert shuffled(spark) - before < 2 * 2889 * 64 * 8


def saved_rows(kept):
    """A save that keeps the number of rows it wrote."""
    def save(df, name="round"):
        out = tables.save(df, name)
        kept.append(out.count())
        return out

    return save


@pytest.mark.parametrize("tile", [16_384, 32])
def test_tiled_components_are_those_of_all_pairs_without_them(spark, monkeypatch, tile):
    monkeypatch.setattr(I, "TILE", tile)
    monkeypatch.setattr(I, "STRIP", 20)
    r = random.Random(1)
    one = [r.gauss(0, 1) for _ in range(32)]
    rows = vectors(60, 30) + [(20_000 + i, [x + r.gauss(0, 0.02) for x in one]) for i in range(150)] + [(30_010, [x * 3e30 for x in one])]
    odd = [(30_000, None), (30_001, [1.0]), (30_002, [0.0] * 32), (30_003, [float("nan")] * 32), (30_004, [float("inf")] * 32), (None, one)]
    twice = [(7, rows[50][1]), (7, rows[51][1]), (20_005, rows[52][1])]  # keys of several rows
    df = spark.createDataFrame([*rows, *odd, *twice], "id long, v array<double>")
    found, kept = I.tiled_pairs(df, "id", "v", 0.9, 32, tables.save), []
    want = {x["node"]: x["label"] for x in closure.connected_components(found, "id_a", "id_b", tables.save).collect()}
    got = {x["node"]: x["label"] for x in I.tiled_components(df, "id", "v", 0.9, 32, saved_rows(kept)).collect()}
    assert {7, 50, 51} <= {n for n, label in got.items() if label == 7}
    want |= {n: n for n in got if n not in want}
    assert len(set(want.values())) > 40 and got == want
    assert found.count() > 150 * 149 / 2 and sum(kept) < 2500  # 11,175 pairs among 150 rows alone


def test_spanning_links_bound_what_they_know(spark, monkeypatch):
    monkeypatch.setattr(closure, "TREE_NODES", 50)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(2000)] + [(None, 1), (4, 4)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        links = [tuple(x) for x in closure.spanning_links(df).collect()]
        monkeypatch.setattr(closure, "TREE_NODES", 1000)
        least = [tuple(x) for x in closure.spanning_links(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert set(least) <= set(links) < set(edges) and len(least) < 300
    sound = [(a, b) for a, b in edges if a is not None and a != b]
    assert full(spark, links) == full(spark, least) == full(spark, sound)


def on_disk(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("name", ["merge_decisions", "merge_replay"])
def test_decisions_by_parts_are_those_of_all(spark, monkeypatch, name):
    """Parts change no row, and no part's proposals stay on disk."""
    from tempora import plans
    from tempora.plans import merges as P

    folders, own = [], tables.own_folder
    monkeypatch.setattr(tables, "own_folder", lambda s, n: folders.append(own(s, n)) or folders[-1])
    whole = sorted(plans.QUERIES[name](spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(P, "PART", 100)
    assert sorted(plans.QUERIES[name](spark, "/root/testdata/sf0.01").collect()) == whole and whole
    stored = [f for f in folders if "/proposals-" in f]
    assert len(stored) == 1 + 3 and not any(tables.exists(spark, f) for f in stored)


def test_what_is_saved_leaves_no_shuffle(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: on_disk(disk.localDirsString()[0])
    before = kept()
    df = spark.range(300_000).select(F.xxhash64("id").alias("h")).repartition(4, "h")
    assert tables.save(df).count() == 300_000
    assert kept() - before < 500_000  # the shuffle has 2.4 MB
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
