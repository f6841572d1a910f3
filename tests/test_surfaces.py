"""Read surfaces: SQL table functions with an instant."""

import pytest

from tempora.sources.surfaces import Surface

HELD = Surface("held", ["owner"], ["kind", "n"], "t", "id")


@pytest.fixture
def rows(spark):
    data = [(1, 7, "a", 1, "2024-01-01"), (2, 7, "a", 2, "2024-01-03"), (3, 7, "b", 2, "2024-01-03"), (4, 8, "c", None, "2024-01-02"), (5, 8, "c", None, "2024-01-04"), (6, None, "d", 1, "2024-01-01"), (7, 9, "e", 1, "2024-02-01")]
    return spark.createDataFrame(data, "id long, owner long, kind string, n int, t string").selectExpr("id", "owner", "kind", "n", "cast(t AS timestamp) AS t")


def test_an_answer_knows_its_instant_and_its_rows(spark, rows):
    assert HELD.register(spark, rows) == ["held_at", "held_changes", "held_why"]
    ask = lambda sql: sorted((tuple(r) for r in spark.sql(sql).collect()), key=str)
    # Of two rows of one instant the higher id is the later.
    assert ask("SELECT owner, kind, n, provenance_ids FROM held_at(TIMESTAMP'2024-01-03')") == sorted([(7, "b", 2, [3]), (8, "c", None, [4]), (None, "d", 1, [6])], key=str)
    assert ask("SELECT kind FROM held_at(TIMESTAMP'2024-01-02') WHERE owner = 7") == [("a",)]
    assert ask("SELECT * FROM held_at(TIMESTAMP'2023-01-01')") == []
    assert ask("SELECT q.d, h.kind FROM VALUES (1), (3) q(d), LATERAL held_at(make_timestamp(2024, 1, q.d, 0, 0, 0)) h WHERE owner = 7") == [(1, "a"), (3, "b")]
    assert ask("SELECT id FROM held_why(TIMESTAMP'2024-01-03', TIMESTAMP'2024-01-02') WHERE owner = 7") == [(2,), (3,)]


def test_what_changed(spark, rows):
    HELD.register(spark, rows)
    got = spark.sql("SELECT owner, old_kind, new_kind, old_n, new_n, appeared, provenance_ids FROM held_changes(TIMESTAMP'2024-01-02', TIMESTAMP'2024-02-01')").collect()
    # Owner 8 has a newer row that says the same: nothing changed.
    assert sorted(map(tuple, got), key=str) == [(7, "a", "b", 1, 2, False, [1, 3]), (9, None, "e", None, 1, True, [7])]


def test_instant_and_key_reach_the_scan(spark):
    Surface("ev", ["user_id"], ["value"], "ts", "event_id").register(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "user_id", "value", "cast(ts AS timestamp) AS ts", "props"))
    text = spark.sql("SELECT * FROM ev_at(TIMESTAMP'2024-01-05') WHERE user_id = 3")._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert "EqualTo(user_id,3)" in text and "LessThanOrEqual(ts," in text and "props" not in text.split("ReadSchema")[1]


def test_a_surface_reads_only_and_takes_plain_names(spark, rows):
    with pytest.raises(ValueError):
        Surface("x; DROP", ["owner"], ["n"], "t", "id").register(spark, rows)
    with pytest.raises(ValueError):
        Surface("x", ["owner"], ["n`, 1 AS `z"], "t", "id").register(spark, rows)
    HELD.register(spark, rows.limit(0))
    assert spark.sql("SELECT * FROM held_at(TIMESTAMP'2024-01-03')").isEmpty()
