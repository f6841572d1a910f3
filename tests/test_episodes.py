"""Episodes by automaton against a plain run over whole histories, and what happened next."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import episodes as E

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
KIND = "who string, at timestamp, n long, what string, state string"
FALL_FALL_RISE = E.Automaton(({"fall": 1}, {"fall": 2}, {"fall": 2, "rise": 3}), accept=3)
LOOSE = E.Automaton(({"a": 1, "b": 2}, {"c": 3, "b": 2, None: 1}, {"c": 3, "a": 0, None: 2}), accept=3)


def plain(rows, automaton):
    out = []
    for who in {r[0] for r in rows}:
        state, start = 0, None
        for _, at, n, what, *_ in sorted((r for r in rows if r[0] == who and r[1] is not None), key=lambda r: (r[1], r[2])):
            now = automaton.moves[state].get(what, automaton.moves[state].get(None, 0))
            if state == 0 and now:
                start = (at, n)
            if now == automaton.accept:
                out.append((who, *start, at, n))
                now = 0
            state = now
    return sorted(out, key=repr)


def got(df):
    utc = lambda t: t.astimezone(UTC)
    return sorted(((r["who"], utc(r["started"]), r["first"], utc(r["ended"]), r["last"]) for r in df.collect()), key=repr)


def history(seed, n, symbols, minutes):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), START + dt.timedelta(minutes=r.randrange(minutes)), k, r.choice(symbols), "x") for k in range(n)]
    return [*rows, ("b", None, 9999, "fall", "x"), ("lone", START, 1, "a", "x"), ("lone", START, 2, None, "x")]


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
@pytest.mark.parametrize("automaton, symbols", [(FALL_FALL_RISE, ["fall", "rise", "rise", "same"]), (LOOSE, ["a", "b", "c", "d", "d", None])])
def test_episodes_are_those_of_whole_histories(spark, bucket, automaton, symbols):
    rows = history(7, 400, symbols, 60 * 24 * 9)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    want = plain(rows, automaton)
    assert want and got(E.match(df, ["who"], "at", "n", "what", automaton, bucket)) == want


def test_an_episode_reaches_over_empty_and_full_buckets(spark):
    day = dt.timedelta(days=1)
    rows = [("k", START, 1, "a", "x"), *[("k", START + day * (2 + i), 2 + i, "d", "x") for i in range(5)], ("k", START + day * 40, 9, "c", "x")]
    assert got(E.match(spark.createDataFrame(rows, KIND), ["who"], "at", "n", "what", LOOSE)) == [("k", START, 1, START + day * 40, 9)]


def test_no_rows(spark):
    assert E.match(spark.createDataFrame([], KIND), ["who"], "at", "n", "what", LOOSE).collect() == []


def test_what_happened_next(spark):
    hour = dt.timedelta(hours=1)
    asked = spark.createDataFrame([("a", START), ("a", START + 50 * hour), ("b", START), ("c", START)], "who string, t timestamp")
    given = [("a", START, 1.0, 5), ("a", START + 2 * hour, 2.0, 7), ("a", START + 2 * hour, 3.0, 6), ("a", START + 60 * hour, None, 1), ("c", START + 30 * hour, 9.0, 1)]
    out = E.next_after(asked, spark.createDataFrame(given, "who string, at timestamp, v double, n long"), ["who"], "t", "at", ["v"], ["n"], "24 HOURS")
    found = {(r["who"], r["t"].astimezone(UTC)): (None if r["outcome_at"] is None else r["outcome_at"].astimezone(UTC), r["v"]) for r in out.collect()}
    assert found == {("a", START): (START + 2 * hour, 3.0), ("a", START + 50 * hour): (START + 60 * hour, None), ("b", START): (None, None), ("c", START): (None, None)}


def test_the_last_times_while_a_state_held(spark):
    day = dt.timedelta(days=1)
    rows = [("k", START + day * (3 * i + j), 10 * i + j, s, "x") for i in range(6) for j, s in enumerate("ac")]
    found = E.match(spark.createDataFrame(rows, KIND), ["who"], "at", "n", "what", LOOSE)
    states = spark.createDataFrame([("k", START, START + day * 10, True), ("k", START + day * 10, START + day * 14, False), ("k", START + day * 14, None, True)], "who string, valid_from timestamp, valid_to timestamp, tight boolean")
    after = spark.createDataFrame([("k", START + day * 17, 4.0, 1)], "who string, at timestamp, v double, n long")
    out = E.last_times(found, states, F.col("tight"), after, ["who"], "at", ["v"], ["n"], "3 DAYS", k=3)
    assert [(r["nth"], r["last"], r["v"]) for r in out.orderBy("nth").collect()] == [(1, 51, 4.0), (2, 21, None), (3, 11, None)]
