"""Scans by buckets against plain runs, with one key that holds half of all rows."""

import datetime as dt
import math
import random

import pytest

from tempora.operators import scans

START = dt.datetime(2024, 3, 30, tzinfo=dt.timezone.utc)
KIND = "who string, at timestamp, n long, v double"


def rows(seed, n=500):
    r = random.Random(seed)
    out = [(r.choice(["hot", "hot", "hot", "a", "b", None]), START + dt.timedelta(minutes=10 * r.randrange(2000)), k, r.choice([None, r.gauss(50, 20), r.gauss(50, 20), -r.random()])) for k in range(n)]
    return [*out, ("hot", None, 9001, 70.0), ("one", START, 9002, None), ("a", START + dt.timedelta(days=300), 9003, 1.0)]


def histories(given):
    for who in {r[0] for r in given}:
        yield sorted((r for r in given if r[0] == who), key=lambda r: (r[1] is not None, r[1] or START, r[2]))


def close(got, want):
    assert set(got) == set(want)
    for n, x in want.items():
        assert (got[n] is None) == (x is None) and (x is None or math.isclose(got[n], x, rel_tol=1e-9, abs_tol=1e-7)), (n, got[n], x)


def found(df, name):
    return {r["n"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_running_max(spark, bucket):
    given, want = rows(1), {}
    for h in histories(given):
        peak = None
        for r in h:
            peak = r[3] if peak is None else peak if r[3] is None else max(peak, r[3])
            want[r[2]] = peak
    close(found(scans.running_max(spark.createDataFrame(given, KIND), ["who"], "at", ["n"], "v", bucket=bucket), "peak"), want)


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_change_sum(spark, bucket):
    given, want = rows(2), {}
    for h in histories(given):
        s = 0.0
        for r in h:
            s = max(0.0, s + (0 if r[3] is None else r[3] - 48))
            want[r[2]] = s
    close(found(scans.change_sum(spark.createDataFrame(given, KIND), ["who"], "at", ["n"], "v", 45.0, 3.0, bucket=bucket), "change_sum"), want)


@pytest.mark.parametrize("bucket, seconds", [("hour", 600.0), ("day", 86_400.0), ("month", 20_000.0)])
def test_decayed_mean(spark, bucket, seconds):
    given, want = rows(3), {}
    for h in histories(given):
        w = wx = 0.0
        last = None
        for r in h:
            if r[1] is None:
                want[r[2]] = None
                continue
            fade = 1.0 if last is None else math.exp(-(r[1] - last).total_seconds() / seconds)
            w, wx, last = w * fade, wx * fade, r[1]
            if r[3] is not None:
                w, wx = w + 1, wx + r[3]
            want[r[2]] = wx / w if w else None
    got = found(scans.decayed_mean(spark.createDataFrame(given, KIND), ["who"], "at", ["n"], "v", seconds, bucket=bucket), "decayed_mean")
    # A value whose weight has faded below what a double holds may be gone or not.
    close({n: x for n, x in got.items() if n != 9003}, {n: x for n, x in want.items() if n != 9003})


def test_too_long_a_bucket_is_refused(spark):
    with pytest.raises(ValueError):
        scans.decayed_mean(spark.createDataFrame([], KIND), ["who"], "at", ["n"], "v", 1.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], KIND)
    assert scans.running_max(df, ["who"], "at", ["n"], "v").collect() == scans.change_sum(df, ["who"], "at", ["n"], "v", 0.0, 0.0).collect() == []
    assert scans.decayed_mean(df, ["who"], "at", ["n"], "v", 1e5).collect() == []
