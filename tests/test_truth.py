"""Truth among conflicting claims, against a plain version and planted reliabilities."""

import math
import random
from collections import defaultdict

import pytest

from tempora.operators import truth
from tempora.sources.tables import save


def plain(claims, priors, wrong, strength, turns):
    claims = {c for c in claims if None not in c and c[2] in priors}
    a = {s: min(max(p, truth.LEAST), truth.MOST) for s, p in priors.items()}

    def probabilities():
        scores = defaultdict(dict)
        for o, v, s in claims:
            scores[o][v] = scores[o].get(v, 0.0) + math.log(wrong * a[s] / (1 - a[s]))
        out = {}
        for o, by in scores.items():
            total = sum(map(math.exp, by.values())) + max(0, wrong + 1 - len(by))
            out[o] = ({v: math.exp(x) / total for v, x in by.items()}, max(0, wrong + 1 - len(by)) / total)
        return out

    for _ in range(turns):
        p = probabilities()
        right, n = defaultdict(float), defaultdict(int)
        for o, v, s in claims:
            right[s] += p[o][0][v]
            n[s] += 1
        a = {s: min(max((priors[s] * strength + right[s]) / (strength + n[s]), truth.LEAST), truth.MOST) for s in priors}
    return probabilities(), a


def planted(seed, objects, accuracies, values=4):
    r = random.Random(seed)
    right = {o: r.randrange(values) for o in range(objects)}
    claims = [(o, str(v if r.random() < acc else r.choice([x for x in range(values) if x != v])), s) for s, acc in accuracies.items() for o, v in right.items() if r.random() < 0.7]
    return claims, {o: str(v) for o, v in right.items()}


def estimate(spark, claims, priors, wrong=3, **more):
    c = spark.createDataFrame(claims, "object long, value string, source string")
    return truth.estimate(c, spark.createDataFrame(list(priors.items()), "source string, prior double"), wrong, save, **more)


def test_as_the_plain_version(spark):
    claims, _ = planted(1, 60, {"a": 0.9, "b": 0.7, "c": 0.5, "d": 0.3})
    # Repeats, a source with two values for an object, nulls, a source without a prior, one without a claim.
    claims += claims[:20] + [(0, "0", "a"), (0, "1", "a"), (None, "1", "a"), (3, None, "b"), (4, "2", None), (5, "1", "stranger"), (1000, "9", "stranger")]
    priors = {"a": 0.95, "b": 0.85, "c": 0.7, "d": 0.5, "idle": 0.7}
    got = estimate(spark, claims, priors, turns=5, tolerance=0.0)
    p, a = plain(claims, priors, 3, 10.0, 5)
    rows = got.values.collect()
    assert len(rows) == sum(len(by) for by, _ in p.values())
    for r in rows:
        assert r.probability == pytest.approx(p[r.object][0][r.value], abs=1e-9) and r.unknown == pytest.approx(p[r.object][1], abs=1e-9)
    assert {r.source: r.reliability for r in got.sources.collect()} == pytest.approx(a, abs=1e-9)


def test_planted_reliabilities_are_found_and_priors_are_no_verdict(spark):
    accuracies = {"wire": 0.6, "channel": 0.95, "x": 0.8, "y": 0.8, "z": 0.7}
    claims, right = planted(2, 400, accuracies)
    got = estimate(spark, claims, {"wire": 0.85, "channel": 0.5, "x": 0.7, "y": 0.7, "z": 0.7})
    found = {r.source: r.reliability for r in got.sources.collect()}
    assert all(abs(found[s] - acc) < 0.08 for s, acc in accuracies.items()) and found["channel"] > found["wire"]
    best = {}
    votes = defaultdict(lambda: defaultdict(int))
    for o, v, _ in set(claims):
        votes[o][v] += 1
    for r in got.values.collect():
        best[r.object] = max(best.get(r.object, (0, "")), (r.probability, r.value))
    share = sum(best[o][1] == right[o] for o in best) / len(best)
    majority = sum(max(by, key=by.get) == right[o] for o, by in votes.items()) / len(votes)
    assert share > 0.9 and share > majority
    assert got.turns < 30


def test_turns_run_on_patterns_not_on_objects(spark):
    claims = [(o, "t" if s != "c" else "f", s) for o in range(500) for s in "abc"] + [(o, "u", "a") for o in range(500, 700)]
    got = estimate(spark, claims, {"a": 0.7, "b": 0.7, "c": 0.7})
    assert got.patterns == 2 and got.values.count() == 1200
    # Values whose sources are the same people are told apart by their object only.
    two = estimate(spark, [(1, "x", "a"), (1, "y", "a"), (2, "z", "a")], {"a": 0.9})
    assert {(r.object, r.value): round(r.probability, 6) for r in two.values.collect()}[(1, "x")] == {(r.object, r.value): round(r.probability, 6) for r in two.values.collect()}[(1, "y")]


def test_more_agreement_less_doubt_and_empty_tables(spark):
    got = estimate(spark, [(1, "x", s) for s in "abcd"] + [(2, "x", "a"), (2, "y", "b"), (3, "x", "a")], {s: 0.7 for s in "abcd"}, turns=1)
    doubt = {r.object: r.disagreement for r in got.values.collect()}
    assert doubt[1] < doubt[3] < doubt[2] and all(0 <= x <= 1 for x in doubt.values())
    sums = defaultdict(float)
    for r in got.values.collect():
        sums[r.object] += r.probability
    unknown = {r.object: r.unknown for r in got.values.collect()}
    assert all(sums[o] + unknown[o] == pytest.approx(1.0) for o in sums)
    none = estimate(spark, [], {"a": 0.7})
    assert none.values.isEmpty() and [tuple(r) for r in none.sources.collect()] == [("a", 0, pytest.approx(0.7))]
    assert estimate(spark, [(1, "x", "a")], {}).values.isEmpty()
