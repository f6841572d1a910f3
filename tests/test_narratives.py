"""Assignment to narratives and the choice of leaders against plain versions."""

import hashlib
import math
import random

import pytest

from tempora.operators import narratives as N
from tempora.sources.tables import save


def md5(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def greedy(ids, alike):
    """One pass in the drawn order."""
    leaders, out = [], {}
    for i in sorted(ids, key=lambda i: (md5(i), i)):
        if not any((min(i, j), max(i, j)) in alike for j in leaders):
            leaders.append(i)
    for i in set(ids) - set(leaders):
        near = [(alike[min(i, j), max(i, j)], -j) for j in leaders if (min(i, j), max(i, j)) in alike and (md5(j), j) < (md5(i), i)]
        out[i] = -max(near)[1]
    return out


@pytest.mark.parametrize("seed, n, links", [(1, 60, 90), (2, 120, 60), (3, 20, 190), (4, 5, 0)])
def test_leaders_are_those_of_one_pass(spark, seed, n, links):
    r = random.Random(seed)
    alike = {}
    while len(alike) < links:
        a, b = sorted(r.sample(range(n), 2))
        alike[a, b] = r.randrange(90, 100) / 100
    pairs = spark.createDataFrame([(*(p if r.random() < 0.5 else p[::-1]), s) for p, s in alike.items()] + [(None, 1, 1.0), (2, 2, 1.0)], "id_a long, id_b long, score double")
    got = {x["id"]: x["leader"] for x in N.followers(pairs, save).collect()}
    assert got == greedy(range(n), alike)


def test_a_long_chain_takes_few_rounds(spark):
    pairs = spark.range(0, 600).selectExpr("id AS id_a", "id + 1 AS id_b", "0.9D AS score")
    got = {x["id"]: x["leader"] for x in N.followers(pairs, save, max_rounds=16).collect()}
    assert got == greedy(range(601), {(i, i + 1): 0.9 for i in range(600)})


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def rows(seed, n, size=8):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) + (2 if k == i % 3 else 0) for k in range(size)], f"n{i % 3}") for i in range(n)]


KIND = "id long, e array<double>, narrative string"


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_the_nearest_narrative_or_none(spark, monkeypatch, sent):
    monkeypatch.setattr(N, "MOST_SENT", sent)
    old, new = rows(1, 30), rows(2, 80)
    seeds = spark.createDataFrame([*old, (90, None, "n1"), (91, [0.0] * 8, "n1"), (92, [1.0] * 8, None)], KIND)
    centroids = save(N.sums(seeds, "narrative", "id", "e", 8))
    want_c = {name: [sum(c) for c in zip(*[unit(v) for _, v, m in old if m == name])] for name in ("n0", "n1", "n2")}
    got_c = {r["narrative"]: (r["total"], r["n"]) for r in centroids.collect()}
    assert {k: n for k, (_, n) in got_c.items()} == {"n0": 10, "n1": 10, "n2": 10}
    assert all(abs(a - b) < 1e-9 for k in want_c for a, b in zip(want_c[k], got_c[k][0], strict=True))
    asked = spark.createDataFrame([(i, v) for i, v, _ in new] + [(900, None), (901, [float("nan")] * 8), (902, [1.0])], "id long, e array<double>")
    got = {r["id"]: r["narrative"] for r in N.assign(asked, centroids, "narrative", "id", "e", 8, 0.5).collect()}
    want = {}
    for i, v, _ in new:
        score, name = max((sum(a * b for a, b in zip(unit(v), unit(c), strict=True)), k) for k, c in want_c.items())
        want[i] = name if score >= 0.5 else None
    assert got == want and None in want.values()


def test_no_narratives_yet(spark):
    none = N.sums(spark.createDataFrame([], KIND), "narrative", "id", "e", 8)
    found = N.assign(spark.createDataFrame(rows(1, 5), KIND).drop("narrative"), none, "narrative", "id", "e", 8, 0.1)
    assert [r["narrative"] for r in found.collect()] == [None] * 5


def test_a_run_adds_to_the_sums_before(spark):
    one, two = spark.createDataFrame(rows(1, 20), KIND), spark.createDataFrame(rows(2, 25), KIND)
    apart = N.merged(N.sums(one, "narrative", "id", "e", 8).unionByName(N.sums(two, "narrative", "id", "e", 8)), "narrative")
    at_once = N.sums(one.unionByName(two), "narrative", "id", "e", 8)
    a, b = ({r["narrative"]: r for r in x.collect()} for x in (apart, at_once))
    assert {k: r["n"] for k, r in a.items()} == {k: r["n"] for k, r in b.items()}
    assert all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k]["total"], b[k]["total"], strict=True))
