"""Full-text search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from tempora.operators.full_text import B, K1, FullText
from tempora.sources.tables import own_folder, save

NOW = "2024-02-01 00:00:00"


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def made(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(40)], k=r.randrange(0, 60))), f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(n)]


def index_of(spark, docs, runs=1, **more):
    out = FullText(spark, own_folder(spark, "text"), **more)
    df = spark.createDataFrame(docs, "id long, text string, known_at string")
    for run in range(runs):
        out.add(df.filter(f"pmod(coalesce(id, 0), {runs}) = {run}"), str(run))
    return out


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


def bm25(docs, query, k):
    held = {i: split(t) for i, t, _ in docs}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(w for words in held.values() for w in set(words))
    out = []
    for i, words in held.items():
        tf = Counter(words)
        s = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(words) / mean)) for w in split(query) if tf[w])
        if any(tf[w] for w in split(query)):
            out.append((-round(s, 6), i))
    return [i for _, i in sorted(out)[:k]]


def test_ranked_as_the_plain_version(spark):
    docs = made(1, 150)
    queries = ["w1 w5 w5 w30", "w0", "unheard", "", "W39, w38!"]
    got = index_of(spark, docs, runs=3).search(asked(spark, *queries), 7).orderBy("qid", "rank").collect()
    for q, text in enumerate(queries):
        assert [r.id for r in got if r.qid == q] == bm25(docs, text, 7)


def test_an_instant_sees_nothing_later(spark):
    docs = made(2, 120)
    then = "2024-01-10 00:00:00"
    past = [d for d in docs if d[2] <= then]
    whole, early = index_of(spark, docs, runs=2), index_of(spark, past)
    queries = asked(spark, "w2 w9 w17", "w0 w1")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(whole.search(queries, 10, as_of=then)) == rows(early.search(queries, 10)) != rows(whole.search(queries, 10))
    assert rows(whole.phrases(queries, save, as_of=then)) == rows(early.phrases(queries, save))


def test_phrases_as_the_plain_version(spark):
    docs = made(3, 120) + [(900, "a a a a b", NOW), (901, "b a a", NOW), (902, None, NOW), (903, "", NOW), (904, "Über-Straße №5, a A", NOW)]
    phrases = ["w0 w1", "w0 w0", "a a", "w3", "w0 w1 w2", "b a a", "über straße", "w0 unheard", "", "5 a a"]
    got = {(r.qid, r.id): r.times for r in index_of(spark, docs, runs=2).phrases(asked(spark, *phrases), save).collect()}
    want = {}
    for q, text in enumerate(phrases):
        p = split(text)
        for i, t, _ in docs:
            w = split(t)
            n = sum(w[j : j + len(p)] == p for j in range(len(w) - len(p) + 1)) if p else 0
            if n:
                want[q, i] = n
    assert got == want and got[2, 900] == 3


def test_repeated_runs_empty_tables_and_nulls(spark):
    docs = [(1, "x y", NOW), (2, "x", NOW), (None, "x", NOW)]
    index = index_of(spark, docs)
    index.add(spark.createDataFrame(docs, "id long, text string, known_at string"), "0")
    assert sorted(r.id for r in index.search(asked(spark, "x"), 5).collect()) == [1, 2]
    empty = index_of(spark, [])
    empty.add(spark.createDataFrame([], "id long, text string, known_at string"), "0")
    assert empty.search(asked(spark, "x"), 5).isEmpty() and empty.phrases(asked(spark, "x"), save).isEmpty()
    assert index.search(spark.createDataFrame([], "qid int, text string"), 5).isEmpty()


def test_a_long_text_and_a_word_that_all_hold(spark):
    long = " ".join(f"v{i % 5000}" for i in range(200_000))
    docs = [(0, long, NOW)] + [(i, "the end", NOW) for i in range(1, 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = index_of(spark, docs, buckets=4, slices=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.id, r.times) for r in index.phrases(asked(spark, "v4999 v0 v1"), save).collect()] == [(0, 39)]
    assert [r.id for r in index.search(asked(spark, "the"), 3).orderBy("rank").collect()] == [1, 2, 3]
    hits = index.postings().filter("term = 'the'")
    assert hits.count() == 399 and hits.selectExpr("input_file_name() f").distinct().count() > 1


def test_a_search_opens_the_folders_of_its_terms(spark):
    index = index_of(spark, made(4, 50), buckets=8)
    plan = index.frequencies(index._asked(asked(spark, "w3")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in text or "PartitionFilters: [(bucket#" in text or "PartitionFilters: [bucket#" in text
    with pytest.raises(Exception, match="positions"):
        index.documents().select("positions").count()
