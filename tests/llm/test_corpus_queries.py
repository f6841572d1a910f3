"""The corpus queries against their SQL, and the pipeline against brute force stage by stage."""

import base64
import collections
import glob
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tempora.llm import language, queries
from tempora.llm._common import materialize
from test_corpus_operators import brute_least, brute_lines, brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert collections.Counter(tuple(r[c] for c in order) for r in got.collect()) == collections.Counter(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order) for r in want.fetchall())


def test_rows_without_a_host_count_in_both(spark, tmp_path):
    docs = [(i, "the same line here\n" + " ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), None if i % 2 else "h", i) for i in range(16)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, n_removed_words FROM ({queries.ORACLE_SQL['op10_quality']})").fetchall()}
    got = {r["doc_id"]: r["n_removed_words"] for r in queries.op10_quality(spark, str(tmp_path)).collect()}
    assert got == want and set(got.values()) == {4}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(3)
    vocabulary = {"en": "the of and river stone walk under".split(), "fr": "les été où garçon très près naïf".split()}
    make = lambda lang, n: "\n".join(" ".join(r.choice(vocabulary[lang]) + r.choice(vocabulary[lang]) for _ in range(12)) for _ in range(n))
    item = " ".join(r.choice(vocabulary["en"]) + r.choice(vocabulary["en"]) for _ in range(20))
    docs = [(i, make(lang := r.choice(["en", "fr"]), r.randrange(2, 9)), lang) for i in range(80)]
    shared = make("en", 6)
    docs += [(100 + i, docs[0][1], docs[0][2]) for i in range(4)] + [(110 + i, make("en", 2) + "\n" + shared + "\n" + make("en", 2), "en") for i in range(5)]
    docs += [(120, make("en", 1) + "\n" + item + " " + make("en", 1), "en"), (130, None, "en"), (131, "", None), (132, "12 34 !!", "en"), (None, make("fr", 3), "fr"), (140, docs[5][1], docs[5][2]), (140, docs[5][1], docs[5][2])]
    rows = [(i, t, lang, f"s{k % 3}", len(t or "")) for k, (i, t, lang) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, item


def test_pipeline(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    root, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near duplicates", "benchmark", "tokens"]
    # language
    model = language.train(docs)
    want = [r for r in docs.collect() if (told := model.judge(r["text"]))[0] != "und" and told[1] >= pipeline.LEAST_SCORE and told[2]]
    one = stages["language"](spark, docs, root)
    assert one.columns == docs.columns and collections.Counter(one.collect()) == collections.Counter(want)
    assert not {130, 131, 132} & {r["doc_id"] for r in want}
    # lines
    two = stages["lines"](spark, one, root)
    short = brute_lines([(r["doc_id"], r["text"]) for r in want], lambda t: brute_least(t, 2))
    kept = [(i, t) for (i, t), r in zip(short, want, strict=True) if t == r["text"] or t.split()]
    got = two.collect()
    assert two.columns == docs.columns and collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and sum(len(t) for _, t in kept) < sum(len(r["text"]) for r in want)
    # near duplicates
    three = stages["near duplicates"](spark, two, root)
    groups = collections.defaultdict(list)
    for head, (i, _) in zip(brute_near([t for _, t in kept]), kept, strict=True):
        groups[head].append(i)
    heads = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert three.columns == docs.columns and sorted(str(r["doc_id"]) for r in three.collect()) == sorted(map(str, heads))
    # benchmark
    four = stages["benchmark"](spark, three, root)
    assert four.columns == docs.columns
    left = {r["doc_id"] for r in three.collect()} - {r["doc_id"] for r in four.collect()}
    assert left == {i for i, t in kept if item in t}
    # tokens
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = collections.Counter((r["doc_id"], tuple(own.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in four.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in pipeline.run(spark, root).collect()) == texts


def test_the_language_stage_rejects_what_is_in_no_known_language(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    r = random.Random(4)
    junk = ["Однажды в студёную зимнюю пору я из лесу вышел был сильный мороз", "我能吞下玻璃而不伤身体", "".join(r.choice("bcdfgjklmnpqvwxyz ") for _ in range(400)), "QmFzZTY0IGVuY29kaW5nIHNjaGVtZXMgYXJl " * 5, "12 34 !!", "", None]
    more = spark.createDataFrame([(1000 + i, t, None, "s", 1) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in pipeline.language_stage(spark, docs.unionByName(more), root).collect()}
    assert not {i for i in kept if i is not None and i >= 1000}
    assert kept == {r["doc_id"] for r in docs.collect()} - {130, 131, 132}


def test_the_pipeline_keeps_other_columns_and_gives_nothing_for_nothing(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet").filter("doc_id < 12 or doc_id is null")
    odd = {c: c.upper() for c in ("row", "score", "lang_pred", "familiar", "removed0", "rk", "key", "node", "a`b", "c.d")}
    wide = docs.select("*", *[F.lit(v).alias(c) for c, v in odd.items()])
    plain = docs
    for name, stage in pipeline.STAGES[:-1]:
        wide, plain = materialize(stage(spark, wide, root), "wide"), materialize(stage(spark, plain, root), "plain")
        assert wide.columns == [*docs.columns, *odd], name
        got = [r.asDict() for r in wide.collect()]
        assert all(r[c] == v for r in got for c, v in odd.items())
        assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r["doc_id"]), r["text"]) for r in plain.collect())
    assert plain.count() > 5
    nothing = docs.filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, root).count() == 0


def test_pipeline_leaves_no_copy_of_several_lines(spark, folder):
    """What is left of a document that repeats another one of several lines: nothing, not a fragment."""
    pipeline = pytest.importorskip("corpus_pipeline")
    root, _ = folder
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    out = {r["doc_id"] for r in pipeline.run(spark, root).collect()}
    copies = [100, 101, 102, 103, 140]
    assert all("\n" in texts[i] for i in copies) and {0, 5} <= out
    assert not out & set(copies)
