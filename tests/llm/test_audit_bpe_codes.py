"""The filter audit, BPE by forced boundaries and vector codes against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tempora.llm import filter_audit, forced_bpe, queries, vector_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11: the filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    ids = collections.defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            ids[text or ""].append(i)
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j < i for j in ids[t]),
        }
        rows.append((source or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = lambda r: any(x in r[1] for x in order[:k])  # noqa: B023, E731
                now = [r for r in here if f in r[1] and not gone(r)]
                shapley[f] += len(now)
                out[part, order, k + 1] = [
                    sum(not gone(r) and f not in r[1] for r in here), len(now), sum(f in r[1] and gone(r) for r in here), sum(r[1] == {f} for r in here), sum(r[2] for r in now), sum(r[3] for r in now),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


DOCS = [
    (1, "a b c", "s"), (2, "a b c", "t"), (2, "a b c", "t"), (3, None, "s"), (4, "", None), (None, "", "s"), (None, "a b c", ""), (5, " ".join(f"w{k}" for k in range(60)), "s"),
    (6, " ".join(f"w{k}" for k in range(60)), "s"), (6, " ".join(f"w{k}" for k in range(60)), "s"), (7, "x " * 70, "s"), (8, "# " + " ".join(f"w{k}" for k in range(80)), "t"),
    (9, "ABC DEF " * 40, "t"), (10, "é ü " * 60, "t"), (11, " ".join(f"v{k}" for k in range(200_000)), "u"), (12, "z" * 1_000_000, "u"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (6, None, 1), (7, 1, 0), (9, 1, 1), (99, 1, 1), (None, 1, 1)]


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found}
    assert len(out) == len(found)
    return out


def test_audit_agrees_with_every_order_by_hand(spark):
    docs = spark.createDataFrame([(i, t, s, "p", 1, 2, "x") for i, t, s in DOCS], "doc_id long, text string, source string, part string, mask int, n long, `key` string")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, good string")
    got, want = audited(filter_audit.audit(docs, labels)), brute_audit(DOCS, LABELS)
    assert got == want and len(got) == 600 * 4
    assert audited(filter_audit.audit(docs.repartition(7), labels.filter("false"))) == brute_audit(DOCS, [])


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []


def test_audit_of_a_large_group_of_copies(spark):
    docs = [(k, "one text", f"s{k % 3}") for k in range(500)] + [(k, f"text {k}", "s0") for k in range(500, 600)]
    got = audited(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, LABELS)


# 12: BPE by forced boundaries


@pytest.fixture(scope="module")
def file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def awkward():
    r = random.Random(5)
    pieces = list("ab '\n\t é日1.") + ["<|endoftext|>", "the", "'ll", "<|end", "\U0001f600", "　", "\x1c", "\x85", "  "]
    out = ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(400)]
    return [*out, "", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>" * 3, "x  <|endoftext|>  y", "é" * 500]


def test_ids_and_texts_are_the_librarys(file, library):
    codec = forced_bpe.Codec(file, cache_words=50)
    texts = awkward()
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        for text, ids in zip(part, codec.encode(part), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want, text
            assert codec.decode(ids.tolist()) == library.decode(want, skip_special_tokens=False) == text
    r = random.Random(6)
    for _ in range(50):
        ids = [r.randrange(50257) for _ in range(100)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_no_token_lies_across_a_boundary(file):
    codec = forced_bpe.Codec(file)
    r = random.Random(7)
    for _ in range(300):
        raw = "".join(r.choice(["ab", "q", "zx", "é", "7", "-", "th", "一"]) for _ in range(20)).encode()
        ids = codec._merged([codec.byte_ids[b] for b in raw])
        ends = set(np.cumsum([len(codec.bytes_of[i]) for i in ids]).tolist())
        cuts = codec.boundaries(raw).tolist()
        assert set(cuts) <= ends
        parts = [raw[a:b] for a, b in itertools.pairwise([0, *cuts, len(raw)])]
        assert b"".join(map(codec.fragment, parts)) == np.array(ids, "<u4").tobytes()


def test_round_trip_over_rows(spark, file, library):
    texts = [None, "", *awkward()[:60], "long " * 200_000, "c" * 1_000_000, "same", "same"]
    docs = spark.createDataFrame([(None if k % 9 == 0 else k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = collections.Counter(map(tuple, forced_bpe.round_trip(docs, file).collect()))
    want = collections.Counter()
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[None if k % 9 == 0 else k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = forced_bpe.decode(forced_bpe.encode(docs, file), file)
    assert collections.Counter(r["text"] for r in back.collect()) == collections.Counter(t or "" for t in texts)
    assert forced_bpe.round_trip(docs.filter("false"), file).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in forced_bpe.decode(nothing, file).collect()] == [""]


def test_other_files_are_refused(file):
    with pytest.raises(ValueError):
        forced_bpe.Codec(file.replace(b'"normalizer": null', b'"normalizer": {"type": "NFC"}').replace(b'"normalizer":null', b'"normalizer":{"type":"NFC"}'))


def test_query_holds_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_forced_bpe(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 13: vector codes


def brute_codes(rows):
    """rows: (vec_id, vector, label) as (vec_id, code, error, label_error) counts, and all entries' components."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return collections.Counter(), []
    width = len(kept[0][1]) // 8
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    books = [[cut(v)[p] for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    coded, total = [], collections.Counter()
    for i, v, lab in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        coded.append((i, bytes(k for _, k in found), sum(d for d, _ in found), lab))
        total[lab] += coded[-1][2]
    return collections.Counter((i, c, e, total[lab]) for i, c, e, lab in coded), [x for b in books for e in b for x in e]


def vectors(n, seed=1, size=16, spread=1.0):
    r = random.Random(seed)
    return [(k * 3, [r.gauss(0, spread) for _ in range(size)], r.choice(["a", "b", None])) for k in range(n)]


AWKWARD = [
    (None, [0.25] * 16, "a"), (500, None, "a"), (501, [0.1] * 15 + [None], "b"), (502, [float("nan")] * 16, "a"), (503, [float("inf")] + [0.0] * 15, "b"), (3, [0.5] * 16, "c"), (3, [0.5] * 16, "c"),
    (6, [-0.5] * 16, "only"), (9, [1e-9] * 16, None), (12, [-1e-9] * 16, None),
]
KIND = "vec_id long, embedding array<double>, label string, code int, error string, vector string, part int"


def coded(df):
    out, books = vector_codes.compress(df)
    return collections.Counter((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in out.collect()), [x for b in books for x in b.ravel().tolist()]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_codes_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT", hot)
    rows = vectors(150) + AWKWARD
    assert coded(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], KIND).repartition(5)) == brute_codes(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_codes_of_few_rows(spark, n):
    rows = vectors(n, seed=n)
    assert coded(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], KIND)) == brute_codes(rows)


def test_codes_of_large_components(spark):
    rows = vectors(40, seed=8, spread=2.0**15)
    assert coded(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], KIND)) == brute_codes(rows)
    rows = vectors(40, seed=8, spread=2.0**26)
    (got, books), (want, all_books) = coded(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], KIND)), brute_codes(rows)
    fits = lambda x: x if x < 1 << 63 else None
    assert books == all_books and {r[:3] for r in got} == {(i, c, fits(e)) for i, c, e, _ in want}
    for bad in ([1.0] * 15, [1e300] * 16):
        with pytest.raises(Exception, match="cut into|too large|different lengths"):
            coded(spark.createDataFrame([(1, bad, "a", 1, "x", "y", 2)], KIND))


def test_bounds_hold_and_filter():
    r = np.random.default_rng(3)
    entries, parts = r.integers(-2000, 2000, (16, 8)), r.integers(-2500, 2500, (400, 8))
    index, distance = vector_codes.Cells(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    twice = np.repeat(entries[:4], 4, axis=0)
    assert (vector_codes.Cells(twice).nearest(parts)[0] % 4 == 0).all()


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in vectors(60)], KIND)
    out, books = vector_codes.compress(df)
    for r in vector_codes.decode(out, books).collect():
        want = [x / 4096 for b, k in zip(books, bytes(r["code"]), strict=True) for x in b[k].tolist()]
        assert r["vector"] == want


def test_integers_take_offsets_into_account():
    column = pa.array([[0.1, 0.2], [1.0, -1.0], [0.5, 0.25]], pa.list_(pa.float64())).slice(1)
    assert vector_codes.integers(column, 2).tolist() == [[4096, -4096], [2048, 1024]]


def test_op6_encodes_no_known_word_again_when_its_memory_is_full():
    import public_tokenizers

    from tempora.llm import bpe

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    asked, encode = [], codec.encode_words
    codec.encode_words = lambda raw: asked.append(raw) or encode(raw)
    codec.cache_words = 8
    first = codec.encode(["alpha beta gamma delta"])
    again = codec.encode(["alpha beta one two three four five six"])
    assert len(asked) == 2 and not {b"alpha", b" beta"} & set(asked[1])
    assert len(codec.words) == 8 and codec.decode([*first, *again]) == [b"alpha beta gamma delta", b"alpha beta one two three four five six"]
