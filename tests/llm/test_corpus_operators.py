"""The corpus operators against brute force on small tables with awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm._common import materialize, row_key
from tempora.llm import bpe, decontamination, language, line_dedup, pii, quality, queries, secrets, sharding, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string"


def prose(seed, n, words=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" + ("\n" if r.random() < 0.1 else "") for _ in range(n))


PASSAGE = prose(99, 60, 5000)
TEXTS = [
    (0, prose(1, 80)), (1, prose(1, 80)), (2, prose(1, 79)), (3, f"{prose(2, 50)} {PASSAGE} {prose(3, 20)}"), (4, f"{prose(4, 10)} {PASSAGE} {prose(5, 70)}"),
    (5, ""), (6, None), (7, " \t\n\x0b "), (8, "one"), (9, "one two"), (None, prose(6, 60)), (None, prose(6, 60)), (None, None), (10, prose(7, 90)), (10, prose(7, 90)), (10, prose(8, 90)),
    (11, "é ü \U0001f600 naïve " * 30), (12, prose(9, 6000)), (13, (prose(10, 40) + " ") * 3), (14, "a " * 100),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "x", "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows(df):
    return df.collect()


# 1: sharding


def test_shards_are_gapless_and_grow_only_into_the_new_one(docs):
    tree = sharding.uniform_tree()
    out = rows(sharding.assign_shards(docs, tree, sharding.grown(tree, 16)))
    assert len(out) == len(TEXTS)
    for shard in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_shares_follow_weights_and_moves_stay_in_the_changed_subtree(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = sharding.uniform_tree()
    region0, region1 = tree.children
    rack = region0.children[0]
    heavy = sharding.Node(rack.children[0].name, 3.0, rack.children[0].shard)
    changed = sharding.Node("root", children=(sharding.Node(region0.name, children=(sharding.Node(rack.name, children=(heavy, *rack.children[1:])), region0.children[1])), region1))
    got = rows(keys.select(sharding.descend(F.col("doc_id").cast("string"), tree).alias("a"), sharding.descend(F.col("doc_id").cast("string"), changed).alias("b"), sharding.descend(F.col("doc_id").cast("string"), sharding.grown(tree, 16)).alias("c")))
    counts = collections.Counter(r["a"] for r in got)
    assert max(counts.values()) < 1.2 * min(counts.values())
    moved = [r for r in got if r["a"] != r["b"]]
    # Region 1 only loses, to region 0; the second rack of region 0 only loses to the first, or gains from region 1.
    assert moved and all(r["b"] < 8 for r in moved)
    assert all(r["c"] in (r["a"], 16) for r in got) and 0.8 / 17 < np.mean([r["c"] == 16 for r in got]) < 1.2 / 17


def test_sharding_nothing(empty):
    tree = sharding.uniform_tree()
    assert rows(sharding.assign_shards(empty, tree, sharding.grown(tree, 16))) == []


# 2: substrings


def brute_repeats(texts, window):
    seqs = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[k : k + window]) for w in seqs for k in range(len(w) - window + 1))
    out = []
    for w in seqs:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "minimiser", "hot"), [(35, 8, 2000), (35, 8, 1), (5, 3, 4), (3, 1, 2)])
def test_substrings(docs, window, minimiser, hot):
    out = rows(substring_dedup.remove_repeats(docs, window=window, minimiser=minimiser, hot_bucket=hot))
    want = collections.Counter((i, *b) for (i, _), b in zip(TEXTS, brute_repeats([t for _, t in TEXTS], window), strict=True))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == want


def test_substrings_of_nothing(empty):
    assert rows(substring_dedup.remove_repeats(empty)) == []


# 3: lines


def brute_chunks(text, roll=2, divisor=2):
    import xxhash

    lines = text.split("\n")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        r = h[i]
        for k in range(1, roll):
            if i >= k:
                r ^= ((h[i - k] << k) | (h[i - k] >> (64 - k))) & (2**64 - 1)
        if signed(r) % divisor == 0 or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def brute_lines(given, cut=brute_chunks):
    long = lambda c: sum(bool(WORD.search(x)) for x in c) >= 2
    found = [[("\n".join(c), long(c)) for c in cut(t)] if t is not None else None for _, t in given]
    places, owner = collections.Counter(), {}
    for (i, _), cs in zip(given, found, strict=True):
        for c, ok in cs or []:
            if ok:
                places[c] += 1
                if i is not None:
                    owner[c] = min(i, owner.get(c, i))
    out = []
    for (i, t), cs in zip(given, found, strict=True):
        if cs is None:
            out.append((i, None))
            continue
        seen, kept = set(), []
        for c, ok in cs:
            if ok and places[c] > 1 and (owner.get(c) != i or c in seen):
                continue
            seen.add(c)
            kept.append(c)
        out.append((i, "\n".join(kept)))
    return out


LINES = [
    (3, "a b\nc d\ne f\ng h\ni j\nk l"), (1, "x\na b\nc d\ne f\ng h\ni j\nk l\ny"), (2, "a b\nc d\ne f\ng h\ni j\nk l\na b\nc d\ne f\ng h\ni j\nk l"), (None, "a b\nc d\ne f\ng h\ni j\nk l"),
    (4, "only\nnulls"), (5, None), (6, ""), (7, "\n\n\n"), (8, "one line"), (9, "one line"), (None, "p q\nr s\nt u\nv w"), (None, "p q\nr s\nt u\nv w"), (10, "m n\no p\nq r\ns t"), (10, "m n\no p\nq r\ns t"),
]


@pytest.mark.parametrize("least", [0, 2])
def test_lines(spark, least):
    given = LINES + [(i, t) for i, t in TEXTS]
    df = spark.createDataFrame([(i, t, "n", 1, "r") for i, t in given], "doc_id long, text string, row string, rk int, hits string")
    out = rows(line_dedup.dedup_lines(df, least=least))
    want = brute_lines(given, lambda t: brute_least(t, least) if least else brute_chunks(t))
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(want)
    assert {(r["row"], r["rk"], r["hits"]) for r in out} == {("n", 1, "r")}
    assert any(r["n_removed_chunks"] for r in out)
    assert rows(line_dedup.dedup_lines(df.filter("false"))) == []


def brute_least(text, least):
    """brute_chunks' candidates, each taken only where the chunk holds ``least`` lines with a word."""
    solid = lambda c: sum(bool(WORD.search(x)) for x in c)
    out, now = [], []
    for c in brute_chunks(text):
        now += c
        if solid(now) >= least:
            out.append(now)
            now = []
    if now and out and solid(now) < least:
        out[-1] += now
    elif now:
        out.append(now)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_chunks_of_a_least_size(spark, least):
    r = random.Random(least)
    texts = ["", "\n", "one", "one\n", "\n\none\n \n", *("\n".join(r.choice(["", " ", f"w{r.randrange(99)}"]) if r.random() < 0.4 else f"w{r.randrange(9999)}" for _ in range(r.randrange(1, 40))) for _ in range(200))]
    out = rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.chunks(F.col("t"), least=least).alias("c")))
    assert all(x["c"] == brute_least(x["t"], least) for x in out)


def test_a_copy_of_several_lines_loses_all_its_text(spark, tmp_path):
    texts = [prose(1000 + i, 20 + 5 * i).replace(" ", "\n") for i in range(30)]
    texts = [t for t in texts if sum(bool(WORD.search(x)) for x in t.split("\n")) > 1]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = rows(queries.op3_lines(spark, str(tmp_path)))
    assert len(out) == 2 * len(texts) and all(not r["text"] for r in out if r["doc_id"] >= 100)
    assert all(WORD.search(r["text"]) for r in out if r["doc_id"] < 100)


def test_names_that_stand_for_different_chunks_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_name", lambda chunk: [F.length(chunk).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")])
    given = LINES + [(20, "a x\nc y\ne z\ng h"), (21, "a q\nc y\ne z\ng h"), (22, "a x\nc y\ne z\ng h")]
    for least in (0, 2):
        out = rows(line_dedup.dedup_lines(spark.createDataFrame(given, "doc_id long, text string"), least=least))
        want = brute_lines(given, lambda t, least=least: brute_least(t, least) if least else brute_chunks(t))
        assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(want)


def test_a_text_of_many_lines_takes_linear_time(spark):
    import time

    r = random.Random(1)
    long = "\n".join(f"w{r.randrange(5000)} v{r.randrange(3)}" for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "tail\n" + long)], "doc_id long, text string").repartition(3)
    start = time.monotonic()
    out = {x["doc_id"]: x["text"] for x in rows(line_dedup.dedup_lines(df, least=2))}
    assert not out[2].strip() and len(out[3]) < 100 and time.monotonic() - start < 60


def test_the_count_replaces_a_column_of_its_name(spark):
    out = rows(line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb", "x")], "doc_id long, text string, N_removed_chunks string")))
    assert [x.asDict() for x in out] == [{"doc_id": 1, "text": "a\nb", "n_removed_chunks": 0}]


def test_line_plan_has_no_python(docs):
    plan = line_dedup.repeated_chunks(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ScalaUDF", plan)


# 4: secrets

SECRET = [
    'PassWord = "abcdef1" token:abc token=abcdefg', "AKIA" + "A1" * 8 + " AKIA" + "B" * 15, "é " + "0123456789abcdef" * 2 + " fff", "api_key='x.y/z=-_9' apikey: 1234567",
    "secretsecret=aaaaaa tokenToken = 'bbbbbb'", "ghp_" + "a" * 30 + secrets.checksum("a" * 30), "ghp_" + "a" * 36, "npm_" + "Zz9" * 10 + secrets.checksum("Zz9" * 10), "", None, "İſ paſſword=abcdefgh toKen=abcdefgh",
]


def brute_secrets(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(spans)]


def base58(raw):
    n, out = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = secrets.BASE58[d] + out
    return out


def bech32(prefix, raw):
    """The token whose six last characters make the code hold: found one bit at a time, as the code is linear."""
    bits = "".join(f"{b:08b}" for b in raw)
    data = [int(bits[i : i + 5].ljust(5, "0"), 2) for i in range(0, len(bits), 5)]

    def rest(values):
        out = 1
        for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + values:
            high = out >> 25
            out = (out % 2**25) * 32 ^ v
            for i in range(5):
                out ^= secrets.BCH[i] * (high >> i & 1)
        return out

    code = rest(data + [0] * 6) ^ 1
    return prefix + "1" + "".join(secrets.BECH32[x] for x in data + [code >> 5 * (5 - i) & 31 for i in range(6)])


# A published test vector of extended private keys, and one of this kind of secret key.
VECTOR = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
CHECKED = [VECTOR, base58(bytes.fromhex("0488ADE4") + b"\x07" * 74), bech32("nsec", bytes(range(32))), bech32("age-secret-key-", b"k" * 32).upper()]
CHECKED += ["ghp_" + "q" * 30 + secrets.checksum("q" * 30), "npm_" + "Z9" * 15 + secrets.checksum("Z9" * 15)]


def brute_checked(t):
    out = []
    for kind, pattern in secrets.CHECKED.items():
        at = 0
        while m := pattern.search(t or "", at):
            ok = m[0] in CHECKED
            out += [(m.start(), m.end(), kind)] * ok
            at = m.end() if ok else m.start() + 1
    return sorted(out)


def test_tokens_are_reported_only_if_their_checksum_holds(spark):
    r = random.Random(12)
    assert secrets.base58_checks(VECTOR) and all(secrets.bech32_checks(x) for x in CHECKED[2:4]) and CHECKED[3].startswith("AGE-SECRET-KEY-1")
    texts = []
    for i in range(300):
        parts = []
        for _ in range(r.randrange(1, 6)):
            token = r.choice(CHECKED)
            if r.random() < 0.5:
                at = r.randrange(5, len(token))
                token = token[:at] + r.choice("2345679acdefACDEF") + token[at + 1 :]
            parts.append(r.choice(["", "é ", "key=", "xprv", "x "]) + token + r.choice([" ", ".", "a", "", "\n"]))
        texts.append(" ".join(parts))
    for x in rows(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))):
        got = [(s["start"], s["end"], s["kind"]) for s in x["spans"] if s["kind"] in secrets.CHECKED]
        assert sorted(got) == brute_checked(texts[x["doc_id"]])
        assert [(s["start"], s["end"], s["kind"]) for s in x["spans"] if s["kind"] not in secrets.CHECKED] == brute_secrets(texts[x["doc_id"]])


def test_secrets(spark):
    given = SECRET + [t for _, t in TEXTS]
    out = rows(secrets.find_secrets(spark.createDataFrame(list(enumerate(given)), "doc_id int, text string")))
    for r in out:
        spans = [(s["start"], s["end"], s["kind"]) for s in r["spans"]]
        assert [s for s in spans if s[2] in ("assign", "access", "hex")] == brute_secrets(given[r["doc_id"]])
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in out}
    assert "github" in found[5] and "github" not in found[6] and found[7] == ["npm"]
    assert secrets.redact("a password=abcdef b", [(2, 17, "assign")]) == "a [assign] b"
    assert rows(secrets.find_secrets(spark.createDataFrame([], "doc_id int, text string"))) == []


# 5: benchmark templates

ITEMS = [(0, "Alice has 3 apples and gives 2 of them to Bob who then walks 5 km home to eat them all."), (1, "Short question here"), (2, ""), (3, None), (4, "What is the sum of 17 and 25 if you add 17 to it once more and then halve the result?")]
CASES = [
    (0, "noise before. Alice has 3 apples and gives 2 of them to Bob who then walks 5 km home to eat them all. after"), (1, "Carol has 8 apples and gives 6 of them to Dave who then walks 9 miles home to eat them all."),
    (2, "what is the sum of 4 and 9 if you add 4 to it once more and then halve the result"), (3, "what is the sum of 4 and 9 if you add 6 to it once more and then halve the result"),
    (4, "and this is a short question here, it seems"), (5, "has 3 apples and gives 2 of them"), (6, None), (7, ""), (None, "What is the sum of 17 and 25 if you add 17 to it once more and then halve the result?"),
]


def test_a_long_part_of_a_longer_item_leaks(spark):
    words = prose(77, 90, 10**6).split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    parts = [(1, "so " + " ".join(words[30:60]) + " end"), (2, "so " + " ".join(words[30:50]) + " end")]
    out = rows(decontamination.leaks(spark.createDataFrame(parts, "doc_id long, text string"), items, least_words=0))
    assert [r["doc_id"] for r in out] == [1]


@pytest.mark.parametrize("prefilter", [1_000_000, 0])
def test_templates(spark, prefilter):
    docs = spark.createDataFrame([(i, t, "z", 7) for i, t in CASES], "doc_id long, text string, key string, h int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r["kind"] for r in rows(decontamination.leaks(docs, items, prefilter_hashes=prefilter))}
    assert out == {(0, 0): "verbatim", (1, 0): "reparameterised", (2, 4): "reparameterised", (4, 1): "verbatim", (None, 4): "verbatim"}
    kept = rows(decontamination.drop_contaminated(docs, items, prefilter_hashes=prefilter))
    assert sorted(r["doc_id"] for r in kept) == [3, 5, 6, 7] and kept[0]["key"] == "z"
    assert rows(decontamination.leaks(docs.filter("false"), items)) == [] == rows(decontamination.leaks(docs, items.filter("false")))


def brute_template(text):
    """(word, kind) of each word; kinds by the plain rules, for texts whose only names are listed ones."""
    words = [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", x).lower() for x in WORD.findall(text or "")) if w]
    out = []
    for k, w in enumerate(words):
        number = w[0].isdigit()
        listed = k > 0 and words[k - 1][0].isdigit() and w in decontamination.UNITS and not number
        unit = listed or (k > 0 and words[k - 1].isdigit() and "a" <= w[0] <= "z" and w not in decontamination.FUNCTION)
        out.append((w, "num" if number else "unit" if unit else "name" if w in decontamination.NAMES else None))
    return out


def brute_leaks(docs, items, window=8, cover=0.5, run=20, least_words=3, least_verbatim=5):
    def windows(words, size):
        for at in range(len(words) - size + 1):
            part = words[at : at + size]
            slots = [w for w, k in part if k]
            yield at, tuple(k or w for w, k in part), slots, size - len(slots)

    out = {}
    for item, question in items:
        theirs = brute_template(question)
        size = min(window, len(theirs))
        held = [w for w in windows(theirs, size) if w[3] >= least_words or size >= least_verbatim] if size else []
        strong = sum(w[3] >= least_words for w in held)
        for doc, text in docs:
            mine = collections.defaultdict(list)
            for pos, shape, slots, _ in windows(brute_template(text), size) if held else []:
                mine[shape].append((pos, slots))
            lines = collections.defaultdict(list)
            for at, shape, slots, literals in held:
                for pos, others in mine[shape]:
                    if literals >= least_words or slots == others:
                        lines[pos - at].append((at, literals >= least_words, list(zip(slots, others, strict=True))))
            matched, same = set(), False
            for met in lines.values():
                pairs = {p for *_, ps in met for p in ps}
                if len({a for a, _ in pairs}) == len(pairs):
                    matched |= {(at, ok) for at, ok, _ in met}
                    same |= all(a == b for a, b in pairs)
            share = max(len(matched) / len(held), sum(ok for _, ok in matched) / strong if strong else 0) if held else 0
            if matched and (share >= cover or len(matched) >= run):
                out[doc, item] = (len(held), len(matched), round(share, 9), "verbatim" if same else "reparameterised")
    return out


@pytest.mark.parametrize("prefilter", [1_000_000, 0])
def test_templates_against_brute_force(spark, prefilter):
    r = random.Random(11)
    plain = [f"{a}{b}" for a in ("lor", "mip", "sud", "tav", "kel") for b in ("ab", "en", "ir", "ot", "um")]
    names, units = decontamination.NAMES[:12], decontamination.UNITS[:10]
    common = " ".join(r.choice(plain) for _ in range(12))

    def question(n, numbers):
        out = []
        for _ in range(n):
            x = r.random()
            out += [f"#{r.randrange(90)}"] + ([f"@{r.choice(units)}"] if r.random() < 0.5 else []) if x < numbers else [f"^{r.choice(names)}"] if x < numbers + 0.05 else [r.choice(plain)]
        return out

    def say(words, change=lambda w: w):
        seen = {}
        return " ".join(seen.setdefault(w, change(w)).lstrip("#@^") if w[0] in "#@^" else w for w in words)

    made = [question(r.randrange(6, 45), 0.15) for _ in range(25)] + [question(r.randrange(5, 25), 0.9) for _ in range(5)]
    items = [(i, (common + " " if i % 3 == 0 else "") + say(q)) for i, q in enumerate(made)]
    items += [(100, "42"), (101, "12 kg"), (102, "7 8 9 10 11"), (103, None), (104, items[1][1]), (105, "3 lorab")]
    fresh = lambda w: {"#": f"#{r.randrange(100, 10**6)}", "@": w, "^": f"^{r.choice(names)}"}[w[0]]
    noise = lambda n: say(question(n, 0.2))
    docs, planted = [], []
    for i, q in enumerate(made):
        docs.append((3 * i, f"{noise(20)} {say(q)} {noise(9)}"))
        docs.append((3 * i + 1, f"{noise(10)} {say(q, fresh)} {noise(30)}"))
        docs.append((3 * i + 2, f"{noise(15)} {' '.join(say([w], fresh) for w in q)} {noise(5)}"))
        planted.append((3 * i + 1, i))
    docs += [(900, common + " " + noise(50)), (901, "42"), (902, "see 7, 8, 9, 10, 11 there"), (903, "see 7, 8, 9, 10, 12 there"), (904, " ".join([common] * 9)), (905, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_windows"], x["n_matched"], round(x["coverage"], 9), x["kind"]) for x in rows(decontamination.leaks(df, bench, prefilter_hashes=prefilter))}
    want = brute_leaks(docs, items)
    assert got == want
    assert (902, 102) in got and not any(i in (100, 101, 103, 105) for _, i in got)
    # Questions of numbers only can't be told apart once their numbers change.
    worth = [p for p in planted if p[1] < 25]
    assert sum(p in got and got[p][3] == "reparameterised" for p in worth) >= 0.9 * len(worth)


#: Questions whose names and units stand in no list: @ a name in the middle of a sentence, # a number, ^ a unit.
UNSEEN = [
    "Yesterday the farmer @ loaded # ^ of grain onto a cart and sold # ^ at the market before noon, how much was left?",
    "If a horse runs # ^ in one race and # ^ in the next, how far has it run in both races together?",
    "The tailor told @ that a coat needs # ^ of cloth while a cloak needs # ^ so how much must be bought for both?",
    "A ship carries # ^ of salt and @ unloads # ^ at the first port, what part of the cargo is still on board?",
    "During the week @ and @ picked # ^ of plums, then shared them evenly among # ^ at school, what did each receive?",
    "Every morning the old clock loses # ^ and gains # ^ at night, after how many days is it right again?",
]


def test_recall_with_names_and_units_in_no_list(spark):
    r = random.Random(23)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    fill = lambda t: "".join({"@": word().capitalize(), "#": str(r.randrange(2, 9000)), "^": word() + "s"}.get(c, c) for c in t)
    noise = lambda n: " ".join(word() for _ in range(n))
    items = [(i, fill(t)) for i, t in enumerate(UNSEEN)]
    docs = [(1000 * i + k, f"{noise(30)}. {fill(t)} {noise(20)}") for i, t in enumerate(UNSEEN) for k in range(20)]
    docs += [(9000 + k, f"{noise(40)} {r.randrange(99)} {noise(30)}") for k in range(40)]
    # A numbered copy of a short item, and one behind a bare number.
    items.append((50, "Which river flows north?"))
    docs += [(9900, "3. Which river flows north? 4. " + noise(9)), (9901, f"{noise(9)} 12 Which river flows north?")]
    out = rows(decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    found = {(x["doc_id"], x["item_id"]) for x in out}
    planted = {(d, d // 1000) for d, _ in docs if d < 9000}
    assert len(found & planted) >= 0.9 * len(planted) and min(sum((d, i) in found for d, _ in docs) for i in range(6)) >= 18
    assert found - planted == {(9900, 50), (9901, 50)}


# 6: BPE


@pytest.fixture(scope="module")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    with open(tokens.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), tokens.PATTERN


def test_bpe(docs, vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary[0].splitlines())}
    want = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})
    given = [t for _, t in TEXTS] + ["x" * 700, "<|endoftext|>", "\x00\x01 \U0010ffff", "'s 're   !!", "".join(chr(97 + i * i % 26) for i in range(400))]
    df = docs.sparkSession.createDataFrame([(i, t, 0) for i, t in enumerate(given)], "doc_id int, text string, ids int")
    encoded = bpe.encode(df, *vocabulary)
    for r in rows(encoded):
        assert r["ids"] == want.encode_ordinary(given[r["doc_id"]] or "")
    for r in rows(bpe.decode(encoded, *vocabulary)):
        assert bytes(r["decoded"]) == (given[r["doc_id"]] or "").encode()
    for r in rows(bpe.round_trip(df, *vocabulary, keep_ids=True)):
        assert r["decoded_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert rows(bpe.round_trip(df.filter("false"), *vocabulary)) == []


def test_bpe_hands_its_state_over(vocabulary, monkeypatch):
    codec = bpe.Codec(*vocabulary)
    whole = codec.encode_words([b" international", b"zzzzqqqq", "é".encode()])
    monkeypatch.setattr(bpe, "ROUND_ROWS", 1)
    assert codec.encode_words([b" international", b"zzzzqqqq", "é".encode()]) == whole


def test_long_words_go_in_pieces(vocabulary):
    import time

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary[0].splitlines())}
    want = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(*vocabulary)
    r = random.Random(6)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = ["x" * 3001, "ab" * 2000, "=" * 2500, draw("ab", 3000), draw("abcdefghijklmnopqrstuvwxyz", 5000), "é" * 900, draw("éèaß", 1500), draw("的一是", 900), "é" + "a" * 700 + " " + "the" * 600]
    for t in texts:
        assert codec.encode([t])[0].tolist() == want.encode_ordinary(t), t[:20]
    assert not any(len(w) > 600 for w in codec.words)
    huge = draw("abcdefghijklmnopqrstuvwxyz", 1_000_000)
    start = time.monotonic()
    ids = codec.encode([huge])
    assert codec.decode(ids)[0] == huge.encode() and time.monotonic() - start < 120
    # Every two neighbours are the encoding of their bytes, which decides the whole.
    spelt = {i: t for t, i in ranks.items()}
    pairs = {(a, b) for a, b in zip(ids[0][:-1].tolist(), ids[0][1:].tolist(), strict=True)}
    some = sorted(pairs)[::50]
    assert all(want.encode_ordinary((spelt[a] + spelt[b]).decode()) == [a, b] for a, b in some)


# 7: SimHash


def brute_print(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, ids):
    par = list(range(len(prints)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                par[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [least.get(find(a)) for a in range(len(prints))]


@pytest.mark.parametrize("hot", [32, 1])
def test_simhash(docs, hot):
    out = rows(simhash.near_duplicates(docs, hot_bucket=hot).select("doc_id", simhash.hex_fingerprint("fp").alias("f"), "component_id"))
    prints = [brute_print(t) for _, t in TEXTS]
    want = collections.Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(TEXTS, prints, brute_components(prints, [i for i, _ in TEXTS]), strict=True))
    assert collections.Counter(map(tuple, out)) == want


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_links_reach_what_all_pairs_reach(spark, hot):
    from tempora.operators.closure import connected_components

    r = random.Random(hot)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(4))}))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    links = materialize(simhash.links(df, hot_bucket=hot), "links")
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 or ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    labels = {x["node"]: x["label"] for x in connected_components(links, "a", "b", lambda d: materialize(d, "labels")).collect()}
    want = brute_components(prints, signed)
    got = [labels.get(p, p) for p in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_keep_one(docs, empty):
    kept = rows(simhash.keep_one(docs))
    comps = brute_components([brute_print(t) for _, t in TEXTS], [i for i, _ in TEXTS])
    # Three texts share id 10, of which two are equal: two components with that id.
    assert len(kept) == len(set(comps)) + 1 and {r["doc_id"] for r in kept} == set(comps)
    assert kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert rows(simhash.keep_one(empty)) == [] == rows(simhash.near_duplicates(empty))


def brute_near(texts, words=5, threshold=0.8):
    """The first place of each text's component."""
    split = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    split = [WORD.findall(t) for t in split]
    sets = [{tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set() for w in split]
    head = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] == sets[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])):
                old, new = max(head[a], head[b]), min(head[a], head[b])
                head = [new if h == old else h for h in head]
    return head


def test_the_near_duplicate_stage_finds_pairs_at_0_8_of_five_words(spark):
    import corpus_pipeline

    r = random.Random(5)
    texts = [t for _, t in TEXTS]
    for k in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        for n in (0, 2, 5, 8, 9, 14):
            other = list(words)
            for at in r.sample(range(300), n):
                other[at] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = rows(corpus_pipeline.near_duplicate_stage(spark, df, ""))
    want = set(brute_near(texts))
    assert len(want) < len(texts) - 12 and sorted(x["doc_id"] for x in kept) == sorted(want)


def test_a_large_group_of_near_copies_is_not_expanded(spark):
    """Texts with zero to eight changed words: the components are those of all pairs, with far fewer pairs compared."""
    from tempora.llm import near_copies

    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(400):
        other = list(base)
        for at in r.sample(range(150), r.randrange(9)):
            other[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(other))
    # Two more groups that hold a band in common with the first, but are far from it.
    texts += [" ".join(base[:75] + [f"y{k}"] + [f"z{at}" for at in range(75)]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = rows(near_copies.keep_one(df))
    assert sorted(x["doc_id"] for x in kept) == sorted(set(brute_near(texts)))
    plain = df.select("doc_id", F.col("text").cast("binary").alias("rk"), "text")
    sketches = materialize(near_copies._sketches(plain, 5), "sketches")
    shared = sketches.select("node", "size", F.posexplode("bands").alias("band", "code"))
    sets = near_copies._sets(sketches.join(plain.select("rk", "text"), "rk").dropDuplicates(["node"]), 5)
    apart = shared.withColumn("label", F.col("node"))
    # Without the stars' components, every similar pair is still met, and few others.
    met = {(bytes(x["a"]), bytes(x["b"])) for x in rows(near_copies._ordered(near_copies._rest(apart, sets, 0.8)))}
    node = {bytes(x["rk"]).decode(): bytes(x["node"]) for x in rows(sketches)}
    grams = {bytes(x["node"]): set(x["grams"]) for x in rows(sets)}
    similar = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert len(node) == len(texts) - sum(n - 1 for n in collections.Counter(texts).values()) and similar <= met and len(similar) > 1000


def test_keys_of_rows_are_not_ambiguous(spark):
    given = [("a|b", "c d e f"), ("a", "b|c d e f"), (None, "a"), ("a", None), ("", "a"), ("\u0001", "a"), ("1:a", ""), ("", "1:a"), (None, None), ("", None), (None, "")]
    df = spark.createDataFrame(given, "doc_id string, text string")
    assert df.select(row_key("doc_id", "text")).distinct().count() == len(given)
    kept = rows(simhash.keep_one(df.limit(2)))
    assert len(kept) == 2


def test_near_copies_keep_rows_that_share_an_id(docs, empty):
    from tempora.llm import near_copies

    kept = rows(near_copies.keep_one(docs))
    ids = [i for i, _ in TEXTS]
    groups = collections.defaultdict(set)
    for h, i in zip(brute_near([t for _, t in TEXTS]), ids, strict=True):
        groups[h].add(i)
    least = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert collections.Counter(x["doc_id"] for x in kept) == collections.Counter(least)
    assert rows(near_copies.keep_one(empty)) == []


# 8: language


def test_language(spark):
    r = random.Random(5)
    sounds = {"aa": "bakodu mila".split(), "bb": "strengt huwix zorb".split(), "cc": "él ñaqué oui".split()}
    given = [(i, " ".join(r.choice(sounds[lang]) + r.choice(sounds[lang]) for _ in range(r.randrange(5, 40))), lang) for i, lang in enumerate(r.choice(list(sounds)) for _ in range(300))]
    given += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", None), (None, given[0][1], "aa"), (1003, given[1][1], None)]
    df = spark.createDataFrame([(*g, "s") for g in given], "doc_id long, text string, lang string, row string")
    model = language.train(df)
    out = rows(language.identified(df, model))
    held = [x for x in out if x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["lang"] and x["lang_pred"] != "und"]
    assert len(held) > 30 and np.mean([x["lang"] == x["lang_pred"] for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in out) and {x["lang_pred"] for x in out if x["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    none = language.train(df.filter("false"))
    assert {x["lang_pred"] for x in rows(language.identified(df, none))} == {"und"}
    assert rows(language.identified(df.filter("false"), model)) == []


def test_ftrl_and_temperature_against_plain_versions():
    r = random.Random(2)
    examples = [(np.array(sorted(r.sample(range(12), 4))), np.array([r.random() * 3 for _ in range(4)]), r.randrange(3)) for _ in range(40)]
    w, bias = language.ftrl(examples, 3, epochs=2, alpha=0.3, beta=0.7, l1=0.1, l2=0.2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f, c):
        penalty = 0 if f == "bias" else 0.1
        if abs(z[f, c]) <= penalty:
            return 0.0
        return -(z[f, c] - penalty * (1 if z[f, c] > 0 else -1)) / ((0.7 + n[f, c] ** 0.5) / 0.3 + 0.2)

    for _ in range(2):
        for index, value, label in examples:
            x = [*zip(index.tolist(), value.tolist(), strict=True), ("bias", 1.0)]
            old = {(f, c): weight(f, c) for f, _ in x for c in range(3)}
            scores = [sum(v * old[f, c] for f, v in x) for c in range(3)]
            total = sum(np.exp(scores))
            for f, v in x:
                for c in range(3):
                    g = v * (np.exp(scores[c]) / total - (c == label))
                    z[f, c] += g - ((n[f, c] + g * g) ** 0.5 - n[f, c] ** 0.5) / 0.3 * old[f, c]
                    n[f, c] += g * g
    assert np.allclose(w[:12], [[weight(f, c) for c in range(3)] for f in range(12)], atol=1e-12) and not w[12:].any()
    assert np.allclose(bias, [weight("bias", c) for c in range(3)], atol=1e-12) and (w[:12] == 0).any()

    logits = np.array([[r.gauss(0, 4) for _ in range(3)] for _ in range(200)])
    labels = np.array([int(np.argmax(x)) if r.random() < 0.7 else r.randrange(3) for x in logits])

    def loss(t):
        out = 0.0
        for x, y in zip(logits.tolist(), labels.tolist(), strict=True):
            p = np.exp(np.array(x) / t) / np.exp(np.array(x) / t).sum()
            out -= sum((1 - 1 / 202 if c == y else 0.5 / 202) * np.log(p[c]) for c in range(3))
        return out

    got = language.temperature(logits, labels)
    assert loss(got) <= min(loss(got * 1.05), loss(got / 1.05))


def test_language_keeps_other_columns_and_long_texts_go_in_pieces(spark, monkeypatch):
    texts = ["bako dumi la " * 9, "strengt huwix zorb " * 9, None, "été ñ " * 3000]
    df = spark.createDataFrame([(i, t, "ab"[i % 2], "kept", "old", "x", 5) for i, t in enumerate(texts * 4)], "doc_id long, text string, lang string, row string, score string, found string, `a.b` int")
    model = language.train(df)
    out = rows(language.identified(df, model))
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "row", "found", "a.b", "lang_pred", "score"}
    assert {(r["row"], r["found"], r["a.b"]) for r in out} == {("kept", "x", 5)} and all(isinstance(r["score"], float) for r in out)
    whole = sorted(language.features(texts[3]).tolist()), [x.tolist() for x in language.counted(texts[3])], model.predict(texts[3])
    monkeypatch.setattr(language, "PIECE", 1000)
    assert whole[:2] == (sorted(language.features(texts[3]).tolist()), [x.tolist() for x in language.counted(texts[3])])
    assert abs(whole[2][1] - model.predict(texts[3])[1]) < 1e-9
    assert rows(language.identified(df.limit(0), model)) == []


# 9: personal data

PERSONAL = [
    "mail a.b@c.d_e@f.gh or x@y.z.w, é 4111 1111-1111 1111 ok", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.255", "+1 (743) 555-3824 or +123 or +4-9 30 1234567.", "1234567812345670 12345678901234567890123",
    "a@b a@b. @c.d é@f.g.h", None, "", "call (212) 555-0147 now", "ssn: 123-45-6780 and 000-12-3456", "Dear Alice Johnson, mail jane [at] example [dot] com", "9" * 3000, "1 " * 3000, "a" * 3000 + "@" + "b.c" * 500, "+" + "1." * 2000,
]


def brute_pii(t):
    t, out = t or "", []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(d[::-1])) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_pii(spark):
    given = PERSONAL + [t for _, t in TEXTS]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id int, text string, cands string")
    out = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in rows(pii.find_pii(df))}
    for i, t in enumerate(given):
        assert [s for s in out[i] if s[2] in pii.BASE] == brute_pii(t), i
    assert (5, 19, "national") in out[7] and (5, 16, "ssn") in out[8] and "name" in {s[2] for s in out[9]}
    assert rows(pii.find_pii(df.filter("false"))) == []


def test_the_classifier_adds_and_refuses_spans(spark):
    r = random.Random(9)
    number = lambda: f"{r.randrange(2, 9)}{r.randrange(8)}{r.choice('02345678')}-{r.randrange(200, 999)}-{r.randrange(1000, 10000)}"
    given, want = [], {}
    for i in range(400):
        n, person = number(), f"{r.choice('Alice Jean Maria Tom Zeb Quill'.split())} {r.choice('Johnson Moreau Keller Hart'.split())}"
        cases = [(f"please call {n} after five", "national", n), (f"order no {n} pieces left", None, n), (f"dear {person} wrote to us", "name", person), (f"over the {person} River there", None, person)]
        text, kind, what = r.choice(cases)
        given.append((i, text))
        want[i] = kind, text.index(what), text.index(what) + len(what)
    out = {x["doc_id"]: x["spans"] for x in rows(pii.find_pii(spark.createDataFrame(given, "doc_id long, text string")))}
    right = [([(s["kind"], s["start"], s["end"]) for s in out[i]] == ([want[i]] if want[i][0] else [])) for i, _ in given]
    assert np.mean(right) >= 0.95
    assert sum(bool(out[i]) for i in out if want[i][0]) > 100 and sum(not out[i] for i in out if not want[i][0]) > 100
    assert all(0.5 <= s["score"] <= 1 for x in out.values() for s in x)


def test_scores_are_those_of_the_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL[:11])], "doc_id int, text string")
    found = materialize(pii.candidates(df), "cands")
    model = pii.learn(found)
    out = rows(found.select(F.explode("cands").alias("c")).select("c.*", model.score(F.col("c")).alias("score")))
    assert len(out) > 5
    for c in out:
        assert abs(c["score"] - model.probability(c["kind"], tuple(c[f"v{i}"] for i in range(pii.VOTERS)), c["shape"])) < 1e-8
    # Features that no labeler sees have weights of their own.
    assert any(f[1:2] == ("length",) for f in model.weights) and any(f[1:2] == ("edge_before",) for f in model.weights)


@pytest.mark.parametrize("block", [2, 64])
def test_running_values(spark, block):
    r = random.Random(block)
    lists = [[r.randrange(-9, 99) for _ in range(n)] for n in (0, 1, 2, 3, 4, 7, 8, 9, 63, 64, 65, 300)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for merge, zero, plain in ((lambda a, x: a + x, 0, np.cumsum), (lambda a, x: F.greatest(a, x), -100, np.maximum.accumulate)):
        for x in rows(df.select("x", pii.running(F.col("x"), merge, zero, block=block).alias("y"))):
            assert x["y"] == (plain(x["x"]).tolist() if x["x"] else [])


def test_loose_spans_meet_no_base_span(spark):
    r = random.Random(3)
    span = lambda kind: (lambda a: {"kind": kind, "start": a, "end": a + r.randrange(1, 12)})(r.randrange(90))
    given = [(i, [span("name") for _ in range(r.randrange(6))], [span("email") for _ in range(r.randrange(6))]) for i in range(200)]
    kind = "array<struct<kind:string,start:int,end:int>>"
    df = spark.createDataFrame(given, f"i int, loose {kind}, base {kind}")
    for x in rows(df.select("*", pii._apart(F.col("loose"), F.col("base")).alias("free"))):
        want = [m for m in x["loose"] if not any(b["start"] < m["end"] and m["start"] < b["end"] for b in x["base"])]
        assert sorted(x["free"]) == sorted(want)


def test_a_text_of_many_spans(spark):
    import time

    text = " ".join(f"mail a{i}@b.org or 212-555-{i % 10000:04} and +1 (743) 555-{i % 10000:04}," for i in range(16_000))
    start = time.monotonic()
    out = rows(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    found = collections.Counter(s["kind"] for s in out[0]["spans"])
    assert len(text) > 800_000 and found["email"] == found["phone"] == 16_000 and time.monotonic() - start < 90


def test_pii_plan_has_no_python(docs):
    assert not re.search("Python|Pandas|Arrow|ScalaUDF", pii.candidates(docs)._jdf.queryExecution().toString())


def test_reliabilities_are_found():
    r = random.Random(1)
    true, counts = [0.95, 0.8, 0.7], collections.Counter()
    for _ in range(5000):
        y = 1 if r.random() < 0.6 else -1
        counts["email", tuple((y if r.random() < q else -y) if r.random() < 0.9 else 0 for q in true)] += 1
    posterior, reliability = pii.expectation_maximisation(counts)
    assert all(abs(reliability["email", i] - q) < 0.05 for i, q in enumerate(true))
    assert posterior["email", (1, 1, 1)] > 0.9 > 0.1 > posterior["email", (-1, -1, -1)]


# 10: quality


def test_quality(docs, spark):
    out = rows(quality.quality(docs))
    want = collections.Counter()
    for i, t in TEXTS:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        cover = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality.STATS), r["base_failed"]) for r in out) == want
    assert not any(r["kept"] for r in out if r["base_failed"])


def test_clean_texts_lose_their_boilerplate(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    body = lambda seed: prose(seed, 80, 10**9).translate(letters)
    given = [(i, f"share this page no {i}\n{body(i)}\n\n SHARE  this page no 7", None if i % 2 else "h", "kept") for i in range(40)]
    given += [(90, "share this page no 1\n" + body(90), "other", "kept"), (91, "short", "h", "kept"), (92, None, "h", "kept"), (0, given[0][1], "h", "kept")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, `a.b` string").withColumn("rk", F.lit(1))
    out = rows(quality.clean(df))
    want = [(i, body(i) + "\n", h) for i, _, h, _ in given[:40]] + [(90, given[40][1], "other"), (0, body(0) + "\n", "h")]
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out) == collections.Counter(want)
    assert all(r["a.b"] == "kept" and r["rk"] == 1 for r in out) and rows(quality.clean(df.limit(0))) == []
    # However large its share of the host: a line in more than 10 documents.
    high = {r["doc_id"]: r["n_removed_words"] for r in rows(quality.quality(df, max_share=1.0, most_docs=10))}
    assert high[1] == 10 and high[90] == 0


def test_boilerplate_is_counted_by_host(spark):
    common = " ".join(f"c{k}" for k in range(90))
    # Letters only: digits are normalised, and numbered words would be one line.
    letters = str.maketrans("0123456789", "abcdefghij")
    common = common.translate(letters)
    prose_ = lambda seed, n: prose(seed, n, 10**9).translate(letters)
    given = [(i, common + "\n" + prose_(i, 60), "hot") for i in range(20)] + [(100 + i, common + "\n" + prose_(i, 500), "hot") for i in range(5)] + [(200, common + "\n" + prose_(200, 60), "other")]
    given += [(i, prose_(i, 60), "hot") for i in range(300, 400)]
    out = {r["doc_id"]: r for r in rows(quality.quality(spark.createDataFrame(given, "doc_id long, text string, source string")))}
    assert not any(out[i]["kept"] for i in range(20)) and all(out[i]["n_removed_words"] == 90 for i in range(20))
    assert all(out[i]["kept"] for i in [*range(100, 105), 200, *range(300, 400)])
    assert rows(quality.quality(spark.createDataFrame([], "doc_id long, text string, source string"))) == []


def test_simhash_sends_no_unfolded_rows_through_the_driver(spark):
    """66 probes and two segments for each fingerprint: they are merged, however small their table looks."""
    from tempora.llm import simhash

    heads = materialize(spark.range(500).select(F.xxhash64("id").alias("fp")), "heads")
    found = simhash.links(heads)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    rows = found.collect()
    assert {(min(r), max(r)) for r in map(tuple, rows)} == {(min(a, b), max(a, b)) for h in [[x[0] for x in heads.collect()]] for a in h for b in h if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
