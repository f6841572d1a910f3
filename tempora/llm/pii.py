"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the matches of patterns: the base kinds (email, ip, card, phone)
and looser ones (spelled-out addresses, national telephone numbers, social
security numbers, pairs of capitalised words). Four labelers vote on each
candidate, for, against or not at all:

* the form: a regular expression on the candidate, stricter than what found it,
* a gazetteer: tables of keys (endings, area codes, given names and the like)
  that such data has, or never has; the tables are parameters,
* the words in front of it, and
* the words behind it, which ask for such data or for something else.

Votes of one kind and pattern of votes are counted over all documents; the
counts are a table whose size depends on the labelers alone. Expectation-
maximisation (labelers err independently, with rates of their own for each side
of each kind) runs on that table. Its posteriors are the soft labels on which the
final classifier is trained: a logistic regression over the votes and over
features that no labeler sees (length, separators, variety of digits, what
stands right before and behind), applied as a DataFrame expression. So a span
without votes can be told by its shape, and one voted for can be refused.

Base spans that pass their rule are always reported; a looser span is reported
if it meets no base span and the classifier gives it at least ``threshold``.

Defined cases: a null text has no span; a match that fails its rule is dropped
without another try inside it; offsets count code points; repeated rows share
their result; if no candidate exists, or only base ones, nothing is added; work
on a very long text grows like its matches to the power of 4/3 at most; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize

# The base kinds and their patterns, in the order in which kinds
# are listed. Groups are possessive and starts anchored behind the last
# character that could extend the match to the left (or the end of the last
# match): the matches are the same, without retries inside long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]?(?:\x20at\x20|\bat\b|@)[\])]?\x20?[A-Za-z0-9-]{1,63}"
    r"\x20?[\[(](?:dot|\.)[\])]\x20?[A-Za-z]{2,12}(?![A-Za-z])",
    "national": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?!(?:Dear|Hello|Mr|Mrs|Ms|Dr|Prof|Call|Contact|Mail|Name|Signed|Regards)\x20)[A-Z][a-z]{1,24}\x20(?:[A-Z]\.\x20)?[A-Z][a-z]{1,24}(?![A-Za-z])",
}
KINDS = [*BASE, *LOOSE]
#: What must be in a text for a kind's pattern to be worth trying.
HINTS = {"email": ["@"], "phone": ["+"], "spelled": ["(", "["]}
DIGITS = ("ip", "card", "national", "ssn")
# The strict form of each kind.
FORMS = {
    "email": r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,12}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}$",
    "phone": r"^\+[1-9][0-9\x20().-]{8,20}$",
    "spelled": r"(?i)^[A-Za-z0-9._%+-]+\W+at\W+[A-Za-z0-9-]+\W+dot\W+[A-Za-z]{2,12}$",
    "national": r"^(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"^[A-Z][a-z]{2,9}\x20(?:[A-Z]\.\x20)?[A-Z][a-z]{2,14}(?<!tion|ment|ness|shire|ville)$",
}
# What of a candidate is looked up, and the keys that speak for and against it.
KEYS = {
    "email": r"([A-Za-z0-9-]+)$", "ip": r"^([0-9]+)", "card": r"^([0-9])", "phone": r"^\+([0-9])",
    "spelled": r"([A-Za-z]+)$", "national": r"([0-9]{3})", "ssn": r"^([0-9]{3})", "name": r"^([A-Za-z]+)",
}
_ENDINGS = "com net org edu gov info io co de fr es uk it nl eu us ca au ch at se pl".split()
_GIVEN = (
    "alice bob carol dave emma jack jane john james mary maria michael sarah thomas anna david daniel peter paul susan linda "
    "robert william george henry laura mark julia sophie olivia noah liam mia lucy kate amy lisa tom ben sam anton clara hans "
    "karl marie pierre jean luc claire jose juan carlos ana luis elena pablo sofia"
).split()
_PLACES = (
    "the new united north south east west saint san los las great lake mount port fort royal national general first second "
    "january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday all this that in on at by for from and but as if it he she we you they"
).split()
GAZETTEERS: Mapping[str, tuple[Sequence[str], Sequence[str]]] = {
    "email": (_ENDINGS, "png jpg jpeg gif css js html py txt zip".split()),
    "ip": ([str(n) for n in range(1, 224) if n != 127], ["0", "127", "255"]),
    "card": (["2", "3", "4", "5", "6"], ["0"]),
    "phone": ([str(n) for n in range(1, 10)], ["0"]),
    "spelled": (_ENDINGS, []),
    # Area codes: the first digit 2 to 9, the second not 9; N11 are services.
    "national": ([str(n) for n in range(200, 1000) if n // 10 % 10 != 9 and n % 100 != 11], [f"{n:03}" for n in range(200)] + [str(n) for n in range(211, 1000, 100)]),
    "ssn": ([f"{n:03}" for n in range(1, 900) if n != 666], ["000", "666"] + [str(n) for n in range(900, 1000)]),
    "name": (_GIVEN, _PLACES),
}
# Words in front that speak for and against each kind, and words behind.
_CALL = r"(?i)(?:phone|tel|telephone|call|calls|mobile|cell|fax|contact|dial|ring)\W*(?:me|us|him|her|at|on|is)?\W*$"
_NUMBERED = r"(?i)(?:isbn|order|serial|tracking|id|version|invoice|part|item|ref|reference)\W*(?:no|number|code)?\W*$"
BEFORE = {
    "email": (r"(?i)(?:e-?mail|contact|write|reach|mailto|from|to)\W*(?:me|us|at)?\W*$", r"(?i)(?:git|ssh|package|version)\W*$"),
    "ip": (r"(?i)(?:ip|address|host|server|client|from)\W*$", r"(?i)(?:version|v|release|section)\W*$"),
    "card": (r"(?i)(?:card|visa|credit|debit|payment|account|number|no)\W*$", _NUMBERED),
    "phone": (_CALL, r"(?i)(?:version|offset|score)\W*$"),
    "spelled": (r"(?i)(?:e-?mail|contact|write|reach|address|mail)\W*(?:me|us|to|at)?\W*$", r"(?i)(?:see|page|line|look)\W*$"),
    "national": (_CALL, _NUMBERED),
    "ssn": (r"(?i)(?:ssn|social|security|taxpayer|tax)\W*(?:no|number|id|is)?\W*$", r"(?i)(?:isbn|order|serial|part|date|item|ref)\W*(?:no|number|code)?\W*$"),
    "name": (r"(?i)(?:mr|mrs|ms|dr|prof|name|named|contact|dear|called|signed|by|regards)\W*(?:is)?\W*$", r"(?i)(?:saint|st|port|fort|lake|mount|the|of|in|at)\W*$"),
}
BEHIND = {
    "email": (r"(?i)^\W*(?:or call|or phone|for (?:more|details)|if you)", r"(?i)^(?::|/)\w"),
    "ip": (r"(?i)^(?::[0-9]{2,5}\b|\W*(?:port|host|server))", r"(?i)^\W*(?:release|version|section)"),
    "card": (r"(?i)^\W*(?:exp|expires|cvv|cvc|valid)", r"(?i)^\W*(?:bytes|rows|times|units|percent)"),
    "phone": (r"(?i)^\W*(?:ext|mobile|fax|home|office|after|between|or e-?mail)", r"(?i)^\W*(?:points|degrees|units)"),
    "spelled": (r"(?i)^\W*(?:or call|or phone|for (?:more|details)|if you)", r"(?i)^\W*(?:line|page)"),
    "national": (r"(?i)^\W*(?:ext|mobile|fax|home|office|after|between|or e-?mail)", r"(?i)^\W*(?:units|pieces|pages|items|edition)"),
    "ssn": (r"(?i)^\W*(?:dob|born|and date of birth)", r"(?i)^\W*(?:units|pieces|edition)"),
    "name": (r"(?i)^\W*(?:said|wrote|signed|lives|works|born|phone|tel|e-?mail|<)", r"(?i)^\W*(?:street|road|avenue|river|island|university|company|inc|ltd|county|city)"),
}
VOTERS = 4
#: What the form alone proves is little: reliabilities and the share of true candidates before any is seen.
START, PRIOR = (0.6, 0.8, 0.8, 0.8), {k: 0.7 if k in BASE else 0.3 for k in KINDS}
CONTEXT = 24
SHAPE = ("length", "separator", "variety", "edge_before", "edge_behind")
_SPAN = "struct<kind:string,start:int,end:int,v0:int,v1:int,v2:int,v3:int,shape:string>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    doubles = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def added(i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(F.try_element_at(doubles, digit + 1))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), added), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # Parts of any length: leading zeros go before a part is read as a number.
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``. An array of one element binds the value, which a lambda would else work out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int, levels: int = 2, block: int = 64) -> Column:
    """The merged values up to and with each element, in blocks of blocks: no array grows by one element at a time."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(zero), merge)

    def with_blocks(v: Column) -> Column:
        of_block = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda j: fold(F.slice(v, j * block + 1, F.lit(block))))
        up_to = running(of_block, merge, zero, levels - 1, block) if levels > 1 else _bound(of_block, lambda b: F.transform(b, lambda _, j: fold(F.slice(b, F.lit(1), j + 1))))

        def each(p: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                j = F.floor(i / block).cast("int")
                return merge(F.coalesce(F.get(p, j - 1), F.lit(zero)), fold(F.slice(v, j * block + 1, i - j * block + 1)))

            return F.transform(v, one)

        return _bound(up_to, each)

    return F.when(F.size(values) > 0, _bound(values, with_blocks)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, kind: str, pattern: str, gazetteers: Mapping) -> Column:
    """The matches that pass the kind's rule, with votes and shape."""

    def placed(found: Column) -> Column:
        parts = F.split(text, pattern, -1)
        cells = _bound(parts, lambda p: F.transform(found, lambda v, i: F.struct(
            v.alias("value"), (F.length(F.get(p, i)) + F.length(v)).alias("step"),
            F.right(F.get(p, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(p, i + 1), F.lit(CONTEXT)).alias("behind"),
        )))
        ends = lambda c: running(F.transform(c, lambda m: m["step"]), lambda a, x: a + x, 0)
        voted = _bound(cells, lambda c: F.zip_with(c, ends(c), lambda m, end: F.when(_valid(kind, m["value"]), _voted(kind, m, end, gazetteers))))
        return F.filter(voted, lambda m: m.isNotNull())

    none = F.array().cast(f"array<{_SPAN}>")
    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _voted(kind: str, m: Column, end: Column, gazetteers: Mapping) -> Column:
    """The candidate with its votes (1 for, -1 against, 0 none) and its shape."""
    value = m["value"]
    ballot = lambda text, pair: F.when(text.rlike(pair[1]), -1).when(text.rlike(pair[0]), 1).otherwise(0)
    key = F.lower(F.regexp_extract(value, KEYS[kind], 1))
    for_, against = ([str(x) for x in table] for table in gazetteers[kind])
    listed = F.when(key.isin(*against), -1) if against else F.when(F.lit(False), -1)
    return F.struct(
        F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"),
        F.when(value.rlike(FORMS[kind]), 1).otherwise(-1).alias("v0"),
        listed.when(key.isin(*for_), 1).otherwise(0).alias("v1"),
        ballot(m["before"], BEFORE[kind]).alias("v2"), ballot(m["behind"], BEHIND[kind]).alias("v3"),
        _shape(m).alias("shape"),
    )


def _shape(m: Column) -> Column:
    """Features that no labeler sees, as a word of one letter each (SHAPE)."""
    value, n = m["value"], F.length(m["value"])
    digits = _digits(value)
    variety = F.size(F.array_distinct(F.split(digits, "")))
    return F.concat(
        F.when(n <= 11, "s").when(n <= 18, "m").when(n <= 30, "l").otherwise("x"),
        F.when(value.contains("-"), "-").when(value.contains("."), ".").when(value.contains(" "), "_").otherwise("0"),
        F.when(F.length(digits) == 0, "n").when(variety <= 3, "f").otherwise("v"),
        F.when(m["before"].rlike(r"(?:^|\n)$"), "^").when(m["before"].rlike(r"[:=<(\[]\x20?$"), ":").when(m["before"].rlike(r"[A-Za-z0-9]\x20$"), "w").otherwise("o"),
        F.when(m["behind"].rlike(r"^(?:$|\n)"), "$").when(m["behind"].rlike(r"^[.,;:)>\]]"), ".").when(m["behind"].rlike(r"^\x20[A-Za-z0-9]"), "w").otherwise("o"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteers: Mapping = GAZETTEERS) -> DataFrame:
    """doc_id and cands: the candidates of every row with their votes and shapes."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    found = {}
    for kind, pattern in (BASE | LOOSE).items():
        worth = F.col("digit") if kind in DIGITS else F.lit(True)
        if kind in HINTS:
            hints = [F.contains(F.col("text"), F.lit(h)) for h in HINTS[kind]]
            worth = worth & (hints[0] if len(hints) == 1 else hints[0] | hints[1])
        found[kind] = F.when(worth, _matches(F.col("text"), kind, pattern, gazetteers))
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.select("doc_id", F.concat(*[F.coalesce(found[k], none) for k in KINDS]).alias("cands"))


Pattern = tuple[str, tuple[int, ...], str]


@dataclass(frozen=True)
class Model:
    """Weights of the final classifier: (kind,), (kind, voter, vote) and (kind, feature of the shape, letter)."""

    weights: dict[tuple, float]
    reliability: dict[tuple[str, int], float]

    def probability(self, kind: str, votes: tuple[int, ...], shape: str) -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get(f, 0.0) for f in _features(kind, votes, shape))))

    def score(self, m: Column) -> Column:
        """The same as an expression."""

        def of(kind: str) -> Column:
            out = F.lit(self.weights.get((kind,), 0.0))
            for i in range(VOTERS):
                w = [self.weights.get((kind, i, v), 0.0) for v in (-1, 0, 1)]
                out = out + F.element_at(F.array(*[F.lit(x) for x in w]), m[f"v{i}"] + 2)
            for i, name in enumerate(SHAPE):
                letters = sorted((f[2], w) for f, w in self.weights.items() if f[0] == kind and f[1:2] == (name,))
                if letters:
                    at = F.instr(F.lit("".join(x for x, _ in letters)), F.substring(m["shape"], i + 1, 1))
                    out = out + F.element_at(F.array(F.lit(0.0), *[F.lit(w) for _, w in letters]), at + 1)
            return out

        odds = F.lit(0.0)
        for kind in KINDS:
            odds = F.when(m["kind"] == kind, of(kind)).otherwise(odds)
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), 9)


def _features(kind: str, votes: tuple[int, ...], shape: str) -> list[tuple]:
    return [(kind,), *((kind, i, v) for i, v in enumerate(votes)), *((kind, name, letter) for name, letter in zip(SHAPE, shape, strict=True))]


def expectation_maximisation(
    counts: dict[tuple[str, tuple[int, ...]], float], rounds: int = 50, start: Sequence[float] = START, prior: Mapping[str, float] = PRIOR
) -> tuple[dict[tuple[str, tuple[int, ...]], float], dict[tuple[str, int], float]]:
    """Posterior of each (kind, votes), and the mean of the two rates of each (kind, voter) that does vote.

    A voter has a rate for each side: how often it votes for what is true, and
    against what is not. So one that votes alike on all candidates of a kind, as
    a form does that they all have, tells nothing, whoever agrees with it. No
    voter is taken to be worse than chance. Voters keep a prior of ten votes a
    side at their start, and a kind one of ten candidates, so that a voter that
    is always alone, or a kind with a handful of candidates, stays moderate.
    """
    posterior, reliability = {}, {}
    for kind in sorted({k for k, _ in counts}):
        rows = [(v, n) for (k, v), n in sorted(counts.items()) if k == kind]
        hits, refusals, share = list(start[: len(rows[0][0])]), list(start[: len(rows[0][0])]), prior[kind]
        for _ in range(rounds):
            p = []
            for votes, _ in rows:
                odds = math.log(share / (1 - share))
                for v, hit, refusal in zip(votes, hits, refusals, strict=True):
                    odds += math.log(hit / (1 - refusal)) if v > 0 else math.log((1 - hit) / refusal) if v < 0 else 0.0
                p.append(1 / (1 + math.exp(-odds)))
            total = sum(n for _, n in rows)
            share = min(0.95, max(0.05, (10 * prior[kind] + sum(q * n for q, (_, n) in zip(p, rows, strict=True))) / (10 + total)))
            for i in range(len(hits)):
                cast = [(v[i], q * n, (1 - q) * n) for q, (v, n) in zip(p, rows, strict=True) if v[i]]
                right = lambda side, sign: (10 * start[i] + sum(c[side] for c in cast if c[0] == sign)) / (10 + sum(c[side] for c in cast))  # noqa: E731, B023
                hits[i] = min(0.99, max(0.01, right(1, 1)))
                refusals[i] = min(0.99, max(0.01, 1 - hits[i], right(2, -1)))
        posterior |= {(kind, v): q for (v, _), q in zip(rows, p, strict=True)}
        reliability |= {(kind, i): (h + r) / 2 for i, (h, r) in enumerate(zip(hits, refusals, strict=True))}
    return posterior, reliability


def fit(patterns: list[tuple[str, tuple[int, ...], str, int]], rounds: int = 400, rate: float = 0.5, ridge: float = 0.01) -> Model:
    """The final classifier from (kind, votes, shape, count) of all documents: a logistic regression for each kind."""
    counts: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, votes, _, n in patterns:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    posterior, reliability = expectation_maximisation(counts)
    weights: dict[tuple, float] = {}
    for kind in sorted({p[0] for p in patterns}):
        mine = [p for p in patterns if p[0] == kind]
        on = [_features(k, votes, shape) for k, votes, shape, _ in mine]
        place = {f: i for i, f in enumerate(sorted({f for fs in on for f in fs}, key=repr))}
        x = np.zeros((len(mine), len(place)))
        for row, fs in zip(x, on, strict=True):
            row[[place[f] for f in fs]] = 1
        target = np.array([posterior[k, votes] for k, votes, _, _ in mine])
        share = np.array([n for *_, n in mine], float)
        share /= share.sum()
        w = np.zeros(len(place))
        for _ in range(rounds):
            error = target - 1 / (1 + np.exp(-(x @ w)))
            w += rate * (x.T @ (error * share) - ridge * w)
        weights |= {f: float(w[i]) for f, i in place.items()}
    return Model(weights, reliability)


def learn(found: DataFrame) -> Model:
    """EM and the classifier over all candidates; only the table of vote and shape patterns reaches the driver."""
    by = ["c.kind", *[f"c.v{i}" for i in range(VOTERS)], "c.shape"]
    each = found.select(F.explode("cands").alias("c")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = each.orderBy("kind", *[f"v{i}" for i in range(VOTERS)], "shape").collect()
    return fit([(r["kind"], tuple(r[f"v{i}"] for i in range(VOTERS)), r["shape"], r["n"]) for r in rows])


def _apart(loose: Column, base: Column) -> Column:
    """The loose spans that meet no base span: of all spans by start, what reaches furthest before, and what starts next."""

    def of(spans: Column) -> Column:
        most = lambda a, x: F.greatest(a, x)
        reach = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(-1)), most, -1)
        late = -(2**31) + 1
        back = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], -s["start"]).otherwise(F.lit(late)))), most, late))
        free = F.zip_with(spans, F.arrays_zip(reach.alias("reach"), back.alias("back")), lambda s, r: F.when(~s["base"] & (r["reach"] <= s["start"]) & (-r["back"] >= s["end"]), s["span"]))
        return F.filter(free, lambda s: s.isNotNull())

    marked = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(not is_base).alias("later"), s["end"].alias("end"), F.lit(is_base).alias("base"), s.alias("span")))
    both = F.array_sort(F.concat(marked(base, True), marked(loose, False)))
    return F.when((F.size(loose) > 0) & (F.size(base) > 0), _bound(both, of)).otherwise(loose)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, gazetteers: Mapping = GAZETTEERS) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every row, by start and then in the order of KINDS."""
    all_found = candidates(docs, id_col, text_col, gazetteers)
    base = F.filter("cands", lambda m: m["kind"].isin(*BASE))
    loose = F.filter("cands", lambda m: ~m["kind"].isin(*BASE))
    found = materialize(all_found.select("doc_id", F.concat(base, _apart(loose, base)).alias("cands")), "pii-candidates")
    model = learn(found)
    names = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        "cands",
        lambda m: F.struct(m["start"].alias("start"), F.array_position(names, m["kind"]).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"), model.score(m).alias("score")),
    )
    scored = found.select("doc_id", ranked.alias("spans"))
    stays = F.filter("spans", lambda s: s["kind"].isin(*BASE) | (s["score"] >= threshold))
    ordered = scored.select("doc_id", F.array_sort(stays).alias("spans"))
    return ordered.select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))
