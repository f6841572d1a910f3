"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes one space, and its runs of
one to three characters are hashed into 2**16 features. The value of a feature
is its share of all n-grams times its inverse document frequency, counted over
all training documents. The weights are learned by follow-the-regularised-leader
with an elastic-net penalty, which leaves most of them zero, on a sample of at
most ``sample_docs`` training documents chosen by hash (whole texts); a fifth of
the sample sets the temperature that calibrates the probabilities.

Training takes rows with a text, a language and an id whose CRC-32 (as text) is
not divisible by 5. Predictions use nothing but the text.

A text is familiar if the model knows as large a share of its n-grams (that is,
has a weight for them) as it knows of the calibration documents of the language
it is taken for, less ``SLACK``. A softmax over the learned languages says
nothing of texts in none of them; this does, and it is derived from labelled rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
not familiar; so is every text if there is no row to train on; of equal
probabilities the first language in alphabetical order wins; a null id counts as
held out; repeated rows share their result; an empty table gives an empty result;
texts of any length are worked through in pieces; other columns pass through
``identified``, but one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, text_slices, trim
from tempora.llm._windows import mix

BITS = 16
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
#: Brings relative frequencies to a range in which the learning rate works.
GAIN = 30.0
#: The largest table of weights (SIZE x languages, 4 bytes each) that is broadcast: 1,024 languages.
MOST_BYTES = 1 << 28
#: How far below the least known calibration document of its language a familiar text may lie.
SLACK = 0.1
#: Code points whose n-grams are held at once.
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, with one 0 for every run of others than letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kept = np.where(_letters[0][points], points, 0)
    return kept[(kept > 0) | np.r_[True, kept[:-1] > 0]] if len(kept) else kept


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, in pieces of bounded size; nothing if it has no letter."""
    points = _points(text)
    if not points.any():
        return
    padded = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    for n in ORDERS:
        last = len(padded) - n + 1
        for start in range(0, last, PIECE):
            end = min(last, start + PIECE)
            code = np.full(end - start, n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(21)) ^ padded[start + k : end + k].astype(np.uint64)
            yield (mix(code) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, repeats included; empty if it has no letter."""
    return np.concatenate([np.empty(0, np.int64), *_pieces(text)])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different features of a text and their counts."""
    if len(text or "") < PIECE:
        return np.unique(features(text), return_counts=True)
    total = np.zeros(SIZE, np.int64)
    for at in _pieces(text):
        total += np.bincount(at, minlength=SIZE)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # SIZE x languages, idf and gain included
    bias: np.ndarray
    temperature: float
    least_known: np.ndarray | None = None  # for each language

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its probability."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The language of a text, its probability, and whether the text is familiar."""
        if not self.languages:
            return "und", 0.0, False
        total, known, n = np.zeros(len(self.languages)), 0, 0
        for piece in _pieces(text):
            for start in range(0, len(piece), SIZE):
                taken = self.weights[piece[start : start + SIZE]]
                total += taken.sum(axis=0, dtype=np.float64)
                known += int(taken.any(axis=1).sum())
                n += len(taken)
        if not n:
            return "und", 0.0, False
        p = _softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        floor = 0.0 if self.least_known is None else self.least_known[best]
        return self.languages[best], float(p[best]), bool(known >= floor * n)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 6, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE x classes) and bias; examples are (features, values, class). The bias has no penalty."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    penalty = np.full((SIZE + 1, 1), l1)
    penalty[SIZE] = 0

    def solved(at):
        big = np.abs(z[at]) > penalty[at]
        return np.where(big, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0)

    for _ in range(epochs):
        for index, value, label in examples:
            at, x = np.r_[index, SIZE], np.r_[value, 1.0]
            w = solved(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solved(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between 1/20 and 20.

    Targets are smoothed by one in n + 2 documents, so that a sample without an
    error doesn't make every later prediction certain.
    """
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(-3, 3, 121))
    shifted = logits - logits.max(axis=1, keepdims=True)
    spread = 1 / (len(labels) + 2)
    target = np.full(logits.shape, spread / max(1, logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - spread
    loss = [np.mean(np.log(np.exp(shifted / t).sum(axis=1)) - (target * shifted).sum(axis=1) / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _document_frequency(texts: DataFrame) -> DataFrame:
    def run(batches):
        total, docs = np.zeros(SIZE, np.int64), 0
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            for part in text_slices(batch):
                for text in part.column("text").to_pylist():
                    for piece in _pieces(text):
                        seen[piece] = True
                    if seen.any():
                        total += seen
                        seen[:] = False
                        docs += 1
        at = np.flatnonzero(total)
        if docs:
            yield pa.record_batch([pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[total[at], docs], pa.int64())], names=["feature", "docs"])

    return texts.select("text").mapInArrow(run, "feature int, docs long")


def _sparse(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                index, share = [], []
                for text in part.column("text").to_pylist():
                    found, n = counted(text)
                    index.append(found.astype(np.int32).tolist())
                    share.append((n / max(1, n.sum())).astype(np.float32).tolist())
                yield pa.record_batch([part.column("place"), part.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["place", "lang", "feature", "share"])

    return texts.select("place", "lang", "text").mapInArrow(run, "place long, lang string, feature array<int>, share array<float>")


def _examples(sample: pa.Table) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(place, lang, features, shares) of the documents that have a feature, in an order of their own."""
    out = []
    for batch in sample.to_batches():
        feature, share = batch.column("feature"), batch.column("share")
        f, s, ends = feature.flatten().to_numpy(), share.flatten().to_numpy(), np.cumsum(np.diff(feature.offsets.to_numpy()))
        for place, lang, a, b in zip(batch.column("place").to_pylist(), batch.column("lang").to_pylist(), np.r_[0, ends[:-1]], ends, strict=True):
            if b > a:
                out.append((place, lang, f[a:b].copy(), s[a:b].copy()))
    return sorted(out, key=lambda r: (r[0], r[1], len(r[2])))


class _Weighted:
    """The examples of (place, lang, features, shares) rows as (features, values, class), made anew each time they are gone through."""

    def __init__(self, rows: list, languages: list[str], idf: np.ndarray):
        self.rows, self.languages, self.idf = rows, {lang: i for i, lang in enumerate(languages)}, idf

    def __iter__(self):
        for _, lang, f, s in self.rows:
            yield f, s * self.idf[f] * GAIN, self.languages[lang]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 4000, **options) -> Model:
    """Learn from the rows that are not held out. At most ``sample_docs`` of them reach the driver, as n-gram counts."""
    usable = docs.filter(~held_out(id_col) & col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col), col(text_col)).alias("place"))
    sums = _document_frequency(usable).groupBy("feature").agg(F.sum("docs").alias("docs"))
    counts = dict(sums.collect())  # at most one row for each feature
    total = counts.pop(-1, 0)
    if not total:
        return Model([], np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    idf = np.zeros(SIZE)
    idf[list(counts)] = np.log((1 + total) / (1 + np.array(list(counts.values())))) + 1
    # About nine tenths of sample_docs by hash, so that the limit, which is there for equal rows, cuts nothing else.
    drawn = usable if total <= sample_docs else usable.filter(F.col("place") < F.lit(int(-(2**63) + 0.9 * sample_docs / total * 2**64)))
    rows = _examples(_sparse(drawn).limit(sample_docs).toArrow())
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([], np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    rest = rows[::5]
    labels = np.array([languages.index(lang) for _, lang, *_ in rest], np.int64)
    w, bias = ftrl(_Weighted([r for i, r in enumerate(rows) if i % 5] or rows, languages, idf), len(languages), **options)
    logits = np.array([x @ w[f] + bias for f, x, _ in _Weighted(rest, languages, idf)]).reshape(len(rest), len(languages))
    heat = temperature(logits, labels)
    weights = (w * idf[:, None] * GAIN).astype(np.float32)
    least = np.ones(len(languages))
    for (*_, f, share), label in zip(rest, labels, strict=True):
        least[label] = min(least[label], share[weights[f].any(axis=1)].sum())
    del rest, rows
    trim()
    told = np.isin(np.arange(len(languages)), labels)
    return Model(languages, weights, bias, heat, np.where(told, np.maximum(least - SLACK, 0), 0))


def identified(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", familiar_col: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its calibrated probability and, if a name is given, whether the text is familiar."""
    if model.weights.nbytes > MOST_BYTES:
        raise ValueError(f"a model of {len(model.languages)} languages is too large to be sent to every worker")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, familiar boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        told = pd.DataFrame([sent.value.judge(t) for t in texts], columns=["lang", "score", "familiar"])
        trim()
        return told

    results = {pred_col: "lang", score_col: "score"} | ({familiar_col: "familiar"} if familiar_col else {})
    kept = [c for c in docs.columns if c.lower() not in {r.lower() for r in results}]
    marked = docs.select(F.struct(F.lit(0).alias("0"), *[col(c) for c in kept]).alias("row"), predict(col(text_col)).alias("found"))
    return marked.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col("found").getField(f).alias(name) for name, f in results.items()])
