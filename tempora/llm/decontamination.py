"""Benchmark decontamination by template canonicalisation.

Words lose their case and ASCII punctuation; numbers, names and units become
typed placeholders, so a question with other numbers or names has the same
template. Windows of template words are hash-joined with the benchmark's
windows and compared as strings. On each alignment of a document with an item
(the distance of their positions) the slots must be consistent: one value of
the item stands for one value of the document. An item leaks into a document if
consistent alignments cover ``least_cover`` of the item's windows or more, or
``least_run`` of them: a long passage of a longer item is a leak too.

What a window proves: one with ``least_words`` literal words or more is evidence
with any slot values. One with fewer (mostly numbers, names and units) is
evidence only where its slot values are equal too and it has ``least_verbatim``
words; else it proves nothing, and an item without any window that can is never
found (the item "42" leaks into nothing). The cover is that of all windows, or
of those with enough literal words, whichever is greater.

A number is a word that starts with a digit after its punctuation; a name is a
listed given name, or a word with one capital in the middle of a sentence, but not behind a bare number, which may
count questions. A unit is what is counted: a listed word right after a number,
or any word in small letters that follows one with nothing but space between,
unless it is a function word ("3 of them"). These rules look at a word and its neighbours only,
so a copy has the same slots in whatever text it stands.

The benchmark's hashes are sent to the tasks, which then emit only windows that
can match, if their number is at most ``prefilter_hashes``; beyond that the
hashes of all windows are joined first, and each document's hits go back to its
text. The result is the same.

A window that many items share is not joined with all of them: an item that
needs k of its n windows is a candidate only where one of its n - k + 1 least
shared windows is met. Items of equal text are one until the end.

Defined cases: a null or empty text, and an item without a word, match nothing;
an item shorter than a window is one window; rows that repeat an id give one row
for each item; rows with a null id do too; items that repeat an id count as one
item for the result; very long texts are whole; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, row_key, text_slices
from tempora.llm._windows import window_hashes, word_hashes

# Words that stand for a unit, words that never do, and given names.
UNITS = "km m cm mm kg g mg lb lbs oz miles mile meters meter metres metre feet foot inches inch liters liter litres litre ml hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent pounds pound percent degrees".split()
FUNCTION = "a after an and are as at be before but by did do does each else for from had has have he her his i if in into is it its less minus more not of on or over per plus she so than that the their then they times to under was we were when with you".split()
NAMES = "alice bob carol dave emma jack jane john james mary maria michael sarah tom tim anna david daniel peter paul susan linda robert william george henry lucy kate laura mark sam ben amy lisa julia sophie olivia noah liam mia".split()

_NUMBER = re.compile(rb"(?<![0-9])[0-9]+(?:[.,:/][0-9]+)*")
_NAME = re.compile(rb"(?<=[a-z,;:\x80-\xff][\x20\n])[A-Z][a-z]+(?![A-Za-z])")
_COUNTED = re.compile(rb"(?<![0-9A-Za-z.,:/\x80-\xff])[0-9]+(?:[.,:/][0-9]+)*[\x20\x09-\x0D]+(?=[a-z])(?!(?:" + "|".join(FUNCTION).encode() + rb")(?![a-z]))")
_PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_LIST_HASHES: dict[str, np.ndarray] = {}


def _listed(kind: str, words: list[str]) -> np.ndarray:
    if kind not in _LIST_HASHES:
        _LIST_HASHES[kind] = np.sort(word_hashes(" ".join(words).encode()))
    return _LIST_HASHES[kind]


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Template:
    """The template words of a text; ``hashes`` has one for each."""

    def __init__(self, text: bytes):
        plain = _COUNTED.sub(b"\\g<0>\x03", text.translate(None, b"\x01\x02\x03"))
        marked = _NAME.sub(b"\x02\\g<0>", _NUMBER.sub(b"\x01\\g<0>", plain))
        self.words = marked.translate(None, _PUNCTUATION).lower().split()
        if not self.words:
            self.hashes = np.empty(0, np.uint64)
            self.kinds = np.empty(0, np.int8)
            return
        joined = b" ".join(self.words)
        hashes = word_hashes(joined)
        data = np.frombuffer(joined, np.uint8)
        first = data[np.r_[0, np.flatnonzero(data == 32) + 1]]
        number = first == 1
        name = (first == 2) | _in(hashes, _listed("names", NAMES))
        unit = (first == 3) | np.r_[False, number[:-1]] & _in(hashes, _listed("units", UNITS))
        self.kinds = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        self.hashes = np.select([self.kinds == k for k in (1, 2, 3)], [np.uint64(k) for k in (1, 2, 3)], hashes)

    def window(self, at: int, size: int) -> tuple[str, list[str]]:
        """The template of a window, and the values of its slots."""
        words = [w.decode("utf-8", "replace").lstrip("\x01\x02\x03") for w in self.words[at : at + size]]
        kinds = self.kinds[at : at + size].tolist()
        return " ".join((w, NUM, UNIT, NAME)[k] for w, k in zip(words, kinds, strict=True)), [w for w, k in zip(words, kinds, strict=True) if k]


_COLUMNS = "h long, pos int, size int, literals int, template string, slots array<string>"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
_NAMES = ["h", "pos", "size", "literals", "template", "slots"]


def _windows(rows: DataFrame, sizes: list[int] | None, window: int, only: np.ndarray | None) -> DataFrame:
    """Windows of the texts of (key, text). sizes None: each text has windows of ``window`` words, or of all it has.

    Only those with a hash in ``only``, or in a column hits, if there is one.
    """
    listed = "hits" in rows.columns

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                keys, out = part.column("key").to_pylist(), []
                hits = part.column("hits").to_pylist() if listed else [None] * len(keys)
                for key, raw, hit in zip(keys, part.column("text").cast(pa.binary()).to_pylist(), hits, strict=True):
                    made = Template(raw or b"")
                    n = len(made.hashes)
                    wanted = np.sort(np.array(hit, np.int64).view(np.uint64)) if listed else only
                    for size in sizes or ([min(window, n)] if n else []):
                        hashes = window_hashes(made.hashes, size)
                        at = np.arange(len(hashes)) if wanted is None else np.flatnonzero(_in(hashes, wanted))
                        for pos in at.tolist():
                            template, slots = made.window(pos, size)
                            out.append((key, hashes[pos : pos + 1].view(np.int64)[0].item(), pos, size, size - len(slots), template, slots))
                for at in range(0, len(out), 5000):
                    columns = list(zip(*out[at : at + 5000], strict=True))
                    arrays = [pa.array(c, k) for c, k in zip(columns[1:], _KINDS, strict=True)]
                    yield pa.record_batch([pa.array(columns[0], part.schema.field("key").type), *arrays], names=["key", *_NAMES])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {_COLUMNS}")


def _hits(rows: DataFrame, sizes: list[int], hashes: DataFrame) -> DataFrame:
    """``rows`` that hold a window of one of ``hashes``, with these hashes as a column hits. Only hashes travel."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                made = [Template(raw or b"").hashes for raw in part.column("text").cast(pa.binary()).to_pylist()]
                found = [np.unique(np.concatenate([window_hashes(words, size) for size in sizes])) for words in made]
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                h = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
                yield pa.record_batch([part.column("key").take(pa.array(owner)), pa.array(h)], names=["key", "h"])

    marked = rows.withColumn("place", F.struct("key", F.xxhash64("text").alias("text")))
    placed = marked.select(F.col("place").alias("key"), "text")
    met = placed.mapInArrow(run, f"key {placed.schema['key'].dataType.simpleString()}, h long").join(hashes, "h", "left_semi")
    gathered = met.groupBy(F.col("key").alias("place")).agg(F.collect_set("h").alias("hits"))
    return marked.join(gathered, "place").select("key", "text", "hits")


_OPTIONS = {"window": 8, "least_cover": 0.5, "least_run": 20, "least_words": 3, "least_verbatim": 5, "prefilter_hashes": 1_000_000}


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, kind) for every item that leaks into a document."""
    rows = docs.select(F.struct(col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk")).alias("key"), col(text_col).alias("text"))
    items = benchmark.select(col(item_col).alias("item_id"), F.md5(col(item_text)).alias("item"), col(item_text).alias("text"))
    found = _leaks(rows, items.select(F.col("item").alias("key"), "text"), **(_OPTIONS | options))
    named = found.join(items.select("item_id", "item").distinct(), "item")
    most = named.groupBy(F.col("key.doc_id").alias("doc_id"), "item_id").agg(F.max(F.struct("coverage", "n_matched", "n_windows", "kind")).alias("m"))
    return most.select("doc_id", "item_id", "m.n_windows", "m.n_matched", "m.coverage", "m.kind")


def _leaks(rows: DataFrame, items: DataFrame, window: int, least_cover: float, least_run: int, least_words: int, least_verbatim: int, prefilter_hashes: int) -> DataFrame:
    """(key, item, n_windows, n_matched, coverage, kind); items are (key, text), one for each different text."""
    strong = F.col("literals") >= least_words
    given = _windows(items.filter(F.col("text").isNotNull()).dropDuplicates(["key"]), None, window, None)
    theirs = materialize(given.filter(strong | (F.col("size") >= least_verbatim)), "template-items")
    held = theirs.groupBy(F.col("key").alias("item")).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(strong).alias("n_strong"))
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect()) or [window]  # at most ``window`` numbers
    hashes = theirs.select("h").distinct()
    if hashes.count() <= prefilter_hashes:
        only = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64))
        found = _windows(rows, sizes, window, only)
    else:
        found = _windows(_hits(rows, sizes, hashes), sizes, window, None)
    ours = materialize(found.select("key", "h", "template", "pos", "slots"), "template-windows")

    # Candidates: documents with one of an item's least shared windows, of as many as it can't do without.
    shared = theirs.groupBy("h", "template").agg(F.count(F.lit(1)).alias("holders"))
    needed = F.least(
        F.ceil(F.col("n_windows") * F.lit(least_cover)),
        F.when(F.col("n_strong") > 0, F.ceil(F.col("n_strong") * F.lit(least_cover))).otherwise(F.col("n_windows")),
        F.lit(least_run),
    )
    rank = F.row_number().over(Window.partitionBy("item").orderBy("holders", "h", "pos"))  # a window over one item's text
    listed = theirs.select(F.col("key").alias("item"), "h", "template", "pos").join(shared, ["h", "template"]).join(held, "item")
    rare = listed.withColumn("rank", rank).filter(F.col("rank") <= F.col("n_windows") - F.greatest(needed, F.lit(1)) + 1).select("item", "h", "template").distinct()
    candidates = ours.select("key", "h", "template").distinct().join(rare, ["h", "template"]).select("key", "item").distinct()

    of_item = theirs.select(F.col("key").alias("item"), "h", "template", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), strong.alias("strong"))
    met = candidates.join(of_item, "item").join(ours, ["key", "h", "template"]).filter(F.col("strong") | (F.col("slots") == F.col("item_slots")))
    values = F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("s")
    # One row for each alignment and value pair, so that no group grows with repetitions.
    pairs = met.select("key", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "strong", values).select(
        "key", "item", "shift", F.struct("item_pos", "strong").alias("at"), F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")
    )
    aligned = pairs.distinct().groupBy("key", "item", "shift").agg(
        F.collect_set("at").alias("at"),
        F.size(F.collect_set("a")).alias("values"),
        F.size(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("value_pairs"),
        F.min(F.coalesce(F.col("a") == F.col("b"), F.lit(True))).alias("same"),
    )
    consistent = aligned.filter(F.col("values") == F.col("value_pairs")).select("key", "item", "same", F.explode("at").alias("at"))
    matched = consistent.groupBy("key", "item").agg(F.countDistinct("at").alias("n_matched"), F.countDistinct(F.when(F.col("at.strong"), F.col("at"))).alias("strong_matched"), F.max("same").alias("same"))
    of_strong = F.coalesce(F.try_divide("strong_matched", "n_strong"), F.lit(0.0))
    cover = matched.join(held, "item").withColumn("coverage", F.greatest(F.col("n_matched") / F.col("n_windows"), of_strong))
    return cover.filter((F.col("coverage") >= least_cover) | (F.col("n_matched") >= least_run)).withColumn("kind", F.when(F.col("same"), "verbatim").otherwise("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), col(text_col).alias("text"))
    items = benchmark.select(F.md5(col(item_text)).alias("key"), col(item_text).alias("text"))
    bad = materialize(_leaks(rows, items, **(_OPTIONS | options)).select("key").distinct(), "template-leaks")
    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    return marked.join(bad, "key", "left_anti").select("row.*")
