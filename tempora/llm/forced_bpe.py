"""BPE encoding and decoding with forced boundaries.

A vocabulary tells which two bytes ever stand side by side inside a token. Where
a text has two neighbours that never do, no token can lie across them: a certain
cut. Merges on its two sides can't touch each other, so the fragments between
cuts are encoded independently and their ids concatenated, which is exact. The
tokenizer's own pattern cuts a text into words first, as its merges must not
cross them either; forced boundaries then cut the words a worker has not met yet,
all at once: one look-up for each pair of neighbouring bytes.

A fragment is encoded by its merges in the order of their ranks, the leftmost
first, from a heap over linked positions: a long run without a forced boundary
(a letter a million times) takes time in n log n.

The file is that of a byte-level BPE of the tokenizers library. Its added tokens
(such as an end-of-text mark) are found in a text first, the longest at a place,
and have their own ids; what stands between them is encoded by itself. Files
whose settings would need something else (a normaliser, dropout, added tokens
that swallow white space) are refused.

Defined cases: a null text encodes as an empty one: no ids, the digests of
nothing; repeated rows share their result; ids outside the vocabulary can't be
decoded and raise; bytes that are not UTF-8 decode to replacement characters, as
the library does; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.llm._common import col, held, text_slices

#: Words, and fragments, whose ids a worker remembers.
CACHE_WORDS = 300_000
#: Bytes of text, or of ids, that a worker turns at once.
SLICE = 1 << 18
#: Bytes from which a word, or a fragment, is not remembered.
LONG = 256
#: Fixed value: how a byte-level file cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if it can be seen, else the next letter from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, file: bytes, cache_words: int = CACHE_WORDS):
        import regex

        given = json.loads(file)
        model, before = given["model"], given.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in given["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd or given.get("normalizer") or given.get("post_processor") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"this is not a plain byte-level BPE: {odd or before}")
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        ids = {raw[t]: i for t, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # (left id, right id) to rank and id in one number; a pair that is listed twice has its last rank.
        self.merges = {(model["vocab"][a], model["vocab"][b]): rank << 32 | model["vocab"][a + b] for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes_of = {i: raw[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        #: By left byte << 8 | right byte: no token holds the two side by side.
        self.never = np.ones(1 << 16, bool)
        self.never[[t[k] << 8 | t[k + 1] for t in ids for k in range(len(t) - 1)]] = False
        self.cut = regex.compile(PATTERN).findall
        marks = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def boundaries(self, raw: bytes) -> np.ndarray:
        """The places inside ``raw`` that no token can lie across."""
        data = np.frombuffer(raw, np.uint8).astype(np.uint16)
        return np.flatnonzero(self.never[data[:-1] << 8 | data[1:]]) + 1 if len(data) > 1 else np.empty(0, np.int64)

    def fragment(self, raw: bytes) -> bytes:
        """The ids of one fragment, as the bytes of 32-bit integers."""
        known = self.parts.get(raw)
        if known is not None:
            return known
        out = np.array(self._merged([self.byte_ids[b] for b in raw]), "<u4").tobytes()
        if len(raw) <= LONG:
            if len(self.parts) >= self.cache_words:
                self.parts.clear()
            self.parts[raw] = out
        return out

    def _merged(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        following, previous = [*range(1, n + 1)], [*range(-1, n - 1)]
        # Rank, then place; what a place holds may have changed since, so the pair is looked up again.
        heap = [(m >> 32) << 32 | k for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            k = top & 0xFFFFFFFF
            right = following[k] if ids[k] >= 0 else n
            if right >= n:
                continue
            m = merges.get((ids[k], ids[right]))
            if m is None or m >> 32 != top >> 32:
                continue
            ids[k], ids[right] = m & 0xFFFFFFFF, -1
            after = following[k] = following[right]
            if after < n:
                previous[after] = k
                if (m := merges.get((ids[k], ids[after]))) is not None:
                    heapq.heappush(heap, (m >> 32) << 32 | k)
            if (left := previous[k]) >= 0 and (m := merges.get((ids[left], ids[k]))) is not None:
                heapq.heappush(heap, (m >> 32) << 32 | left)
        return [i for i in ids if i >= 0]

    def _new_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: all words are cut at once, and the fragments' ids joined."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(b) for b in raw])
        text = b"".join(raw)
        cuts = np.union1d(self.boundaries(text), ends).tolist()
        ids = [self.fragment(text[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        last = (np.searchsorted(cuts, ends) + 1).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *last[:-1]], last, strict=True)]

    def _segments(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens, in order."""
        if self.marks is None or not any(m in text for m in self.added):
            return self.cut(text)
        return list(chain.from_iterable([self.added[s]] if k % 2 else self.cut(s) for k, s in enumerate(self.marks.split(text))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self._segments(t) for t in texts]
        met = set(chain.from_iterable(cut))
        known = self.words
        new = [w for w in met if isinstance(w, str) and w not in known]
        if len(known) + len(new) > self.cache_words:
            known.clear()
            new = [w for w in met if isinstance(w, str)]
        long = [w for w in new if len(w) > LONG]
        short = [w for w in new if len(w) <= LONG]
        known.update(zip(short, self._new_words(short), strict=True) if short else ())
        here = known
        extra = dict(zip(long, self._new_words(long), strict=True)) if long else {}
        extra |= {i: np.array([i], "<u4").tobytes() for i in met if not isinstance(i, str)}
        if extra:  # these are not remembered
            return [np.frombuffer(b"".join(extra[w] if w in extra else here[w] for w in ws), "<u4") for ws in cut]
        return [np.frombuffer(b"".join(map(here.__getitem__, ws)), "<u4") for ws in cut]

    def decode(self, ids) -> str:
        """The text of a list of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(file: bytes, cache_words: int = CACHE_WORDS) -> Codec:
    """The worker's codec of this file, made once."""
    found = held(hashlib.sha256(file).digest(), lambda: Codec(file))
    found.cache_words = cache_words
    return found


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *[x.astype(np.int32) for x in ids]]), pa.int32()))


def _plain(docs: DataFrame, id_col: str, value_col: str, name: str) -> tuple[DataFrame, str]:
    rows = docs.select(col(id_col).alias("doc_id"), col(value_col).alias(name))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, file: bytes, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE, holds=True):
                ids = codec(file, cache_words).encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    rows, kind = _plain(docs, id_col, text_col, "text")
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, file: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids decode to an empty text."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "ids", SLICE, holds=True):
                texts = [codec(file).decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows, kind = _plain(encoded, id_col, ids_col, "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, file: bytes, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; only the ids go from the encoder to the decoder."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE, holds=True):
                both = codec(file, cache_words)
                ids = both.encode([t or "" for t in part.column("text").to_pylist()])
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(both.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string()),
                }
                yield pa.record_batch(list(columns.values()), names=list(columns))

    rows, kind = _plain(docs, id_col, text_col, "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
