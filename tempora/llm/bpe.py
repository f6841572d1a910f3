"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

A text is cut by the tokenizer's pattern. The words a worker has not met yet go
into a table of (word, position, token) rows, one row per byte; a recursive
query joins linked neighbouring rows with the merge table (every way to put a token together), contracts every word's
leftmost pair of least rank, and goes on until no word has a pair left. One
query makes a bounded number of rounds and hands its last state to the next, so
memory is bounded. Decoding is an ordered aggregation of the tokens' bytes.

A word that the pattern leaves very long (a run of letters without a break)
would need time in the square of its length. It is cut into overlapping pieces,
which are encoded like words and joined at a token that both neighbours have at
the same place. This is exact: a sequence of tokens is the encoding of its bytes
if and only if every two neighbours are the encoding of theirs (the first merge
across a boundary would also happen among the two alone), and in the joined
sequence every two neighbours stand in one piece's encoding. Pieces without such
a token are made longer, up to the whole word.

DuckDB has no text type for bytes that are not UTF-8, so byte b is written as
the character 256 + b inside the queries.

Defined cases: a null text encodes as an empty one: no ids, the digests of
nothing; repeated rows share their result; special tokens are ordinary text; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.llm._common import col, held, text_slices

#: Rows a recursive query may make before it hands over its state.
ROUND_ROWS = 2_000_000
#: Words whose ids a worker remembers, unless told otherwise: about 200 bytes each, against the time to encode a word again.
CACHE_WORDS = 300_000
#: Bytes of text, or of ids, that a worker turns at once. One recursive query takes the new words of a slice: below 8,000 words
#: a query costs more than its words (2,000 words: 26 microseconds a word, 8,000: 18), and a slice of 256 KB has about 2,000.
SLICE = 1 << 20
#: Bytes from which a word is cut into pieces, and the least step between their starts.
LONG, STEP = 512, 96


def _spell(raw: bytes) -> str:
    return "".join(chr(256 + b) for b in raw)


class Codec:
    """Encoder and decoder over one in-memory DuckDB; every worker makes its own."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "256MB"})
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        halves = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table("merges", {"pair": pa.array([p for p, _ in halves], pa.int64()), "id": pa.array([i for _, i in halves], pa.int32())})
        self._table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "spelt": [_spell(t) for t in ranks]})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cut = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.cache_words = CACHE_WORDS
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_long(self, raw: bytes) -> bytes:
        """The ids of one word of any length, as the bytes of 32-bit integers."""
        step = STEP
        while len(raw) > 4 * step:
            starts = list(range(0, len(raw), step))
            ids: list[np.ndarray] = []
            for at in range(0, len(starts), 512):
                pieces = [raw[a : a + step + step // 2] for a in starts[at : at + 512]]
                ids += [np.frombuffer(x, np.int32) for x in self.encode_words(pieces)]
            ends = [a + np.cumsum(self.lengths[x]) for a, x in zip(starts, ids, strict=True)]
            joined, first = [], 0
            for k in range(len(ids) - 1):
                # Tokens by their end and length: those that both pieces have lie in their overlap.
                mine, other = ends[k] << 20 | self.lengths[ids[k]], ends[k + 1] << 20 | self.lengths[ids[k + 1]]
                _, here, there = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
                if not len(here):
                    break
                joined.append(ids[k][first : here[0] + 1])
                first = there[0] + 1
            else:
                return np.concatenate([*joined, ids[-1][first:]]).tobytes()
            step *= 2
        return self.encode_words([raw])[0]

    def encode_words(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of 32-bit integers."""
        sizes = np.array([len(b) for b in raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        word, tok = np.repeat(np.arange(len(raw), dtype=np.int32), sizes), self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        pos = (np.arange(n) - np.repeat(starts, sizes)).astype(np.int32)
        end = np.r_[word[1:] != word[:-1], np.ones(min(n, 1), bool)]
        rows = pa.table({"w": word, "pos": pos, "tok": tok, "next_pos": pa.array(pos + 1, mask=end), "next_tok": pa.array(np.r_[tok[1:], tok[:1]], mask=end)})
        out = [b""] * len(raw)
        while rows.num_rows:
            rounds = max(1, ROUND_ROWS // rows.num_rows)
            self.db.register("start", rows)
            last = self.db.sql(
                f"""
                WITH RECURSIVE state AS (
                    SELECT 0 AS step, w, pos, tok, next_pos, next_tok FROM start
                    UNION ALL
                    SELECT s.step + 1, s.w, s.pos, CASE WHEN s.pos = best.pos THEN best.id ELSE s.tok END,
                        CASE WHEN s.pos = best.pos THEN best.after_pos ELSE s.next_pos END,
                        CASE WHEN s.pos = best.pos THEN best.after_tok WHEN s.next_pos = best.pos THEN best.id ELSE s.next_tok END
                    FROM state s JOIN (
                        SELECT least.*, g.next_pos AS after_pos, g.next_tok AS after_tok
                        FROM (
                            SELECT w, min(m.id) AS id, arg_min(pos, m.id::BIGINT << 32 | pos) AS pos, arg_min(next_pos, m.id::BIGINT << 32 | pos) AS gone
                            FROM state JOIN merges m ON m.pair = (tok::BIGINT << 32 | next_tok) WHERE step < {rounds} GROUP BY w
                        ) least JOIN state g ON g.w = least.w AND g.pos = least.gone
                    ) best USING (w)
                    WHERE s.pos <> best.gone
                ),
                ended AS (SELECT w, max(step) AS step FROM state GROUP BY w)
                SELECT w, pos, tok, next_pos, next_tok, step = {rounds} AS going FROM state JOIN ended USING (w, step) ORDER BY w, pos
                """
            ).to_arrow_table()
            self.db.unregister("start")
            going = last.column("going").to_numpy(zero_copy_only=False)
            done = last.filter(pa.array(~going))
            w, ids = done.column("w").to_numpy(), done.column("tok").to_numpy()
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.array([], np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(w)], strict=False):
                out[w[a]] = ids[a:b].tobytes()
            rows = last.filter(pa.array(going)).select(["w", "pos", "tok", "next_pos", "next_tok"])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        known = self.words
        met = set(chain.from_iterable(cut))
        long = {w: self.encode_long(w.encode()) for w in met if len(w) > LONG // 4 and len(w.encode()) > LONG}
        met.difference_update(long)
        new = list(met.difference(known))
        if len(known) + len(new) > self.cache_words:
            # What this slice has stays, the common words among them; the rest goes.
            self.words = known = {w: known[w] for w in met.intersection(known)}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self.encode_words([w.encode() for w in part]), strict=True))
        if long:  # these are not remembered
            return [np.frombuffer(b"".join(long[w] if w in long else known[w] for w in ws), np.int32) for ws in cut]
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in cut]

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids.tolist())).encode()).hexdigest()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(ids)
        sizes = [len(x) for x in ids]
        if not sum(sizes):
            return out
        self.db.register("given", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(sum(sizes), dtype=np.int32), "id": np.concatenate(ids).astype(np.int32)}))
        for d, spelt, n in self.db.execute("SELECT d, string_agg(spelt, '' ORDER BY pos), count(*) FROM given JOIN vocabulary USING (id) GROUP BY d").fetchall():
            if n != sizes[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = (np.frombuffer(spelt.encode("utf-16-le"), "<u2") - 256).astype(np.uint8).tobytes()
        self.db.unregister("given")
        return out


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The worker's codec of this vocabulary, made once."""
    return held(hashlib.sha256(ranks_file + pattern.encode()).digest(), lambda: Codec(ranks_file, pattern))


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    """The ids as one list array, without a Python object for each."""
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE, holds=True):
                ids = codec(ranks_file, pattern).encode(_texts(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of every row of (doc_id, ids); null ids decode to nothing."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "ids", SLICE, holds=True):
                raw = codec(ranks_file, pattern).decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    rows = encoded.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: both directions in one pass over the texts.

    Only the ids go from the encoder to the decoder. With ``keep_ids`` they are returned as a column ids.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE, holds=True):
                both = codec(ranks_file, pattern)
                both.cache_words = cache_words
                ids = both.encode(_texts(part.column("text")))
                decoded = both.decode(ids)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([both.digest(x) for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = _lists(ids)
                yield pa.record_batch(list(columns.values()), names=list(columns))

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
