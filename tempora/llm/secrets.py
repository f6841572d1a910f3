"""Secret scan: keyword automaton, anchored expressions near hits, checksum validation.

One pass of an Aho-Corasick automaton over the text finds keywords; the
expression of a kind is tried only at its keyword's hits. Runs of hexadecimal
digits have no keyword and are found by a vectorised run-length scan. Tokens
that embed a checksum are reported only if it holds:

* github, npm: a prefix, 30 characters, and their CRC-32 in base 62;
* xprv: an extended private key in base 58, whose last four bytes are those of
  the double SHA-256 of the rest;
* bech32: a secret key with the prefix nsec or AGE-SECRET-KEY-, whose last six
  characters are a BCH code of prefix and data.

Defined cases: a null text has no span; repeated rows share their result;
offsets count code points; a match that fails its rule is dropped without
another try inside it; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.llm._common import col, text_slices

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = {
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "xprv": re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![A-Za-z0-9])"),
    "bech32": re.compile(r"((?:nsec1|AGE-SECRET-KEY-1)[0-9A-Za-z]{58})(?![A-Za-z0-9])"),
}
KINDS = ("assign", "access", "hex", *CHECKED)
KEYWORDS = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access", "npm_": "npm", "xprv": "xprv"}
KEYWORDS |= {f"gh{x}_": "github" for x in "pousr"} | {"nsec1": "bech32", "age-secret-key-1": "bech32"}
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BCH = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def base58_checks(token: str) -> bool:
    """Whether the last four bytes are the checksum of the rest."""
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_checks(token: str) -> bool:
    """Whether prefix and data, which have one case, give the remainder 1."""
    if token not in (token.lower(), token.upper()):
        return False
    prefix, _, data = token.lower().rpartition("1")
    if not prefix or any(c not in BECH32 for c in data):
        return False
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    rest = 1
    for v in values:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BCH):
            rest ^= g if top >> i & 1 else 0
    return rest == 1


def checks(kind: str, body: str) -> bool:
    """Whether the checksum that a token of this kind embeds holds."""
    if kind in ("github", "npm"):
        return checksum(body[:30]) == body[30:]
    return base58_checks(body) if kind == "xprv" else bech32_checks(body)


def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


_made: list = []


def hex_runs(raw: bytes, least: int = 24) -> list[tuple[int, int]]:
    """Maximal runs of lower-case hexadecimal digits, in code points."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], _HEX[data].view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if len(starts) and not raw.isascii():
        points = np.cumsum((data & 0xC0) != 0x80)
        starts, ends = points[starts] - 1, points[ends - 1]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then in the order of KINDS."""
    if not text:
        return []
    if not _made:
        _made.append(_automaton())
    raw = text.encode("utf-8", "surrogatepass")
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _made[0].iter(raw.lower().decode("utf-8", "surrogatepass")))
    spans = [(a, b, "hex") for a, b in hex_runs(raw)]
    over = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < over[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                over[kind] = m.end()
                if len(m[2]) >= 6:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                over[kind] = m.end()
                if m.end() - start >= 20:
                    spans.append((start, m.end(), kind))
        elif (m := CHECKED[kind].match(text, start)) and checks(kind, m[1]):
            over[kind] = m.end()
            spans.append((start, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans merge."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
