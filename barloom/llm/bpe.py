"""Byte-level BPE by dynamic programming over byte prefixes.

The encoding of a byte string by a merge list has this property: every prefix has exactly one valid encoding, and a
sequence of tokens is valid if and only if each neighbouring pair is what the merges give for the two tokens' bytes
together. So one token per prefix, its last, is enough: walking back from any end gives that prefix's encoding. An append
extends the table; an edit recomputes it from the edit until it agrees again with the old one.

Defined results: null text counts as empty; an empty text has no tokens; equal texts have equal rows; columns other than
the id and text columns are ignored; very long texts without white space take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cached_here, map_rows, text_or_empty


class PrefixEncoder:
    """Token ids of byte strings for a rank file; `last_tokens` is the table over prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.tokens[i] = b
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbouring pair of lowest rank, leftmost first, until none is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.tokens):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _reachable(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, data: bytes | bytearray, last: list[int], stop: int | None = None) -> None:
        """Add the last token of each prefix longer than those in `last` (last[0] stands for the empty prefix)."""
        find, fits, pairs, longest = self.ranks.get, self._fits, self._pairs, self.longest
        data = bytes(data)
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            for start in range(max(0, end - longest), end):
                token = find(data[start:end])
                if token is None:
                    continue
                if start:
                    ok = pairs.get(last[start] << 32 | token)
                    if ok is None:
                        ok = self._reachable(token) and fits(last[start], token)
                else:
                    ok = self._reachable(token)
                if ok:
                    last.append(token)
                    break

    def trace(self, last: list[int], end: int | None = None) -> list[int]:
        out, end = [], len(last) - 1 if end is None else end
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the splitting pattern; a match that is itself a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last)
        return self.trace(last)


class PrefixTable:
    """An encoded byte string that can grow and be edited; `tokens()` always equals a fresh encoding."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, bytearray(data), [-1]
        self.recomputed = 0
        encoder.extend(self.data, self.last)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put `data` in place of bytes start to stop, and recompute only until the table agrees with the old one."""
        old, shift = self.last, len(data) - (stop - start)
        self.data[start:stop] = data
        new, same, end = old[: start + 1], 0, start
        while end < len(self.data):
            end += 1
            self.encoder.extend(self.data, new, end)
            # Past the edit, the same last token at as many ends in a row as the longest token has bytes settles the rest.
            same = same + 1 if end - shift > stop and end > start + len(data) and old[end - shift] == new[end] else 0
            if same >= self.encoder.longest:
                new += old[end - shift + 1 :]
                break
        self.recomputed = end - start
        self.last = new

    def tokens(self) -> list[int]:
        whole = self.encoder.ranks.get(bytes(self.data))
        return [whole] if whole is not None else self.encoder.trace(self.last)


class UnitCache(dict):
    """Results by text unit in two generations, so that frequent units stay and memory is bounded."""

    def __init__(self, compute, most: int = 250_000):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.compute(unit)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[unit] = found
        return found


#: White space other than single spaces and line feeds between words; texts without it can be cut at each of those.
UNUSUAL = re.compile(r"\s\s|[^\S\n ]|\A\s|\s\Z")


class TextEncoder:
    """Splits whole texts by the pattern and encodes each match; ids come as little-endian unsigned 32-bit integers.

    A match never spans a single space or line feed between two words: a space begins the next match and a line feed is
    a match of its own. So texts without other white space are cut there, and each unit's matches are looked up.
    """

    def __init__(self, encoder: PrefixEncoder, pattern: str):
        self.encoder, self.pattern = encoder, regex.compile(pattern)
        self.piece = UnitCache(lambda p: np.array(encoder.encode_piece(p.encode()), "<u4").tobytes(), 400_000)
        self.first = UnitCache(self._unit)
        self.spaced = UnitCache(lambda unit: self._unit(" " + unit))
        self.line_end = self.piece["\n"]

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(unit)))

    def encode(self, text: str) -> bytes:
        if not text or UNUSUAL.search(text):
            return self._unit(text)
        first, spaced, out = self.first, self.spaced.__getitem__, []
        for line in text.split("\n"):
            units = line.split(" ")
            out.append(first[units[0]] + b"".join(map(spaced, units[1:])))
        return self.line_end.join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    cached_here(text_encoder.cache_clear)
    return TextEncoder(PrefixEncoder.from_file(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(vocabulary, pattern)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            back = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    return map_rows(picked, run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_column)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Of each document: n_tokens, and the digests of its ids and of the bytes that they decode to.

    The digests are taken where the text is encoded, so that neither ids nor decoded bytes travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = coder.encode(t)
                n.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_rows(picked, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
