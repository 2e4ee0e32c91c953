"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a table of blocks in ascending id order. A block holds, in this order: the magic bytes BLTF, the number of
documents and of ids (two unsigned 32-bit integers), the documents' ids (signed 64-bit), their null flags (bytes), their
numbers of token ids (unsigned 32-bit), the control bytes, and the data bytes. A control byte has the lengths less one of
four values, two bits each, lowest first; a value is a token's rank by frequency over the whole corpus, little-endian, in
as few bytes as hold it. A value's place and length come from the control bytes by table lookup, without a loop over ids.

Defined results: null text counts as empty, and has only the end id; null ids sort first; rows with one id are in the
order of their texts' hashes; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import byte_table, map_rows, pieces, prepare, session_of, span_hashes, stored, string_bytes, text_or_empty, words

MAGIC = b"BLTF"
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit values."""
    n = len(values)
    padded = np.zeros(-(-n // 4) * 4, "<u4")
    padded[:n] = values
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    size[n:] = 1
    control = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) < size[:n, None]
    return control.tobytes() + values.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_values(data: bytes | memoryview, n: int) -> np.ndarray:
    """The n values of pack_values."""
    groups = -(-n // 4)
    raw = np.frombuffer(data, np.uint8)
    size = _LENGTHS[raw[:groups]].reshape(-1)[:n]
    body = np.concatenate([raw[groups:], np.zeros(3, np.uint8)])
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    out = body[at].astype(np.uint32)
    for k in (1, 2, 3):
        if (more := size > k).any():
            out[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return MAGIC + struct.pack("<II", len(doc_ids), len(ranks)) + keys.tobytes() + nulls.tobytes() + counts.astype("<u4").tobytes() + pack_values(ranks)


def read_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    if block[:4] != MAGIC:
        raise ValueError("not a token file block")
    docs, n = struct.unpack_from("<II", block, 4)
    at = 12
    keys = np.frombuffer(block, "<i8", docs, at).tolist()
    nulls = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at := at + docs)
    ranks = unpack_values(memoryview(block)[at + 4 * docs :], n)
    return [None if z else k for k, z in zip(keys, nulls.tolist())], counts, ranks


_TABLE = byte_table(np.random.default_rng(8))
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = ~_ALNUM[33:127]


def _odd_space(raw: np.ndarray) -> np.ndarray:
    """Places of white space other than space and line feed, in UTF-8."""
    odd = _ODD[raw]
    high = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
    if len(high):
        a, b, c = (raw[np.minimum(high + k, len(raw) - 1)] for k in range(3))
        odd[high] = (
            (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        )
    return np.flatnonzero(odd)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at start and have so many places, one run after the other."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - upto[:-1], size) + np.arange(upto[-1])


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in rising order, a place of each, and each place's value's number: only distinct values are sorted."""
    code, value = pd.factorize(x)
    order = np.argsort(value)
    rank, place = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
    rank[order], place[code] = np.arange(len(value)), np.arange(len(x))
    return value[order], place[order], rank[code]


class UnitCache:
    """Units' ids in arrays sorted by the units' 64-bit hashes; a unit is found only if its bytes are equal too.

    When more than `most` units are held, the half that was used last stays: units that are gone are encoded again.
    """

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.span = np.zeros((0, 4), np.int64)  # first byte, bytes, first id, ids
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def trim(self) -> None:
        """Begin a batch."""
        self.turn += 1
        if len(self.hashes) > self.most:
            kept = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
            self.hashes, self.used, old = self.hashes[kept], self.used[kept], self.span[kept]
            self.bytes, self.ids = self.bytes[spread(old[:, 0], old[:, 1])], self.ids[spread(old[:, 2], old[:, 3])]
            self.span = np.column_stack([np.cumsum(old[:, 1]) - old[:, 1], old[:, 1], np.cumsum(old[:, 3]) - old[:, 3], old[:, 3]])

    def missing(self, hashes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the units raw[begin:end] are not held."""
        if not len(self.hashes):
            return np.arange(len(hashes))
        at, size = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1), end - begin
        held = (self.hashes[at] == hashes) & (self.span[at, 1] == size)
        k = np.flatnonzero(held)
        differ = raw[spread(begin[k], size[k])] != self.bytes[spread(self.span[at[k], 0], size[k])]
        if differ.any():
            held[np.repeat(k, size[k])[differ]] = False
        self.used[at[held]] = self.turn
        return np.flatnonzero(~held)

    def add(self, hashes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Hold units of rising hashes, in place of others with those hashes."""
        size = end - begin
        span = np.column_stack([len(self.bytes) + np.cumsum(size) - size, size, len(self.ids) + np.cumsum(count) - count, count])
        self.bytes, self.ids = np.concatenate([self.bytes, raw[spread(begin, size)]]), np.concatenate([self.ids, ids])
        other = hashes[np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)] != self.hashes
        old, used, spans = self.hashes[other], self.used[other], self.span[other]
        at = np.searchsorted(old, hashes)
        self.hashes, self.used, self.span = np.insert(old, at, hashes), np.insert(used, at, self.turn), np.insert(spans, at, span, axis=0)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id in `ids`, and number of ids, of units that are held."""
        span = self.span[np.searchsorted(self.hashes, hashes)]
        return span[:, 2], span[:, 3]


class BatchTokenizer:
    """Whole texts to ids by the tokenizers library, each distinct unit once.

    Pre-tokens never span a single space or line feed between two words. So where those are a text's only white space,
    its units are the words, each with the separator before it, and a text's ids are its units' ids in order. Units of a
    batch are told apart by 64-bit hashes, from those kept between batches by their bytes too. Other texts, and those that hold an
    added token, which the library finds before it looks for pre-tokens, go to the library whole; none of their units
    are encoded. All texts do if an added token has white space, as it could then begin in one unit and end in the next.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.length = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.length[i] = len(token)  # a byte-level token has one character for each of its bytes
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.spaced = any(t.split() != [t] for t in map(bytes.decode, self.added))
        self.cache = UnitCache(most)

    def library(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        end = [0, *np.cumsum([4 * len(x) for x in found]).tolist()]
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", end[-1] // 4).tobytes()
        return [flat[a:b] for a, b in zip(end, end[1:])]

    def _units(self, hashes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id in the cache, and number of ids, of the units raw[begin:end], whose hashes rise."""
        self.cache.trim()
        new = self.cache.missing(hashes, raw, begin, end)
        if len(new):
            data = raw.tobytes()
            units = [data[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist())]
            ids, count = zip(*(self._together(units[low : low + 5000]) for low in range(0, len(units), 5000)))
            self.cache.add(hashes[new], raw, begin[new], end[new], np.concatenate(ids), np.concatenate(count))
        return self.cache.places(hashes)

    def _together(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has: the library gets them as one text, which is cut where their separators stand."""
        bare = np.array([u[:1] not in (b" ", b"\n") for u in units])
        parts = [b"\n" + u if x else u for u, x in zip(units, bare.tolist())]
        ids = np.frombuffer(self.library([b"".join(parts).decode()])[0], "<u4")
        end = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p) for p in parts])) + 1
        start = np.concatenate([[0], end[:-1]]) + bare
        return ids[spread(start, end - start)], end - start

    def _with_added(self, data: bytes) -> list[int]:
        """Places where an added token's content begins."""
        out = []
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                out.append(at)
                at = data.find(token, at + 1)
        return out

    @staticmethod
    def _parted(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units with a closing run of ASCII punctuation cut off: a pre-token ends where it follows a letter or digit."""
        solid = np.where(_PUNCTUATION[raw], 0, np.arange(1, len(raw) + 1))
        core = np.maximum.accumulate(solid)[end - 1] if len(end) else end
        last = raw[np.maximum(core - 1, 0)]
        latin = (raw[np.maximum(core - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        cut = (core < end) & (core > begin) & (_ALNUM[last] | latin & (core - 1 > begin))
        at = np.cumsum(1 + cut) - cut - 1
        b, e = np.empty(len(begin) + cut.sum(), np.int64), np.empty(len(begin) + cut.sum(), np.int64)
        b[at], e[at] = begin, np.where(cut, core, end)
        b[at[cut] + 1], e[at[cut] + 1] = core[cut], end[cut]
        return b, e, np.concatenate([at, [len(b)]])[first]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each row of a string column without nulls, as little-endian unsigned 32-bit integers."""
        raw, at = string_bytes(column)
        out: list[bytes] = []
        for i, j in pieces(at, 1 << 23):
            part, rows = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            data = part.tobytes()
            start, end, first = words(part, rows)
            has = np.flatnonzero(np.diff(first))
            begin = np.maximum(start - 1, 0)  # with the separator
            begin[first[has]] = start[first[has]]
            # A row is usual if its words are one byte apart, fill it, and have no other white space and no added token.
            odd = np.full(j - i, self.spaced)
            gap = np.flatnonzero(start[1:] != end[:-1] + 1) + 1
            gap = gap[~np.isin(gap, first[has])]
            odd[np.searchsorted(rows, start[gap], "right") - 1] = True
            odd[has] |= (start[first[has]] != rows[has]) | (end[first[has + 1] - 1] != rows[has + 1])
            odd[np.searchsorted(rows, _odd_space(part), "right") - 1] = True
            odd[np.searchsorted(rows, np.array(self._with_added(data), np.int64), "right") - 1] = True
            odd |= (np.diff(first) == 0) & (np.diff(rows) > 0)
            usual, count = np.repeat(~odd, np.diff(first)), np.where(odd, 0, np.diff(first))
            begin, end, first = self._parted(part, begin[usual], end[usual], np.concatenate([[0], np.cumsum(count)]))
            hashes, where, which = distinct(span_hashes(part, begin, end, _TABLE))
            at_id, size = self._units(hashes, part, begin[where], end[where])
            count = size[which]
            upto = np.concatenate([[0], np.cumsum(count)])
            flat = memoryview(self.cache.ids[spread(at_id[which], count)].tobytes())
            cut = (4 * upto[first]).tolist()
            whole = iter(self.library([data[rows[k] : rows[k + 1]].decode() for k in np.flatnonzero(odd)]))
            out += [next(whole) if o else bytes(flat[a:b]) for o, a, b in zip(odd.tolist(), cut, cut[1:])]
        return out


@lru_cache(1)
def batch_tokenizer(path: str) -> BatchTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return BatchTokenizer(path)


def id_kind(vocabulary: str) -> str:
    """The narrower unsigned integer that holds every id of the vocabulary."""
    return "<u2" if batch_tokenizer(vocabulary).vocabulary <= 1 << 16 else "<u4"


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Unranked blocks in ascending id order: part, seq, doc_ids, counts, ids (binary, of id_kind())."""
    spark = session_of(docs)
    kind = id_kind(vocabulary)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = batch_tokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [x + end for x in coder.encode(batch.column(2))]
            counts = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[0].as_py()], pa.int32()), pa.array([seq], pa.int64()), pa.array([batch.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes()], pa.binary())],
                ["part", "seq", "doc_ids", "counts", "ids"],
            )
            seq += 1

    ordered = (
        docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
        .repartitionByRange(n, F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
        .select(F.spark_partition_id().alias("part"), "id", "text")
    )
    return map_rows(ordered, run, "part int, seq long, doc_ids array<long>, counts array<int>, ids binary")


def frequency_ranks(blocks: DataFrame, vocabulary_size: int, kind: str) -> np.ndarray:
    """ids by falling frequency over all blocks; the driver gets one row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                seen = np.bincount(np.frombuffer(ids, kind), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counted = map_rows(blocks.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(max([vocabulary_size, *(r["id"] + 1 for r in counted)]), np.int64)
    for r in counted:
        n[r["id"]] = r["n"]
    return np.lexsort((np.arange(len(n)), -n)).astype(np.uint32)


def write_token_file(docs: DataFrame, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The written file's blocks (part, seq, n_ids, block), read back, and the ids by rank."""
    spark = session_of(docs)
    prepare(spark)
    raw = stored(token_blocks(docs, vocabulary, end_id, id_column, text_column), "token-ids")
    kind = id_kind(vocabulary)
    by_rank = frequency_ranks(raw, batch_tokenizer(vocabulary).vocabulary, kind)
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part, seq, doc_ids, counts, ids in zip(*(c.to_pylist() for c in batch.columns)):
                block = write_block(doc_ids, np.array(counts, np.int64), table[np.frombuffer(ids, kind)])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([block], pa.binary())], ["part", "seq", "n_ids", "block"])

    return stored(map_rows(raw, run, "part int, seq long, n_ids long, block binary"), "token-file"), by_rank


def read_token_file(file: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the file's blocks."""
    spark = session_of(file)
    shared = spark.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "seq", "within", "n_tokens", "ids_crc32"]
        for batch in batches:
            for part, seq, block in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, counts, ranks = read_block(block)
                ids = memoryview(shared.value[ranks].astype("<u4").tobytes())
                end = np.cumsum(counts, dtype=np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((end - counts).tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([part] * len(crc), pa.int32()), pa.array([seq] * len(crc), pa.int64()), pa.array(end - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names)

    rows = map_rows(file.select("part", "seq", "block"), run, "doc_id long, part int, seq long, within long, n_tokens long, ids_crc32 long")
    # A part's blocks are few; the parts' totals are one row for each shuffle partition.
    parts = sorted((r["part"], r["n"]) for r in file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in parts:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = file.select("part", "seq", "n_ids").withColumn("before", before).join(base, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("from"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("from") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
