"""Media columns of progressive JPEG images.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms
those in numpy, upsamples chroma, and gives full-resolution RGB tensors. The encoder stores any bytes losslessly in the
format's own unit, the quantised coefficient: a byte is the eight extra bits of an AC coefficient of size 8, so that bytes
0 to 127 are the values -255 to -128 and bytes 128 to 255 themselves. Images are 4:2:0, quantised by 1, and hold 63 bytes
in each block; the payload's length is in a comment segment, and spaces fill the last row of blocks.

Scans whose every symbol is the same one-bit code have fixed places for all values, and are read by array operations;
whether a scan is such is seen from its bits, and any other scan is read symbol by symbol.

Defined results: null text counts as empty, and its payload is 192 spaces; texts of any length are stored whole; equal
texts have equal values; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_rows, stored, text_or_empty

#: Bytes of payload in a macroblock of four luma and two chroma blocks.
IN_MACROBLOCK = 6 * 63
#: Widest image in macroblocks.
WIDEST = 4095
FILL = 32
_DIAGONAL = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
#: Natural place (row * 8 + column) of each coefficient in zigzag order.
ZIGZAG = np.array([y * 8 + x for y, x in _DIAGONAL])
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _scan(components: list[tuple[int, int]], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(b for c, t in components for b in (c, t)), start, end, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds payload in its AC coefficients."""
    count = max(1, -(-len(payload) // IN_MACROBLOCK))
    rows = -(-count // WIDEST)
    wide = -(-count // rows)
    count = rows * wide
    units = np.full(count * IN_MACROBLOCK, FILL, np.uint8)
    units[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [x.reshape(-1, 63) for x in np.split(units, [count * 252, count * 315])]
    out = [b"\xff\xd8", _segment(0xFE, b"payload" + struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, b"\x00" + b"\x01" * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    one_code = lambda kind, symbol: _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))
    out += [one_code(0x00, 0), one_code(0x10, 7), one_code(0x11, 0)]
    flat = np.packbits(np.concatenate([np.zeros(6 * count, np.uint8), np.ones(-6 * count % 8, np.uint8)])).tobytes()
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, flat))
    # First scans leave out the lowest bit: the code 0 and seven extra bits are the byte shifted right.
    for c, start, end in ((0, 1, 5), (2, 1, 63), (1, 1, 63), (0, 6, 63)):
        out.append(_scan([(c + 1, 0)], start, end, 0, 1, (planes[c][:, start - 1 : end] >> 1).tobytes()))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, flat))
    # The last scans have, of each block, the code 0 (nothing new to its end) and the lowest bit of every magnitude.
    for c in (2, 1, 0):
        bits = np.zeros((len(planes[c]), 64), np.uint8)
        bits[:, 1:] = np.where(planes[c] >= 128, planes[c], ~planes[c]) & 1
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


class _Table:
    """A Huffman table; `lone` is its symbol if that is all, with the code 0."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.lone = symbols[0] if counts[0] == 1 and len(symbols) == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        short = self.at + n - len(self.bits)
        self.at += n
        return value << short if 0 < short <= n else value

    def symbol(self, table: _Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1


class Image:
    """A decoded progressive JPEG: coefficients (blocks high, blocks wide, 64 in zigzag order) of each component."""

    def __init__(self, data: bytes):
        self.data, self.comments, self.tables, self.quant, self.interval = data, [], {}, {}, 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while data[at + 1] != 0xD9:
            marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xDA:
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                stop = end.start() if end else len(data)
                self._read(body, data[at:stop])
                at = stop

    def _quantisers(self, body: bytes) -> None:
        while body:
            kind, wide = body[0] & 15, 1 + (body[0] >> 4)
            self.quant[kind] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
            body = body[1 + 64 * wide :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0]] = _Table(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.ids, self.h, self.v, self.q = [p[0] for p in parts], [p[1] >> 4 for p in parts], [p[1] & 15 for p in parts], [p[2] for p in parts]
        self.high, self.wide = -(-self.height // (8 * max(self.v))), -(-self.width // (8 * max(self.h)))
        self.coefficients = [np.zeros((self.high * v, self.wide * h, 64), np.int32) for h, v in zip(self.h, self.v)]

    def _blocks(self, chosen: list[int]) -> Iterator[list[tuple[int, int, int]]]:
        """(component, row, column) of the blocks of each unit of a scan."""
        if len(chosen) == 1:
            c = chosen[0]
            rows = -(-self.height * self.v[c] // (8 * max(self.v)))
            columns = -(-self.width * self.h[c] // (8 * max(self.h)))
            yield from ([(c, y, x)] for y in range(rows) for x in range(columns))
        else:
            for y in range(self.high):
                for x in range(self.wide):
                    yield [(c, y * self.v[c] + j, x * self.h[c] + i) for c in chosen for j in range(self.v[c]) for i in range(self.h[c])]

    def _read(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = [self.ids.index(head[1 + 2 * i]) for i in range(n)]
        tables = [head[2 + 2 * i] for i in range(n)]
        start, end, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        if not self.interval and self._read_fixed(chosen, tables, start, end, high, low, data.replace(b"\xff\x00", b"\xff")):
            return
        units = self._blocks(chosen)
        for part in re.split(rb"\xff[\xd0-\xd7]", data) if self.interval else [data]:
            bits, last, run = _Bits(part.replace(b"\xff\x00", b"\xff")), dict.fromkeys(chosen, 0), 0
            for _, unit in zip(range(self.interval or 1 << 62), units):
                for c, y, x in unit:
                    block, kind = self.coefficients[c][y, x], tables[chosen.index(c)]
                    if start == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            last[c] += bits.signed(bits.symbol(self.tables[kind >> 4]))
                            block[0] = last[c] << low
                    elif high:
                        run = self._refine(block, bits, self.tables[0x10 | kind & 15], start, end, low, run)
                    else:
                        run = self._first(block, bits, self.tables[0x10 | kind & 15], start, end, low, run)

    @staticmethod
    def _first(block: np.ndarray, bits: _Bits, table: _Table, start: int, end: int, low: int, run: int) -> int:
        if run:
            return run - 1
        k = start
        while k <= end:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                block[k] = bits.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def _refine(block: np.ndarray, bits: _Bits, table: _Table, start: int, end: int, low: int, run: int) -> int:
        def correct(k: int) -> None:
            if bits.take(1):
                block[k] += 1 << low if block[k] > 0 else -1 << low

        k = start
        while k <= end and not run:
            zeros, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = 1 << low if bits.take(1) else -1 << low
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= end:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for j in range(k, end + 1):
                if block[j]:
                    correct(j)
            run -= 1
        return run

    def _read_fixed(self, chosen: list[int], tables: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bool:
        """Read a scan in which every symbol is one and the same, with the code 0; False if it is not such a scan."""
        raw = np.frombuffer(data, np.uint8)
        if start == 0:
            n = sum(self.coefficients[c].shape[0] * self.coefficients[c].shape[1] for c in chosen)
            whole = len(chosen) > 1 and len(raw) == -(-n // 8) and not raw[: n // 8].any() and not (n % 8 and raw[-1] >> 8 - n % 8)
            return whole and (high > 0 or all(self.tables[t >> 4].lone == 0 for t in tables))  # all differences, or all bits, are 0
        c, table = chosen[0], self.tables[0x10 | tables[0] & 15]
        band = self.coefficients[c][:, :, start : end + 1]
        if table.lone is None or self.height % (8 * max(self.v)) or self.width % (8 * max(self.h)):
            return False
        if high:
            if table.lone or end - start + 2 != 64 or len(raw) != 8 * band.shape[0] * band.shape[1] or not band.all():
                return False
            bits = np.unpackbits(raw).reshape(*band.shape[:2], 64)
            if bits[:, :, 0].any():
                return False
            band += np.where(band > 0, 1, -1) * (bits[:, :, 1:].astype(np.int32) << low)
            return True
        if table.lone != 7 or len(raw) != band.size or (raw >= 128).any():
            return False
        value = raw.astype(np.int32).reshape(band.shape)
        band[:] = np.where(value >= 64, value, value - 127) * (1 << low)
        return True

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution."""
        out = []
        for blocks, q in zip(self.coefficients, self.q):
            high, wide, _ = blocks.shape
            plane = np.empty((high * 8, wide * 8), np.uint8)
            step = max(1, (1 << 14) // wide)  # block rows at a time
            for y in range(0, high, step):
                natural = np.empty((*blocks[y : y + step].shape[:2], 64), np.float32)
                natural[:, :, ZIGZAG] = blocks[y : y + step] * self.quant[q]
                x = (natural.reshape(-1, 8) @ _DCT).reshape(-1, 8, 8)  # over columns
                x = (x.swapaxes(1, 2).reshape(-1, 8) @ _DCT).reshape(len(natural), wide, 8, 8)  # over rows; [.., column, row]
                plane[8 * y : 8 * (y + len(natural))] = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8).transpose(0, 3, 1, 2).reshape(-1, wide * 8)
            out.append(plane)
        return out

    def rgb(self) -> np.ndarray:
        """The image as a tensor (height, width, 3) of bytes."""
        full = []
        for plane, h, v in zip(self.planes(), self.h, self.v):
            up = plane.repeat(max(self.v) // v, 0) if v < max(self.v) else plane
            full.append((up.repeat(max(self.h) // h, 1) if h < max(self.h) else up)[: self.height, : self.width].astype(np.float32))
        if len(full) == 1:
            return np.repeat(full[0].astype(np.uint8)[:, :, None], 3, 2)
        y, b, r = full[0], full[1] - 128, full[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, x in enumerate((y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b)):
            out[:, :, k] = np.clip(np.rint(x), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that encode() stored."""
        size = next(struct.unpack(">Q", c[7:])[0] for c in self.comments if c.startswith(b"payload"))
        value = np.concatenate([c[:, :, 1:].reshape(-1) for c in self.coefficients])
        return np.where(value > 0, value, value + 255).astype(np.uint8).tobytes()[:size]


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a checksum of an RGB tensor."""
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{','.join(f'{m:.3f}' for m in mean)}:{zlib.crc32(rgb.tobytes()):08x}"


def padded(text: bytes) -> bytes:
    return text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))


def media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media (binary): each text's payload as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def tensors(images: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """id, height, width and rgb (binary, height * width * 3 bytes) of each stored image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Image(x).rgb() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.shape[1] for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "height", "width", "rgb"])

    kind = images.schema[id_column].dataType.simpleString()
    return map_rows(images.select(F.col(id_column).alias("id"), media_column), run, f"id {kind}, height int, width int, rgb binary").withColumnRenamed("id", id_column)


def media_digests(docs: DataFrame) -> DataFrame:
    """Of each document: digests of its stored image, and of the payload and RGB tensor read back from that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for kept in batch.column(2).to_pylist():
                image = Image(kept)
                payload = image.payload()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(kept), hashlib.sha256(kept).hexdigest(), feature(image.rgb())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    images = stored(media(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "media")
    return map_rows(images, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
