"""Media columns in baseline JPEG: payload bytes as quantised coefficients, markers, Huffman scans and DC thumbnails.

`encode_media` stores each payload losslessly: 64 bytes are the 64 coefficients of a block, byte b as the value b + 1,
with a quantisation table of ones. `decode_media` reads baseline files in general (several components, sampling
factors, runs, restart intervals): it parses the markers, decodes the Huffman scans of many restart intervals at a time
in numpy, and builds a luminance thumbnail from the DC coefficients. Only bytes of one slice of rows are in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import slices

BLOCK = 64
#: A block row of an image holds at most so many blocks; the format's limit is 65,535 pixels.
MAX_SIDE = 8191
ENCODED = "doc_id long, n_bytes long, media binary"
DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail binary"

# Code of size s (number of bits of a value): 9 - s ones and a zero. With its s bits, each value of 1..256 takes 10 bits.
_SIZES = list(range(9, 0, -1))
_VALUES = np.arange(1, 257)
_SIZE_OF = np.floor(np.log2(_VALUES)).astype(np.int64) + 1
_TEN_BITS = (((1 << (9 - _SIZE_OF)) - 1) << (_SIZE_OF + 1) | _VALUES).astype(np.uint64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HUFFMAN = bytes([1] * 9 + [0] * 7 + _SIZES)
_TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, b"\x00" + _HUFFMAN + b"\x10" + _HUFFMAN) + _segment(0xDD, struct.pack(">H", 1))
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _header(blocks: int, wide: int, high: int) -> bytes:
    frame = struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xFE, b"blocks=%d" % blocks) + _TABLES + _segment(0xC0, frame) + _SCAN


def _encode(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Bytes of each text, and the file with its payload: the bytes and zeros up to a positive multiple of 64."""
    data = pc.fill_null(texts, "").cast(pa.binary())
    n = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = np.maximum(1, -(-n // BLOCK))
    sides = np.minimum(MAX_SIDE, np.ceil(np.sqrt(blocks)).astype(np.int64)[:, None] + np.arange(8))
    wide = sides[np.arange(len(n)), (-(-blocks[:, None] // sides) * sides).argmin(axis=1)]  # nearly square, few blocks over
    high = -(-blocks // wide)
    if (high > MAX_SIDE).any():
        raise ValueError("a text of over 4 GB doesn't fit into one image")
    cells = wide * high
    ends = np.cumsum(cells)
    payload = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    source = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    payload[np.arange(len(source)) + np.repeat((ends - cells) * BLOCK - (np.cumsum(n) - n), n)] = source

    codes = _TEN_BITS[payload].reshape(-1, 16, 4)
    packed = codes[..., 0] << np.uint64(30) | codes[..., 1] << np.uint64(20) | codes[..., 2] << np.uint64(10) | codes[..., 3]
    rows = packed.astype(">u8").view(np.uint8).reshape(-1, 16, 8)[..., 3:].reshape(-1, 80)
    # an interval for each block; 0xFF in its data is followed by a zero, and a marker ends it
    full = rows == 0xFF
    stuffed = full.sum(axis=1)
    row_end = np.cumsum(stuffed + 82)
    scan = np.zeros(int(row_end[-1]), np.uint8)
    at = (row_end - stuffed - 82)[:, None] + np.arange(80)
    odd = np.flatnonzero(stuffed)
    at[odd] += np.cumsum(full[odd], axis=1) - full[odd]
    scan[at] = rows
    in_image = np.arange(len(rows)) - np.repeat(ends - cells, cells)
    scan[row_end - 2], scan[row_end - 1] = 0xFF, 0xD0 + in_image % 8
    scan[row_end[ends - 1] - 1] = 0xD9
    last = row_end[ends - 1]
    whole = scan.tobytes()
    return n, [_header(b, w, h) + whole[s:e] for b, w, h, s, e in zip(blocks.tolist(), wide.tolist(), high.tolist(), [0, *last[:-1].tolist()], last.tolist())]


class Frame(NamedTuple):
    """What the markers say. mcu: for each block of an MCU its component, DC table and AC table."""

    width: int
    height: int
    blocks: int | None
    tables: tuple
    mcu: tuple[tuple[int, int, int], ...]
    sampling: tuple[int, int, int, int]
    interval: int
    dc_step: int
    scan: tuple[int, int]

    @property
    def grid(self) -> tuple[int, int]:
        h, v, h_max, v_max = self.sampling
        return -(-self.width // (8 * h_max)), -(-self.height // (8 * v_max))


def parse_markers(media: bytes) -> Frame:
    """Markers up to the first scan. Raises ValueError for what isn't a baseline file."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at, quant, huffman, parts, size, interval, blocks = 2, {}, {}, {}, None, 0, None
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + length], at + 2 + length
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xFE and body.startswith(b"blocks="):
            blocks = int(body[7:])
        elif kind == 0xC0:
            size = struct.unpack(">HH", body[1:5])
            parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
        elif kind in range(0xC1, 0xD0) and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif kind == 0xDA:
            if not size or body[0] != len(parts):
                raise ValueError("no frame, or a scan that lacks components")
            mcu, first = [], parts[body[1]]
            for k in range(body[0]):
                h, v, _ = parts[body[1 + 2 * k]]
                tables = body[2 + 2 * k]
                mcu += [(k, tables >> 4, tables & 15)] * (h * v if len(parts) > 1 else 1)
            h, v = first[:2] if len(parts) > 1 else (1, 1)
            most = (max(p[0] for p in parts.values()), max(p[1] for p in parts.values())) if len(parts) > 1 else (1, 1)
            end = media.rfind(b"\xff\xd9")
            return Frame(size[1], size[0], blocks, tuple(sorted(huffman.items())), tuple(mcu), (h, v, *most), interval, quant[first[2]], (at, end if end > at else len(media)))
    raise ValueError("no scan")


def _lookup(table: bytes) -> np.ndarray:
    """Symbol * 32 + code length by the next 16 bits; 0 where no code begins so."""
    out, code, symbols = np.zeros(1 << 16, np.int64), 0, iter(table[16:])
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = next(symbols) * 32 + length
            code += 1
        code <<= 1
    return out


class _Bits:
    """Reads from many places of a byte array at once."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
        self.words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        self.last = len(self.words) - 1

    def value(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        word = self.words[np.minimum(at >> 3, self.last)]
        return (word << (at & 7) & 0xFFFFFFFF) >> (32 - size)

    def symbol(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[self.value(at, np.int64(16))]
        if not found.all():
            raise ValueError("a code that no table has")
        return found >> 5, found & 31


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _scans(frames: list[Frame], media: list[bytes]) -> list[np.ndarray]:
    """Coefficients of the first component, in zigzag order, of files that have the same tables and MCU."""
    frame = frames[0]
    tables = {k: _lookup(t) for k, t in frame.tables}
    raw = [np.frombuffer(m, np.uint8)[f.scan[0] : f.scan[1]] for f, m in zip(frames, media)]
    starts = np.cumsum([0, *map(len, raw)])
    data = np.concatenate([*raw, np.zeros(1, np.uint8)])
    marks = np.flatnonzero(data[:-1] == 0xFF)
    after = data[marks + 1]
    restarts = marks[(after & 0xF8) == 0xD0]
    keep = np.ones(len(data), bool)
    keep[marks[after == 0] + 1] = keep[restarts] = keep[restarts + 1] = False
    place = np.cumsum(keep) - keep
    begins = np.sort(np.concatenate([starts[:-1], restarts + 2]))
    of = np.searchsorted(starts, begins, side="right") - 1
    at = place[begins] * 8
    bits = _Bits(data[keep])

    mcus = np.array([f.grid[0] * f.grid[1] for f in frames])
    step = np.array([f.interval or m for f, m in zip(frames, mcus)])
    first = (np.arange(len(begins)) - np.searchsorted(of, of)) * step[of]
    count = np.clip(mcus[of] - first, 0, step[of])
    per, offset = sum(k == 0 for k, _, _ in frame.mcu), np.cumsum([0, *mcus])
    out = np.zeros((int(offset[-1]) * per, 64), np.int16)
    predicted = np.zeros((len(begins), 1 + max(k for k, _, _ in frame.mcu)), np.int64)
    for m in range(int(count.max(initial=0))):
        live, luma = np.flatnonzero(count > m), 0
        for part, dc, ac in frame.mcu:
            row = (offset[of[live]] + first[live] + m) * per + luma
            pos = at[live]
            size, length = bits.symbol(pos, tables[dc])
            pos = pos + length
            predicted[live, part] += _signed(bits.value(pos, size), size)
            pos += size
            if part == 0:
                out[row, 0] = predicted[live, 0]
                luma += 1
            k, ends, who = np.ones(len(live), np.int64), np.zeros(len(live), np.int64), np.arange(len(live))
            while len(who):
                symbol, length = bits.symbol(pos, tables[16 + ac])
                pos = pos + length
                size, run = symbol & 15, symbol >> 4
                k = k + run
                coded = size > 0
                if (k[coded] > 63).any():
                    raise ValueError("a run beyond the block")
                value = _signed(bits.value(pos, size), size)
                if part == 0:
                    if coded.all():
                        out[row[who], k] = value
                    else:
                        out[row[who[coded]], k[coded]] = value[coded]
                pos += size
                k = np.where(coded | (run == 15), k + 1, 64)
                done = k > 63
                if done.any():
                    ends[who[done]] = pos[done]
                    who, k, pos = who[~done], k[~done], pos[~done]
            at[live] = ends
    return [out[a * per : b * per] for a, b in zip(offset, offset[1:])]


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """The mean luminance of each block, from its DC coefficient alone."""
    (wide, high), (h, v, _, _) = frame.grid, frame.sampling
    dc = coefficients[:, 0].astype(np.int64).reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    return np.clip(dc * frame.dc_step // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 places is darker than the next one to its right."""
    rows, columns = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    small = thumb[rows][:, columns]
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def decode_files(media: list[bytes | None]) -> list[tuple[Frame, np.ndarray] | None]:
    """Frame and coefficients of each file; None for null and for what isn't a sound baseline file."""
    groups: dict[tuple, list[int]] = {}
    out: list = [None] * len(media)
    frames: dict[int, Frame] = {}
    for i, m in enumerate(media):
        try:
            if m:
                frames[i] = f = parse_markers(m)
                groups.setdefault((f.tables, f.mcu), []).append(i)
        except (ValueError, KeyError, IndexError, struct.error):
            pass
    for group in groups.values():
        try:
            found = _scans([frames[i] for i in group], [media[i] for i in group])
        except (ValueError, KeyError, IndexError):
            if len(group) > 1:  # find the one at fault
                for i in group:
                    out[i] = decode_files([media[i]])[0]
            continue
        for i, c in zip(group, found):
            out[i] = (frames[i], c)
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media). Null text counts as empty; equal texts give equal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                n, files = _encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to features read back from the stored bytes.

    payload_bytes, payload_sha256 and tail_crc32 are of the payload, feature is width x height, thumbnail size, hash of
    brightness differences and crc32 of the thumbnail. Media that isn't a sound baseline file, or null, gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", max_bytes=3 << 20):
                rows, files = [], part.column("media").to_pylist()
                for data, got in zip(files, decode_files(files)):
                    stored = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                    if not got:
                        rows.append((None, None, None, *stored, None, None, None, None))
                        continue
                    frame, coefficients = got
                    held = coefficients if frame.blocks is None else coefficients[: frame.blocks]
                    payload = (held - 1).astype(np.uint8).tobytes()
                    thumb = thumbnail(frame, coefficients)
                    feature = f"{frame.width}x{frame.height}:{thumb.shape[1]}x{thumb.shape[0]}:{difference_hash(thumb):016x}:{zlib.crc32(thumb.tobytes()):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature, frame.width, frame.height, thumb.tobytes()))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], [x.split()[0] for x in DECODED.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)
