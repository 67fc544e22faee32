"""Baseline JPEG: a marker parser, a vectorized Huffman decoder of scans, thumbnails of DC values, and a writer whose
thumbnails hold bytes exactly.

A block of 8 x 8 samples of one value v has the quantized DC value v - 128 (quantizer 8) and no AC values, so an image
made of such blocks keeps one byte a block without loss, and its DC thumbnail is those bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

BLOCKS = 64  # blocks a row, one restart interval
MAX_ROWS = 8191  # block rows of an image: its height is 16 bits
UNIT = 64
#: Code lengths of our DC categories 0 to 8; of the only AC symbol, end of block, 1.
DC_SIZES = {0: 3, 1: 5, 2: 5, 3: 4, 4: 3, 5: 2, 6: 2, 7: 4, 8: 5}
#: Order of coefficients in a block.
ZIGZAG_DC = 0


def canonical(sizes: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length 1 to 16, symbols, and symbol -> (code, length), of a canonical Huffman code."""
    symbols = sorted(sizes, key=lambda s: (sizes[s], s))
    counts = [sum(sizes[s] == n for s in symbols) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= sizes[s] - last
        last = sizes[s]
        codes[s] = (code, last)
        code += 1
    return counts, symbols, codes


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = canonical(DC_SIZES)


def _emit_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255: category code, extra bits, end of block."""
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        code, n = _DC_CODES[cat]
        extra = diff if diff >= 0 else diff + (1 << cat) - 1
        bits[diff + 255] = ((code << cat) | extra) << 1
        sizes[diff + 255] = n + cat + 1
    return bits, sizes


_BITS, _SIZES = _emit_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, BLOCKS * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
            _segment(0xDD, struct.pack(">H", BLOCKS)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as one JPEG, or as several one after another beyond 8191 rows.

    All payloads are coded together: rows of 64 blocks are restart intervals, so every row starts afresh.
    """
    data = np.frombuffer(b"".join(payloads), np.uint8)
    rows = data.reshape(-1, BLOCKS).astype(np.int16)
    diff = np.diff(rows, axis=1, prepend=np.int16(128)) + 255
    size = _SIZES[diff]
    at = np.cumsum(size, axis=1) - size
    used = -(-(at[:, -1] + size[:, -1]) // 8)
    start = np.cumsum(used) - used
    pos = (at + (start * 8)[:, None]).ravel()
    size = size.ravel()
    word = _BITS[diff.ravel()] << (24 - (pos & 7) - size).astype(np.uint32)
    out = np.zeros(int(used.sum()) + 3, np.float64)
    byte = pos >> 3
    for k in range(3):  # no two codes share a bit, so sums are unions
        out += np.bincount(byte + k, weights=(word >> np.uint32(16 - 8 * k)) & 255, minlength=len(out))
    out = out[:-3].astype(np.uint8)
    # Rows are padded with ones.
    spare = used * 8 - (at[:, -1] + size.reshape(rows.shape)[:, -1])
    out[start + used - 1] |= ((1 << spare) - 1).astype(np.uint8)
    stuffed = out == 255
    extra = np.add.reduceat(stuffed, start)  # zero bytes after 0xFF
    images: list[bytes] = []
    shift = np.cumsum(stuffed) - stuffed
    row_of = np.repeat(np.arange(len(used)), used)
    place = np.arange(len(out)) + shift + 2 * row_of
    whole = np.zeros(int(len(out) + stuffed.sum() + 2 * len(used)), np.uint8)
    whole[place] = out
    ends = np.cumsum(used + extra + 2)
    whole[ends - 2] = 255
    row = 0
    for p in payloads:
        parts, n = [], len(p) // BLOCKS
        for first in range(0, n, MAX_ROWS):
            k = min(MAX_ROWS, n - first)
            a, b = row + first, row + first + k
            marks = ends[a:b] - 1
            whole[marks] = 0xD0 + np.arange(k) % 8
            whole[marks[-1]] = 0xD9
            parts += [_head(k), whole[(ends[a - 1] if a else 0) : ends[b - 1]].tobytes()]
        row += n
        images.append(b"".join(parts))
    return images


class Image:
    """What the markers of one baseline JPEG say: size, components, tables, and the entropy-coded intervals."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.interval, self.components, self.data, self.tables = 0, [], data, []
        at += 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide == 128 else np.uint8).astype(np.int64)
                    body = body[1 + wide :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("8-bit samples only")
                self.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                self.tables.append(body)
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                for i in range(body[0]):
                    for c in self.components:
                        if c[0] == body[1 + 2 * i]:
                            c[4], c[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                break
        self._scan(at)

    def _scan(self, at: int) -> None:
        """Intervals between restart markers, zero bytes after 0xFF left out; end: where the image ends."""
        data = np.frombuffer(self.data, np.uint8, offset=at)
        ff = np.flatnonzero(data[:-1] == 255)
        after = data[ff + 1]
        marks = ff[(after != 0) & (after != 255)]
        codes = data[marks + 1]
        stop = np.flatnonzero((codes < 0xD0) | (codes > 0xD7))
        if not len(stop):
            raise ValueError("scan without end")
        marks = marks[: stop[0] + 1]
        self.end = at + int(marks[-1]) + 2
        keep = np.ones(int(marks[-1]), bool)
        zero = ff[after == 0] + 1
        keep[zero[zero < len(keep)]] = False
        for k in (0, 1):
            keep[(marks[:-1] + k)] = False
        kept = np.cumsum(keep)
        self.bytes = data[: len(keep)][keep]
        ends = kept[np.maximum(marks - 1, 0)] if len(keep) else np.zeros(len(marks), np.int64)
        self.bounds = np.concatenate([[0], ends])

    def plan(self) -> tuple[np.ndarray, int]:
        """Component of each block of an MCU, and the number of MCUs."""
        if len(self.components) == 1:
            return np.zeros(1, np.int64), -(-self.width // 8) * -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        order = [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]
        return np.array(order), -(-self.width // (8 * h)) * -(-self.height // (8 * v))


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that a code may start; length 0 where none does."""
    sym, size = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int16)
    code, k = 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            sym[a:b], size[a:b] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return sym, size


def dc_values(images: list[Image]) -> list[np.ndarray]:
    """Quantized DC values in scan order, of images with equal tables: all their intervals advance together, a symbol a
    step, AC values being skipped."""
    first = images[0]
    order, _ = first.plan()
    tables = [(first.huffman[c[4]], first.huffman[0x10 | c[5]]) for c in first.components]
    buf = np.concatenate([*(x.bytes for x in images), np.full(8, 255, np.uint8)]).astype(np.uint32)
    wide = (buf[:-4].astype(np.uint64) << np.uint64(24)) | (buf[1:-3] << np.uint32(16)) | (buf[2:-2] << np.uint32(8)) | buf[3:-1]
    base, pos, todo, where, total = 0, [], [], [], 0
    for x in images:
        blocks = x.plan()[1] * len(order)
        step = x.interval * len(order) or blocks
        n = len(x.bounds) - 1
        pos.append((base + x.bounds[:-1]) * 8)
        left = np.minimum(step, blocks - step * np.arange(n))
        todo.append(left)
        where.append(total + step * np.arange(n))
        base, total = base + len(x.bytes), total + blocks
    pos, todo, where = np.concatenate(pos), np.concatenate(todo), np.concatenate(where)
    out = np.zeros(total, np.int32)
    last = np.zeros((len(pos), len(first.components)), np.int32)
    done = np.zeros(len(pos), np.int64)
    k = np.zeros(len(pos), np.int64)  # next coefficient; 0: DC
    live = np.flatnonzero(todo > 0)
    single = len(tables) == 1

    def peek(p: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (wide[np.minimum(p >> 3, len(wide) - 1)] >> (32 - (p & 7) - n).astype(np.uint64)) & ((np.uint64(1) << np.asarray(n, np.uint64)) - np.uint64(1))

    while len(live):
        comp = order[done[live] % len(order)]
        dc = k[live] == 0
        for c in range(len(tables)):
            for is_dc in (True, False):
                mine = live[(dc == is_dc) & (single or comp == c)] if not (single and dc.all() == is_dc and (dc.all() or not dc.any())) else live
                if not len(mine):
                    continue
                sym, size = tables[c][0 if is_dc else 1]
                p = pos[mine]
                head = peek(p, 16).astype(np.int64)
                s, n = sym[head].astype(np.int64), size[head].astype(np.int64)
                if not n.all():
                    raise ValueError("bad code")
                p = p + n
                bits = s if is_dc else s & 15
                if is_dc:
                    raw = peek(p, bits).astype(np.int64)
                    diff = np.where((bits > 0) & (raw < (1 << np.maximum(bits - 1, 0))), raw - (1 << bits) + 1, raw)
                    last[mine, c] += diff.astype(np.int32)
                    out[where[mine] + done[mine]] = last[mine, c]
                    k[mine] = 1
                else:
                    run = s >> 4
                    stop = (bits == 0) & (run < 15)
                    k[mine] = np.where(stop, 64, k[mine] + run + 1)
                    over = mine[k[mine] >= 64]
                    done[over] += 1
                    k[over] = 0
                pos[mine] = p + bits
        live = live[done[live] < todo[live]]
    ends = np.cumsum([x.plan()[1] * len(order) for x in images])
    return np.split(out, ends[:-1])


def _dc_by_group(images: list[Image], bound: int = 1 << 21) -> Iterator[np.ndarray]:
    """dc_values of runs of images with equal tables, up to `bound` bytes at a time."""
    i = 0
    while i < len(images):
        j, held, key = i, 0, (images[i].tables, images[i].components)
        while j < len(images) and (j == i or held < bound and (images[j].tables, images[j].components) == key):
            held += len(images[j].bytes)
            j += 1
        yield from dc_values(images[i:j])
        i = j


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """One sample, 0 to 255, for each luminance block of each image, from its DC value alone."""
    out = []
    for x, dc in zip(images, _dc_by_group(images), strict=True):
        order, mcus = x.plan()
        comp = x.components[0]
        luma = dc.reshape(mcus, -1)[:, order == 0]
        value = np.clip((luma * x.quant[comp[3]][ZIGZAG_DC] + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
        if len(order) == 1:
            out.append(value.reshape(-1, -(-x.width // 8)))
        else:
            across = -(-x.width // (8 * max(c[1] for c in x.components)))
            grid = value.reshape(-1, across, comp[2], comp[1]).transpose(0, 2, 1, 3)
            grid = grid.reshape(grid.shape[0] * comp[2], across * comp[1])
            out.append(grid[: -(-x.height // 8), : -(-x.width // 8)])
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are at least as bright as their mean."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    box = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    mean = box / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return f"{int.from_bytes(np.packbits(mean >= mean.mean()).tobytes(), 'big'):016x}"


def features(streams: list[bytes]) -> list[tuple[int, int, str, np.ndarray]]:
    """(width, height, thumbnail hash, thumbnail) of each stream of one or more JPEGs one below the other, as parsed
    and decoded from its bytes."""
    parsed: list[list[Image]] = []
    for s in streams:
        images, at = [], 0
        while at < len(s):
            images.append(Image(s, at))
            at = images[-1].end
        parsed.append(images)
    flat = [x for images in parsed for x in images]
    thumbs = iter(thumbnails(flat))
    out = []
    for images in parsed:
        parts = [next(thumbs) for _ in images]
        thumb = parts[0] if len(parts) == 1 else np.concatenate(parts)
        out.append((images[0].width, sum(x.height for x in images), average_hash(thumb), thumb))
    return out


def _record(doc, n: int, stream: bytes, feature) -> tuple:
    width, height, print_, thumb = feature
    payload = thumb.tobytes()
    return (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), f"{width}x{height} {print_}", width, height)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def media(docs: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text): the text's UTF-8 bytes, zeros added up to a positive multiple of 64,
    are stored as a JPEG of one byte a block, which is parsed and decoded again; all values but n_bytes come from the
    stored form. Texts are coded together up to `chunk` bytes.

    Null and empty texts are 64 zeros with n_bytes 0; equal texts have equal values; null doc_id is kept; an empty
    table gives an empty result; other columns are not looked at.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")]

        def flush(waiting: list) -> Iterator:
            step = MAX_ROWS * BLOCKS
            streams = encode([p for _, _, p in waiting]) if len(waiting) > 1 else [b"".join(encode([waiting[0][2][i : i + step]])[0] for i in range(0, len(waiting[0][2]), step))]
            rows = [_record(doc, n, s, f) for (doc, n, _), s, f in zip(waiting, streams, features(streams), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            waiting, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                payload = raw + bytes(-len(raw) % UNIT if raw else UNIT)
                waiting.append((doc, len(raw), payload))
                held += len(payload)
                if len(payload) >= chunk and len(waiting) > 1:
                    yield from flush(waiting[:-1])
                    waiting = waiting[-1:]
                if held >= chunk:
                    yield from flush(waiting)
                    waiting, held = [], 0
            if waiting:
                yield from flush(waiting)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA)
