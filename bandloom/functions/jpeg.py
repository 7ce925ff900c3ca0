"""Baseline JPEG read down to its quantised coefficients, without decoding to pixels first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.dims import basis, zigzag


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    """What a file's markers say."""

    height: int = 0
    width: int = 0
    progressive: bool = False
    restart: int = 0
    scans: int = 0
    spectral: tuple[int, int, int] = (0, 63, 0)
    tables: dict[int, list[int]] = field(default_factory=dict)
    codes: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)
    data: bytes = b""


class JpegError(ValueError):
    pass


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next: the length of the code that they begin with times 256, plus its symbol; 0 for none.
    Codes of a length follow each other, and shorter ones come first, so each takes the next stretch of the table."""
    lengths = np.repeat(np.arange(1, 17), np.frombuffer(counts, dtype=np.uint8))
    values = lengths * 256 + np.frombuffer(symbols[: len(lengths)], dtype=np.uint8)
    table = np.repeat(values, 1 << (16 - lengths))[: 1 << 16]
    return [*table.tolist(), *[0] * ((1 << 16) - len(table))]


def parse(data: bytes) -> Picture:
    """Reads the segments of a file; entropy-coded data of the first scan is kept as it is."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG")
    p, at = Picture(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                values = [int.from_bytes(body[1 + i : 1 + i + wide // 64], "big") for i in range(0, wide, wide // 64)]
                p.tables[body[0] & 15], body = values, body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                p.codes[body[0] >> 4, body[0] & 15], body = _codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            p.progressive = marker == 0xC2
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            p.components = [Component(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError(f"unsupported frame {marker:#x}")
        elif marker == 0xDD:
            p.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            p.scans += 1
            for i in range(body[0]):
                for c in p.components:
                    if c.id == body[1 + 2 * i]:
                        c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            tail = body[1 + 2 * body[0] :]
            p.spectral = (tail[0], tail[1], tail[2])
            end = at
            while end + 1 < len(data) and (data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            if p.scans == 1:
                p.data = data[at:end]
            at = end
    return p


class _Bits:
    """Bits of entropy-coded data between two restart markers."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: list[int]) -> int:
        while self.n < 16:  # six bytes at a time; ones stand behind the end
            more = self.data[self.at : self.at + 6]
            self.held = self.held << 48 | int.from_bytes(more + b"\xff" * (6 - len(more)), "big")
            self.at, self.n = self.at + 6, self.n + 48
        found = codes[self.held >> (self.n - 16)]
        if not found:
            raise JpegError("no such code")
        self.n -= found >> 8
        self.held &= (1 << self.n) - 1
        return found & 255

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _segments(data: bytes) -> Iterator[bytes]:
    start = at = 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            yield data[start:at]
            start = at + 2
        at += 2
    yield data[start:]


def coefficients(p: Picture) -> list[np.ndarray]:
    """(rows, columns, 64) quantised coefficients in zig-zag order for each component of a baseline file with one full scan."""
    if p.progressive or p.scans != 1 or p.spectral != (0, 63, 0):
        raise JpegError("only baseline files with a single full scan can be read")
    if not p.components or not p.data:
        raise JpegError("no picture")
    hmax, vmax = max(c.h for c in p.components), max(c.v for c in p.components)
    across, down = -(-p.width // (8 * hmax)), -(-p.height // (8 * vmax))
    single = len(p.components) == 1
    if single:  # a scan of one component goes block by block
        c = p.components[0]
        c.h = c.v = 1
        across, down = -(-p.width // 8), -(-p.height // 8)
    out = [np.zeros((down * c.v, across * c.h, 64), dtype=np.int32) for c in p.components]
    segments = _segments(p.data)
    bits, before = _Bits(next(segments)), [0] * len(out)
    for mcu in range(across * down):
        if p.restart and mcu and mcu % p.restart == 0:
            bits, before = _Bits(next(segments, b"")), [0] * len(out)
        y, x = divmod(mcu, across)
        for k, c in enumerate(p.components):
            dc, ac = p.codes[0, c.dc], p.codes[1, c.ac]
            for b in range(c.h * c.v):
                block = out[k][y * c.v + b // c.h, x * c.h + b % c.h]
                before[k] += bits.signed(bits.symbol(dc))
                block[0], at = before[k], 1
                while at < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if not size and run != 15:
                        break
                    at += run
                    if size:
                        if at > 63:
                            raise JpegError("too many coefficients")
                        block[at] = bits.signed(size)
                    at += 1
    return out


def planes(p: Picture, parts: list[np.ndarray]) -> np.ndarray:
    """(3, height, width) RGB in 0..1: dequantised, inverse transformed, chrominance stretched bilinearly, grey repeated."""
    from bandloom.functions.transforms import resize_weights

    c8, order, out = basis(8), np.argsort(zigzag(8, 8)), []
    hmax, vmax = max(c.h for c in p.components), max(c.v for c in p.components)
    for c, q in zip(p.components, parts, strict=True):
        z = (q * np.array(p.tables[c.table]))[:, :, order].reshape(*q.shape[:2], 8, 8)
        plane = np.einsum("ki,abkl,lj->aibj", c8, z, c8).reshape(q.shape[0] * 8, q.shape[1] * 8) + 128
        plane = plane[: -(-p.height * c.v // vmax), : -(-p.width * c.h // hmax)]
        out.append(resize_weights(plane.shape[0], p.height, False) @ plane @ resize_weights(plane.shape[1], p.width, False).T)
    if len(out) == 1:
        return np.clip(np.stack(out * 3) / 255, 0, 1)
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]) / 255, 0, 1)


def decode_blocks(files: DataFrame, key: str = "source", content: str = "content") -> DataFrame:
    """Rows (key, component, block_row, block_col, coeffs in zig-zag order, error) of JPEG files, an error instead of blocks
    for a file that cannot be read."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, data in zip(batch[key], batch[content], strict=True):
                try:
                    parts = coefficients(parse(bytes(data)))
                except (JpegError, IndexError, KeyError) as e:
                    yield pd.DataFrame([(source, None, None, None, None, str(e) or type(e).__name__)], columns=names)
                    continue
                for i, part in enumerate(parts):
                    rows = [(source, i, y, x, part[y, x].tolist(), None) for y in range(part.shape[0]) for x in range(part.shape[1])]
                    yield pd.DataFrame(rows, columns=names)

    names = [key, "component", "block_row", "block_col", "coeffs", "error"]
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, component int, block_row int, block_col int, coeffs array<int>, error string")


def subsampling_key(components: Column, h: Column, v: Column) -> Column:
    """The usual name of a luminance sampling of h x v against chrominance of 1 x 1."""
    return F.when(components == 1, "grayscale").when(components != 3, "other").when((h == 2) & (v == 2), "4:2:0").when((h == 2) & (v == 1), "4:2:2").when((h == 1) & (v == 1), "4:4:4").otherwise("other")


def analysed(files: DataFrame, key: str = "source", content: str = "content") -> DataFrame:
    """Rows (key, height, width, subsampling, reason, blocks, zero_share): what each file is, and why it cannot be read, if so."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, data in zip(batch[key], batch[content], strict=True):
                p, reason, blocks, zeros = Picture(), None, None, None
                try:
                    p = parse(bytes(data))
                    parts = coefficients(p)
                    blocks = sum(x.shape[0] * x.shape[1] for x in parts)
                    zeros = sum(int((x == 0).sum()) for x in parts) / (64.0 * blocks)
                except (JpegError, IndexError, KeyError) as e:
                    reason = str(e) or type(e).__name__
                first = p.components[0] if p.components else Component(0, 0, 0, 0)
                rows.append((source, p.height or None, p.width or None, len(p.components), first.h, first.v, reason, blocks, zeros))
            yield pd.DataFrame(rows, columns=[key, *names]).astype(object)

    names = ["height", "width", "components", "h", "v", "reason", "blocks", "zero_share"]
    rows = files.select(key, content).mapInPandas(run, f"{key} {kind}, height int, width int, components int, h int, v int, reason string, blocks int, zero_share double")
    name = F.when(F.col("components") > 0, subsampling_key(F.col("components"), F.col("h"), F.col("v")))
    return rows.select(key, "height", "width", name.alias("subsampling"), "reason", "blocks", "zero_share")


def report(analysis: DataFrame) -> DataFrame:
    """Rows (subsampling, reason, files, blocks, zero_share) of analysed() files: their kinds, and why some cannot be read."""
    return analysis.groupBy("subsampling", "reason").agg(F.count("*").alias("files"), F.sum("blocks").alias("blocks"), (F.sum(F.col("zero_share") * F.col("blocks")) / F.sum("blocks")).alias("zero_share"))


def encode(parts: list[np.ndarray], sampling: list[tuple[int, int]], tables: list[list[int]], height: int, width: int, restart: int = 0, progressive: bool = False) -> bytes:
    """Quantised zig-zag blocks (rows, columns, 64) of each component as a baseline file, with codes of 8 bits for all symbols.

    sampling: (h, v) of each component; tables: quantisation tables. progressive: only marks the frame, as what cannot be read.
    """

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    out = b"\xff\xd8" + b"".join(segment(0xDB, bytes([i]) + bytes(int(v) for v in t)) for i, t in enumerate(tables))
    n = len(parts)
    out += segment(0xC2 if progressive else 0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, min(i, len(tables) - 1)]) for i, (h, v) in enumerate(sampling)))
    symbols = [r << 4 | s for r in range(16) for s in range(11)]
    for kind in (0, 1):
        used = range(12) if kind == 0 else symbols
        out += segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [len(used)] + [0] * 8) + bytes(used))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00")
    bits, data = "", b""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        bits = ""
        return raw.replace(b"\xff", b"\xff\x00")

    def put(value, size):
        nonlocal bits
        if size:
            bits += format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b")

    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    before, marks = [0] * n, 0
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            data += flush() + bytes([0xFF, 0xD0 + marks % 8])
            before, marks = [0] * n, marks + 1
        y, x = divmod(mcu, across)
        for k, (h, v) in enumerate(sampling):
            for b in range(h * v):
                block = parts[k][y * v + b // h, x * h + b % h].tolist()
                d = block[0] - before[k]
                before[k] = block[0]
                size = abs(d).bit_length()
                bits += format(size, "08b")
                put(d, size)
                run = 0
                last = max([i for i in range(1, 64) if block[i]], default=0)
                for i in range(1, last + 1):
                    if not block[i]:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(symbols.index(0xF0), "08b")
                        run -= 16
                    size = abs(block[i]).bit_length()
                    bits += format(symbols.index(run << 4 | size), "08b")
                    put(block[i], size)
                    run = 0
                if last < 63:
                    bits += format(symbols.index(0), "08b")
    return out + data + flush() + b"\xff\xd9"
