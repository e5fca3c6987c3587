"""Lossless JPEG (ITU-T T.81, process 14): frames of 2 to 16 bits, one to four components.

Samples are predicted from their neighbours; the differences' sizes are Huffman-coded and
followed by their bits. ``encode`` works on whole arrays, ``decode`` walks the bit stream. As
DataFrame operators, one frame per row goes through Arrow: ``encode_frames`` and ``decode_frames``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class JpegError(ValueError):
    """Not a lossless JPEG stream that can be read."""


def predictions(x: np.ndarray, selection: int, bits: int) -> np.ndarray:
    """Predicted values of samples (h, w, components): left on the first row, above in the first column."""
    a, b, c = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    a[:, 1:], b[1:], c[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    rules = {1: lambda: a, 2: lambda: b, 3: lambda: c, 4: lambda: a + b - c, 5: lambda: a + ((b - c) >> 1), 6: lambda: b + ((a - c) >> 1), 7: lambda: (a + b) >> 1}
    p = rules[selection]().copy()
    p[0] = a[0]
    p[:, 0] = b[:, 0]
    p[0, 0] = 1 << (bits - 1)
    return p


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most 16 bits for the symbols that occur; the all-ones code stays free."""
    symbols = np.flatnonzero(counts)
    weights = [(int(counts[s]), (int(s),)) for s in symbols] + [(0, (-1,))]  # -1 takes the longest, all-ones code
    depth = {s: 0 for _, group in weights for s in group}
    while len(weights) > 1:
        weights.sort(key=lambda v: (-v[0], v[1]))
        (n, a), (m, b) = weights.pop(), weights.pop()
        for s in a + b:
            depth[s] += 1
        weights.append((n + m, a + b))
    order = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
    lengths = np.zeros(17, np.int64)  # how many codes have each length
    wide = np.zeros(64, np.int64)
    for s in depth:
        wide[depth[s]] += 1
    for n in range(63, 16, -1):  # move pairs of too long codes up, as the standard does
        while wide[n]:
            j = n - 2
            while not wide[j]:
                j -= 1
            wide[n] -= 2
            wide[n - 1] += 1
            wide[j + 1] += 2
            wide[j] -= 1
    last = max(n for n in range(17) if wide[n])
    wide[last] -= 1  # the reserved code
    lengths[:] = wide[:17]
    out = np.zeros(len(counts), np.int64)
    at = iter(order)
    for n in range(1, 17):
        for _ in range(lengths[n]):
            out[next(at)] = n
    return out


def codes(lengths_by_symbol: np.ndarray, order: list[int]) -> np.ndarray:
    """Canonical codes in the order of the table."""
    out = np.zeros(len(lengths_by_symbol), np.int64)
    code, n = 0, 0
    for s in order:
        code <<= int(lengths_by_symbol[s]) - n
        n = int(lengths_by_symbol[s])
        out[s] = code
        code += 1
    return out


def encode(samples: np.ndarray, bits: int, selection: int = 1) -> bytes:
    """A stream of samples (h, w) or (h, w, components)."""
    x = np.asarray(samples, np.int64)
    x = x[:, :, None] if x.ndim == 2 else x
    h, w, parts = x.shape
    d = (x - predictions(x, selection, bits)).reshape(-1)
    d = ((d + 32768) & 0xFFFF) - 32768
    size = np.where(d == -32768, 16, np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64))
    lengths = code_lengths(np.bincount(size, minlength=17))
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    extra = np.where(size == 16, 0, size)
    value = (codes(lengths, order)[size] << extra) | np.where(d < 0, d - 1, d) & ((1 << extra) - 1)
    total = lengths[size] + extra
    flags = np.repeat(value, total) >> (np.repeat(np.cumsum(total), total) - 1 - np.arange(total.sum())) & 1
    flags = np.concatenate([flags, np.ones(-len(flags) % 8, np.int64)]).astype(np.uint8)
    body = np.packbits(flags).tobytes().replace(b"\xff", b"\xff\x00")
    table = bytes([0]) + bytes(int((lengths == n).sum()) for n in range(1, 17)) + bytes(order)
    frame = struct.pack(">BHHB", bits, h, w, parts) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(parts))
    scan = bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + bytes([selection, 0, 0])
    part = lambda marker, content: struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content
    return b"\xff\xd8" + part(0xC3, frame) + part(0xC4, table) + part(0xDA, scan) + body + b"\xff\xd9"


def _segments(data: bytes) -> tuple[dict, bytes]:
    """Frame, tables and scan of a stream, and its entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start")
    found: dict = {"tables": {}}
    at = 2
    while at + 4 <= len(data):
        mark, kind, size = struct.unpack_from(">BBH", data, at)
        if mark != 0xFF:
            raise JpegError("no marker")
        content = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC3:
            found["bits"], found["h"], found["w"], n = struct.unpack_from(">BHHB", content)
            found["ids"] = [content[6 + 3 * k] for k in range(n)]
        elif kind == 0xC4:
            k = 0
            while k < len(content):
                counts = content[k + 1 : k + 17]
                found["tables"][content[k] & 15] = (counts, content[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif kind == 0xDA:
            n = content[0]
            found["use"] = {content[1 + 2 * k]: content[2 + 2 * k] >> 4 for k in range(n)}
            found["selection"], found["shift"] = content[1 + 2 * n], content[3 + 2 * n] & 15
            end = data.find(b"\xff\xd9", at)
            return found, data[at : end if end >= 0 else len(data)]
        elif 0xC0 <= kind <= 0xCF:
            raise JpegError("not lossless")
    raise JpegError("no scan")


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16-bit window: code length << 8 | symbol, 0 if there is no such code."""
    table = [0] * 65536
    code, at = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            first = code << (16 - n)
            table[first : first + (1 << (16 - n))] = [n << 8 | symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (h, w, components) and their bits."""
    found, body = _segments(data)
    if "h" not in found or not 1 <= found["selection"] <= 7:
        raise JpegError("no frame")
    h, w, parts, bits, selection = found["h"], found["w"], len(found["ids"]), found["bits"] - found["shift"], found["selection"]
    tables = [_lookup(*found["tables"][found["use"][i]]) for i in found["ids"]]
    body = body.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
    stream, held, at = 0, 0, 0
    out = [[0] * (w * parts) for _ in range(h)]
    above: list[int] = []
    for y in range(h):
        row = out[y]
        for k in range(w * parts):
            if held < 32:
                stream = (stream & ((1 << held) - 1)) << 32 | int.from_bytes(body[at : at + 4].ljust(4, b"\xff"), "big")
                held, at = held + 32, at + 4
            entry = tables[k % parts][stream >> (held - 16) & 0xFFFF]
            if not entry:
                raise JpegError("no such code")
            held -= entry >> 8
            size = entry & 255
            if not size:
                d = 0
            elif size == 16:
                d = 32768
            else:
                held -= size
                d = stream >> held & ((1 << size) - 1)
                if d < 1 << (size - 1):
                    d += 1 - (1 << size)
            x = k - parts
            if y == 0:
                p = row[x] if x >= 0 else 1 << (bits - 1)
            elif x < 0:
                p = above[k]
            elif selection == 1:
                p = row[x]
            elif selection == 2:
                p = above[k]
            elif selection == 3:
                p = above[x]
            elif selection == 4:
                p = row[x] + above[k] - above[x]
            elif selection == 5:
                p = row[x] + ((above[k] - above[x]) >> 1)
            elif selection == 6:
                p = above[k] + ((row[x] - above[x]) >> 1)
            else:
                p = (row[x] + above[k]) >> 1
            row[k] = (p + d) & 0xFFFF
        if at > len(body) + 8:
            raise JpegError("cut short")
        above = row
    return (np.array(out, np.int64) << found["shift"]).reshape(h, w, parts), found["bits"]


def encode_frames(dense: DataFrame, bits: int, selection: int = 1) -> DataFrame:
    """frame, payload of dense frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(np.asarray(d.values).reshape(h, w), bits, selection) for h, w, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.binary())], names=["frame", "payload"])

    return dense.select("frame", "h", "w", "data").mapInArrow(run, "frame long, payload binary")


def decode_frames(payloads: DataFrame) -> DataFrame:
    """Dense frames of (frame, payload); components lie side by side in a row, as cameras store them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, _ = decode(payload)
                flat = x.reshape(x.shape[0], -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([frame], pa.int64()), pa.array([flat.shape[0]], pa.int32()), pa.array([flat.shape[1]], pa.int32()), pa.array([flat.reshape(-1)], pa.list_(pa.int64()))],
                    names=["frame", "h", "w", "data"],
                )

    return payloads.select("frame", "payload").mapInArrow(run, "frame long, h int, w int, data array<bigint>")
