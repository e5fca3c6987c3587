"""Order-preserving packing of token streams into sequences by dynamic programming.

Documents are laid end to end in the order in which they are read. Windows cover this stream
without gaps; a window's end costs nothing at a document's end, SENTENCE_CUT at a sentence's
end and INSIDE_CUT elsewhere, and a window shorter than the sequence costs its padding. The
least total is found by the recurrence

    best(j) = cut(j) + length - j + min { best(i) + i : j - length <= i < j }

over the possible cuts j, with the minimum kept in a monotone queue. Inside a sentence a cut is
possible every INSIDE_STEP tokens, so a window always fits. The rest of a partition, shorter
than one sequence, is dealt out to sequences whose lengths are powers of two, which need no
padding. Nothing is dropped: every id of a document, its end id included, is in one piece.

No shuffle: each input partition is packed by itself in one streaming pass that holds one block
of tokens. A sequence id is the partition's number (high bits) and a running number.

Cases: null or empty text = just the end id; documents longer than a block are carried through
blocks in pieces; repeated rows are packed once for each row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import VOCABULARY, ByteBpe, encoder
from .common import lean, pick, table, tokenizer_path, utf8

SEQUENCE = 2048
END_ID = 1
SENTENCE_CUT = 1.0
INSIDE_CUT = 64.0
INSIDE_STEP = 16
#: Tokens planned at once; the last sequences of a block are planned again with the next one.
BLOCK = 1 << 19
#: Bits of a sequence id below the partition's number.
RUNNING_BITS = 40


def sentence_ends(bpe: ByteBpe) -> np.ndarray:
    """For each id, whether its token ends a sentence or a line."""
    return np.array([b.endswith((b".", b"!", b"?")) or b"\n" in b for b in bpe.bytes_of])


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The possible cuts of a stream (positions after ids, ascending) and their penalties."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[1:][ends[ids]] = SENTENCE_CUT
    cost[doc_ends] = 0.0
    cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(at, prepend=0)
    for k in np.flatnonzero(gaps > INSIDE_STEP).tolist():
        inside = np.arange(at[k] - gaps[k] + INSIDE_STEP, at[k], INSIDE_STEP)
        cost[inside] = INSIDE_CUT
    at = np.flatnonzero(np.isfinite(cost[1:])) + 1
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, length: int = SEQUENCE) -> list[int]:
    """The window ends of least total cost that cover the stream up to its last cut."""
    where, pay = [0, *at.tolist()], [0.0, *cost.tolist()]
    best, back = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best(i) + i, i's position, i's index
    for k in range(1, len(where)):
        j = where[k]
        while queue[0][1] < j - length:
            queue.popleft()
        value, _, i = queue[0]
        best[k] = b = pay[k] + length - j + value
        back[k] = i
        b += j
        while queue and queue[-1][0] >= b:
            queue.pop()
        queue.append((b, j, k))
    out, k = [], len(where) - 1
    while k:
        out.append(where[k])
        k = back[k]
    return out[::-1]


def powers(start: int, end: int) -> list[int]:
    """Ends of sequences from start to end whose lengths are falling powers of two."""
    out, rest = [], end - start
    while rest:
        step = 1 << (rest.bit_length() - 1)
        start, rest = start + step, rest - step
        out.append(start)
    return out


class Packer:
    """Takes documents one by one, gives pieces block by block."""

    def __init__(self, ends: np.ndarray, first_sequence: int, length: int = SEQUENCE, block: int = BLOCK):
        self.ends, self.sequence, self.length, self.block = ends, first_sequence, length, max(block, 4 * length)
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # document, its ids before this part, its ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        for start in range(0, len(ids), self.block):
            part = ids[start : start + self.block]
            self.ids.append(part)
            self.docs.append((doc_id, start, len(ids)))
            self.held += len(part)
            if self.held >= self.block:
                yield self._pack(last=False)

    def finish(self) -> list[tuple]:
        return self._pack(last=True) if self.held else []

    def _pack(self, last: bool) -> list[tuple]:
        stream = np.concatenate(self.ids)
        doc_ends = np.cumsum([len(x) for x in self.ids])
        whole = np.array([start + len(x) == total for x, (_, start, total) in zip(self.ids, self.docs)])
        windows = plan(*cut_points(stream, doc_ends[whole], self.ends), self.length)
        if last:
            if windows[-1] - (windows[-2] if len(windows) > 1 else 0) < self.length:
                start = windows[-2] if len(windows) > 1 else 0
                windows[-1:] = powers(start, windows[-1])
        else:
            kept = [w for w in windows if w <= len(stream) - 2 * self.length]
            windows = kept or windows[:1]
        bounds = np.concatenate([[0], doc_ends])
        pieces = self._pieces(stream, bounds, windows)
        self._carry(bounds, windows[-1])
        return pieces

    def _pieces(self, stream: np.ndarray, bounds: np.ndarray, windows: list[int]) -> list[tuple]:
        raw = memoryview(np.ascontiguousarray(stream, "<u4")).cast("B")
        out, d, start = [], 0, 0
        for end in windows:
            a = start
            while a < end:
                while bounds[d + 1] <= a:
                    d += 1
                b = min(int(bounds[d + 1]), end)
                doc, before, total = self.docs[d]
                crc = zlib.crc32(raw[4 * a : 4 * b])
                out.append((doc, before + a - int(bounds[d]), b - a, crc, total, self.sequence, a - start))
                a = b
            self.sequence += 1
            start = end
        return out

    def _carry(self, bounds: np.ndarray, done: int) -> None:
        ids, docs = [], []
        for x, (doc, before, total), a in zip(self.ids, self.docs, bounds.tolist()):
            if a + len(x) > done:
                skip = max(0, done - a)
                ids.append(x[skip:])
                docs.append((doc, before + skip, total))
        self.ids, self.docs, self.held = ids, docs, sum(map(len, ids))


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def pack(df: DataFrame, key: str, text: str, vocabulary: str, length: int = SEQUENCE, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document in a sequence; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        packer = Packer(sentence_ends(bpe), TaskContext.get().partitionId() << RUNNING_BITS, length, block)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([bpe.encode(value.as_py().decode("utf-8", "replace")), end])
                for pieces in packer.add(doc_id, ids):
                    yield _batch(pieces)
        yield _batch(packer.finish())

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, SCHEMA)


def op8(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return pack(docs, "doc_id", "text", tokenizer_path(VOCABULARY))
