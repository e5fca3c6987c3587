"""BPE encoding and decoding by tree concatenation.

A text of more than LEAF characters, or with a long run that the pre-tokenizer doesn't split, is
halved until its parts are leaves, the leaves are encoded on their own (from PARALLEL characters
on in THREADS parallel threads; the encoder releases the interpreter lock), and neighbours are
joined by re-encoding a window around the join that grows until both sides agree exactly:

* Cutting before white space that follows something else never changes the pre-tokenizer's
  splits, so a window between two such sure cuts is exact at once.
* Inside a long run without sure cuts (one pre-token), a token sequence is the BPE encoding
  if and only if every adjacent pair of tokens is; a window whose first and last tokens equal
  those of the sides makes every pair valid.

Leaves are encoded with the same vocabulary by rank (the tiktoken library), which is several
times faster than the tokenizers library and gives the same ids; the special token's text is
split off first, as the tokenizers library does. The tests hold both against that library.

Cases: null = empty text, no ids, sha256 of nothing; invalid UTF-8 decodes with U+FFFD.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import lean, pick, table, tokenizer_path, utf8

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more characters are halved.
LEAF = 1 << 12
#: Pre-tokens of more characters are encoded as halves, too.
RUN = 1 << 9
#: Parts of a long text that are encoded at the same time; in shorter texts, handing over costs more than it saves.
THREADS = 2
PARALLEL = 1 << 15
#: Ids digested at once.
STEP = 1 << 18
#: The split pattern of this vocabulary (a fixed value, as in its file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SURE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")
_NO_IDS = np.empty(0, np.uint32)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _has_long_run(text: str) -> bool:
    """Whether RUN characters follow each other that are all white space or none of them."""
    return max(map(len, text.split()), default=0) >= RUN or regex.search(rf"\s{{{RUN}}}", text) is not None


class ByteBpe:
    """A byte-level BPE vocabulary file with its encoder and decoder."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = THREADS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.leaf, self.threads = leaf, threads
        self._pool: ThreadPoolExecutor | None = None
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.text_of = [str(i) for i in range(self.size)]
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    # -- encoding -----------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, the special tokens' texts as special ids."""
        if self.splits is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = [
            np.array([self.special[p]], np.uint32) if p in self.special else self._plain(p)
            for p in self.splits.split(text)
            if p
        ]
        return np.concatenate(parts) if parts else _NO_IDS

    def _plain(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf and (len(text) <= RUN or not _has_long_run(text)):
            return self._leaf(text)
        return self._tree(text)

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def _tree(self, text: str) -> np.ndarray:
        cuts = [0]
        self._cut(text, 0, len(text), cuts)
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        if self.threads > 1 and len(leaves) > 1 and len(text) >= PARALLEL:
            self._pool = self._pool or ThreadPoolExecutor(self.threads)
            share = -(-len(leaves) // self.threads)  # one stretch of the text for each thread
            parts = self._pool.map(lambda k: [self._leaf(x) for x in leaves[k : k + share]], range(0, len(leaves), share))
            ids = [x for part in parts for x in part]
        else:
            ids = [self._leaf(x) for x in leaves]
        nodes = list(zip(leaves, ids))
        while len(nodes) > 1:  # level by level: the tree's height is the logarithm of the leaves
            joined = [self.join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
            nodes = joined + nodes[len(nodes) & ~1 :]
        return nodes[0][1]

    def _cut(self, text: str, start: int, end: int, cuts: list[int]) -> None:
        """Append the ends of the leaves of text[start:end], in order."""
        stack = [(start, end)]
        while stack:
            a, b = stack.pop()
            if b - a <= self.leaf and not (b - a > RUN and _has_long_run(text[a:b])):
                cuts.append(b)
                continue
            middle = (a + b) // 2
            near = _SURE.search(text, middle, min(b, middle + RUN))
            middle = near.start() if near and a < near.start() < b else middle
            stack += [(middle, b), (a, middle)]

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """The text and ids of two encoded neighbours."""
        (lt, li), (rt, ri) = left, right
        text = lt + rt
        if not lt or not rt:
            return text, np.concatenate([li, ri])
        s, e = self._last_sure(lt, rt), self._first_sure(lt, rt)
        tail, head = len(lt[s:].encode()), len(rt[:e].encode())
        ends = np.cumsum(self.length_of[li[::-1]])
        keep = len(li) - (0 if not tail else int(np.searchsorted(ends, tail)) + 1)
        starts = np.cumsum(self.length_of[ri])
        drop = 0 if not head else int(np.searchsorted(starts, head)) + 1
        if len(lt) - s + e <= 2 * RUN:
            middle = self._leaf(lt[s:] + rt[:e])
        else:
            middle = self._grow(li[keep:], ri[:drop])
        return text, np.concatenate([li[:keep], middle, ri[drop:]])

    @staticmethod
    def _last_sure(lt: str, rt: str) -> int:
        """The last place in the left text, its end included, where a cut is sure; else 0."""
        if _SURE.search(lt[-1] + rt[0], 1):
            return len(lt)
        n = 64
        while True:
            at = max(0, len(lt) - n)
            found = [m.start() for m in _SURE.finditer(lt, at)]
            if found or not at:
                return found[-1] if found else 0
            n *= 4

    @staticmethod
    def _first_sure(lt: str, rt: str) -> int:
        if _SURE.search(lt[-1] + rt[0], 1):
            return 0
        m = _SURE.search(rt)
        return m.start() if m else len(rt)

    def _grow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a stretch between sure cuts, from those of its two sides."""
        k = 8
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            while a and not self._starts_character(left[a]):
                a -= 1
            while b < len(right) and not self._starts_character(right[b]):
                b += 1
            if not a and b == len(right):
                return self._leaf(self.decode_bytes(np.concatenate([left, right])).decode())
            window = self._leaf(self.decode_bytes(np.concatenate([left[a:], right[:b]])).decode())
            m = min(2, len(window))
            left_agrees = not a or (len(left) - a >= m and np.array_equal(window[:m], left[a : a + m]))
            right_agrees = b == len(right) or (b >= m and np.array_equal(window[-m:], right[b - m : b]))
            if left_agrees and right_agrees and len(window) >= 2 * m:
                return np.concatenate([left[:a], window, right[b:]])
            k *= 2

    def _starts_character(self, token: int) -> bool:
        return (self.bytes_of[token][0] & 0xC0) != 0x80

    # -- decoding -----------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """sha256 of the decimal ids joined by commas, and of the decoded text, in steps of bounded size."""
        listed, decoded = hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for start in range(0, len(ids), STEP):
            part = ids[start : start + STEP].tolist()
            listed.update((("," if start else "") + ",".join(map(self.text_of.__getitem__, part))).encode())
            decoded.update(decoder.decode(b"".join(map(self.bytes_of.__getitem__, part))).encode())
        decoded.update(decoder.decode(b"", final=True).encode())
        return listed.hexdigest(), decoded.hexdigest()


@functools.lru_cache(4)
def encoder(path: str, leaf: int = LEAF, threads: int = THREADS) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path, leaf, threads)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str, leaf: int = LEAF, threads: int = THREADS) -> DataFrame:
    """Per row: key, n_tokens, digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, leaf, threads)
        for batch in batches:
            out: list[list] = [[], [], []]
            for value in batch.column(1):
                ids = bpe.encode(value.as_py().decode("utf-8", "replace"))
                listed, decoded = bpe.digests(ids)
                out[0].append(len(ids))
                out[1].append(listed)
                out[2].append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(out, _ARROW.types[1:]))], schema=_ARROW)

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str, leaf: int = LEAF, threads: int = THREADS) -> DataFrame:
    """Per row: key and ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, leaf, threads)
        for batch in batches:
            ids = [bpe.encode(v.as_py().decode("utf-8", "replace")).astype(np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, f"{key} long, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """Per row: key and the decoded text; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(v or [], np.uint32)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} long, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return round_trip(docs, "doc_id", "text", tokenizer_path(VOCABULARY))
