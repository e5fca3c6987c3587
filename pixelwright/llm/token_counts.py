"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton over the vocabulary enumerates, for each end position, the pieces
that end there; dynamic programming carries only the best score and the number of pieces of
the best path to each position. The tie rules are those of the unigram model of the tokenizers
library: starts are taken from left to right and a path must be strictly better to replace
another, so of equal paths the one with the earliest last start stays; a position that no
one-character piece reaches gets an unknown piece at the least score minus UNKNOWN_PENALTY;
neighbouring unknown characters fuse into one piece, which counts as its UTF-8 bytes where the
vocabulary has byte pieces.

No vocabulary piece has a space marker after another character, so every best path passes
through the start of each marker run: the text falls into words whose counts add up and are
kept in a bounded cache. A word's unknowns fuse with those of the next word only if the next
starts with an unknown, which a marker (a piece of its own) rules out.

Cases: null and empty text count 0; equal texts count the same; the cache is emptied when it
reaches CACHE words, so memory stays bounded for any text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import lean, pick, table, tokenizer_path, utf8

VOCABULARY = "piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 1 << 18
#: Characters that are cut into words at once.
PART = 1 << 21
_RUN_START = re.compile(f"(?<=[^ {MARKER}]) ")
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Scored pieces of a model file (its special, byte and unused pieces left out), and whether it has all bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(n) if not special[i]]
    return pieces, sum(map(model.is_byte, range(n))) == 256


class UnigramCounter:
    """Counts pieces of best paths over one scored vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, cache: int = CACHE):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cache: dict[str, int] = {}
        self.most = cache
        self.splits = not any(MARKER in p.lstrip(MARKER) for p, _ in pieces) and MARKER in {p for p, _ in pieces}

    def count(self, text: str) -> int:
        """Pieces of a text after the vocabulary's space rule: marker first, spaces as markers."""
        if not text:
            return 0
        if not self.splits:
            return self._best(MARKER + text.replace(" ", MARKER))
        total, start = 0, 0
        while start < len(text):
            m = _RUN_START.search(text, start + PART)
            end = m.start() if m else len(text)
            total += self._words(("" if start else MARKER) + text[start:end].replace(" ", MARKER))
            start = end
        return total

    def _words(self, marked: str) -> int:
        total, cache = 0, self.cache
        for word in _WORD.findall(marked):
            n = cache.get(word)
            if n is None:
                if len(cache) >= self.most:
                    cache.clear()
                n = cache[word] = self._best(word)
            total += n
        return total

    def _best(self, text: str) -> int:
        size = len(text)
        score: list[float | None] = [0.0] + [None] * size
        count = [0] * (size + 1)
        open_unknown = [False] * (size + 1)  # whether the best path ends in an unknown piece
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        for end in range(size):
            found = ends[end]
            at = end + 1
            best, n, unknown = None, 0, False
            single = False
            for length, value in sorted(found, reverse=True):  # earliest start first
                before = score[at - length]
                if length == 1:
                    single = True
                candidate = before + value
                if best is None or candidate > best:
                    best, n, unknown = candidate, count[at - length] + 1, False
            if not single:
                candidate = score[end] + self.unknown
                if best is None or candidate > best:
                    best, unknown = candidate, True
                    if self.byte_fallback:
                        n = count[end] + len(text[end].encode())
                    else:
                        n = count[end] + (not open_unknown[end])
            score[at], count[at], open_unknown[at] = best, n, unknown
        return count[size]


@functools.lru_cache(4)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(*vocabulary(path))


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """Per row: key, n_tokens."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            found = [count(v.as_py().decode("utf-8", "replace")) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, f"{key} {kind}, n_tokens long")


def op1(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return token_counts(docs, "doc_id", "text", tokenizer_path(VOCABULARY))
