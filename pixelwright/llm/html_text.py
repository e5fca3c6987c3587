"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each page is a chain of leaf blocks (see html_blocks). A block's two labels, main text or not,
get scores from ancestor-tag, name and text features; neighbours get transition scores, of one
kind within the same parent element and another across parents. The field is trained on
generated labelled pages by gradient ascent on the conditional likelihood (forward-backward)
and decoded by Viterbi. The model is small and of fixed size, trained once on the driver.

Cases: null or empty html, or a page without main text, gives the empty text; broken markup is
read as far as it goes; ties in decoding go to "not main"; equal pages give equal texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pick, table
from .html_blocks import KNOWN_NAMES, KNOWN_TAGS, OTHER, Block, blocks
from .labelled_pages import labelled_pages

TRAIN_PAGES = 900
STEPS = 200
RIDGE = 2e-4
_INDEX = {name: k for k, name in enumerate(
    [f"has:{t}" for t in KNOWN_TAGS] + [f"in:{t}" for t in KNOWN_TAGS] + [f"name:{w}" for w in KNOWN_NAMES] + ["name:other"]
    + [f"words:{k}" for k in range(9)] + [f"links:{k}" for k in range(5)] + [f"place:{k}" for k in range(6)]
    + ["ends", "copyright", "first", "last", "digits", "bias", "alone", "own header", "named within"]
)}


def features(page: list[Block]) -> Iterator[list[int]]:
    """Active feature numbers per block."""
    known = _INDEX
    n = len(page)
    cached: dict[tuple, list[int]] = {}
    for k, block in enumerate(page):
        key = (block.tags, block.inner, block.names, block.depth <= 2)
        base = cached.get(key)
        if base is None:
            base = [known[f"has:{t}"] for t in sorted(block.tags)]
            if f"in:{block.inner}" in known:
                base.append(known[f"in:{block.inner}"])
            named = [known[f"name:{w}"] for w in sorted(block.names) if w != OTHER]
            base += named or ([known["name:other"]] if block.names else [])
            base.append(known["bias"])
            if block.depth <= 2:
                base.append(known["alone"])
            if block.tags & {"article", "main"}:
                if "header" in block.tags:
                    base.append(known["own header"])
                if named:
                    base.append(known["named within"])
            cached[key] = base
        text = block.text
        size = len(text)
        f = base.copy()
        f.append(known["words:0"] + min(8, (text.count(" ") + 1).bit_length() - 1))
        f.append(known["links:0"] + min(4, 4 * block.link_chars // size))
        f.append(known["place:0"] + 6 * k // n)
        if text[-1] in ".!?…。\"'":
            f.append(known["ends"])
        if "©" in text:
            f.append(known["copyright"])
        if k == 0:
            f.append(known["first"])
        if k == n - 1:
            f.append(known["last"])
        if size < 40 and any(c.isdigit() for c in text):
            f.append(known["digits"])
        yield f


class Field:
    """weights: score of "main" per feature; moves[kind, before, after]: transition scores."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._w, self._m = weights.tolist(), moves.tolist()

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels by Viterbi."""
        if not page:
            return []
        w, back = self._w, bytearray()  # for each later block the best label before each of its labels, two bits
        no, yes, parent = 0.0, 0.0, None
        for k, (block, active) in enumerate(zip(page, features(page))):
            emit = 0.0
            for f in active:
                emit += w[f]
            if k == 0:
                no, yes = 0.0, emit
            else:
                (nn, ny), (yn, yy) = self._m[block.parent == parent]
                from_no, from_yes = (no + nn >= yes + yn), (no + ny >= yes + yy)
                back.append((0 if from_no else 1) + (0 if from_yes else 2))
                no, yes = (no + nn if from_no else yes + yn), emit + (no + ny if from_yes else yes + yy)
            parent = block.parent
        label = int(yes > no)
        labels = [label]
        for step in reversed(back):
            label = step >> label & 1
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, main in zip(found, self.decode(found)) if main)


def fit(pages: list[tuple[str, list[int]]], steps: int = STEPS) -> Field:
    """Maximise the conditional likelihood of the labels, all pages at once."""
    parsed = [(blocks(p), y) for p, y in pages]
    parsed = [(b, y) for b, y in parsed if b and len(b) == len(y)]
    n, longest, size = len(parsed), max(len(b) for b, _ in parsed), len(_INDEX)
    x = np.zeros((n, longest, size), np.float32)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    kind = np.zeros((n, longest), np.int64)
    for k, (page, labels) in enumerate(parsed):
        for t, active in enumerate(features(page)):
            x[k, t, active] = 1
            kind[k, t] = t > 0 and page[t].parent == page[t - 1].parent
        y[k, : len(labels)] = labels
        mask[k, : len(labels)] = True
    flat = x.reshape(-1, size)
    weights, moves = np.zeros(size, np.float64), np.zeros((2, 2, 2))
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (weights, moves)]
    rows = np.arange(n)
    pair = mask[:, 1:]
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = (flat @ weights.astype(np.float32)).reshape(n, longest)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step_scores = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[kind[:, t]], axis=1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], step_scores, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((n, longest, 2))
        between = np.zeros((n, longest - 1, 2, 2))
        for t in range(longest - 2, -1, -1):
            onward = moves[kind[:, t + 1]] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
            between[:, t] = forward[:, t, :, None] + onward
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(onward, axis=2), 0)
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
        gradient = ((y * mask - main).reshape(-1).astype(np.float32) @ flat).astype(np.float64) / n - RIDGE * weights
        both = np.exp(between - total[:, None, None, None]) * pair[:, :, None, None]
        move_gradient = np.zeros_like(moves)
        for k in (0, 1):
            here = (kind[:, 1:] == k) & pair
            move_gradient[k] = -both[here].sum(axis=0)
            np.add.at(move_gradient[k], (y[:, :-1][here], y[:, 1:][here]), 1)
        move_gradient = move_gradient / n - RIDGE * moves
        for value, g, (m, v) in zip((weights, moves), (gradient, move_gradient), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves)


@functools.lru_cache(1)
def trained() -> Field:
    """The field fitted to the generated labelled pages."""
    return fit(labelled_pages(TRAIN_PAGES))


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(df: DataFrame, key: str, url: str, page: str, field: Field | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    field = field or trained()
    weights, moves = field.weights, field.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights, moves)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [model.text(v) for v in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    schema=_ARROW,
                )

    return df.select(key, url, page).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    return main_text(pages, "page_id", "url", "html")
