"""Texts in parts give what they give whole."""

import hashlib
import random

from pixelwright.llm import bpe, common, jaccard_join, quality, token_counts


def test_parts(monkeypatch):
    r = random.Random(1)
    counter = token_counts.counter(common.tokenizer_path(token_counts.VOCABULARY))
    encoder = bpe.encoder(common.tokenizer_path(bpe.VOCABULARY))

    def all_of(text):
        data = text.encode()
        return jaccard_join.shingles(data).tolist(), quality.features(data).tolist(), counter.count(text), encoder.digests(encoder.encode(text))

    texts = ["".join(r.choice(["word", "the", " ", "  ", "\n", "é", "a b c", "▁", "x y", " x", "😀"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    whole = [all_of(t) for t in texts]
    for text, (_, _, _, digests) in zip(texts, whole):
        ids = encoder.encode(text)
        assert digests == (hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    monkeypatch.setattr(common, "PART", 5)
    monkeypatch.setattr(token_counts, "PART", 3)
    monkeypatch.setattr(bpe, "STEP", 2)
    assert [all_of(t) for t in texts] == whole


def test_parts_keep_words():
    data = b"one two  three\nfour" * 50
    cut = list(common.text_parts(data, 7))
    assert b"".join(cut) == data and sum((p.split() for p in cut), []) == data.split() and len(cut) > 50
    assert list(common.text_parts(b"")) == [b""] and list(common.text_parts(b"x" * 99, 7)) == [b"x" * 99]
