"""BPE, token counts and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, normalizers

from pixelwright.llm import bpe, packing, token_counts
from pixelwright.llm.common import table, tokenizer_path
from tests.conftest import SF
from tests.llm.helpers import documents, empty

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ALPHABET = ["a", "l", "'", " ", "\n", "1", "!", "é", "中", "the", " the", "ing", "\t", "'s", "\x1c", "\x85", "😀", "İ", "=", "t"]


def awkward(r):
    some = r.sample(ALPHABET, r.randint(1, 6))
    text = "".join(r.choice(some) * r.choice([1, 1, 1, 2, 5, 30]) for _ in range(r.randint(0, 40)))
    return text[:5] + "<|endoftext|>" + text[5:] if r.random() < 0.05 else text


@pytest.mark.parametrize("leaf,run,threads", [(6, 4, 1), (16, 8, 2), (bpe.LEAF, bpe.RUN, 1)])
def test_tree_equals_library(library, monkeypatch, leaf, run, threads):
    monkeypatch.setattr(bpe, "RUN", run)
    monkeypatch.setattr(bpe, "PARALLEL", 1 if leaf < bpe.LEAF else bpe.PARALLEL)
    mine = bpe.ByteBpe(PATH, leaf, threads)
    r = random.Random(leaf)
    for _ in range(1500):
        text = awkward(r)
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 40_000, "ab1" * 20_000, "中文" * 20_000, "=" * 70_000, "the quick " * 9_000])
def test_long_unsplit_text(library, text):
    assert bpe.encoder(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(spark, library):
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark), "doc_id", "text", PATH).collect()}
    for r in documents(spark).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), "doc_id", "text", PATH).count() == 0
    ids = bpe.encode_column(documents(spark), "doc_id", "text", PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(ids, "doc_id", "ids", PATH).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in documents(spark).collect())


def test_query_on_all_documents(spark, library):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in bpe.op6(spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# Token counts ------------------------------------------------------------------------------


def unigram(pieces, byte_fallback):
    extra = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *extra, *pieces], 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_equal_library():
    pieces, fallback = token_counts.vocabulary(tokenizer_path(token_counts.VOCABULARY))
    t, mine = unigram(pieces, fallback), token_counts.UnigramCounter(pieces, fallback, cache=50)
    r = random.Random(3)
    some = ["a", "the", " ", "  ", "é", "中", "\n", "😀", "ing", "ñ", "xxxxxxxxx", "▁", "ツ", "꧁", "\x00"]
    for _ in range(1500):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 30)))
        assert mine.count(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_ties_and_unknowns_equal_library():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5)]
    t, mine = unigram(pieces, False), token_counts.UnigramCounter(pieces, False)
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("aab bz") for _ in range(r.randint(0, 12)))
        assert mine.count(text) == len(t.encode(text, add_special_tokens=False).ids), text


def test_count_rows(spark):
    path = tokenizer_path(token_counts.VOCABULARY)
    t = unigram(*token_counts.vocabulary(path))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(documents(spark), "doc_id", "text", path).collect()}
    for r in documents(spark).collect():
        assert got[r["doc_id"]] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(empty(spark), "doc_id", "text", path).count() == 0


# Packing -----------------------------------------------------------------------------------


def check_pieces(pieces, docs, length):
    """docs: id -> ids. Every id in exactly one piece, sequences gapless and not too long."""
    sequences, starts = {}, {}
    for p in pieces:
        at = sequences.setdefault(p["sequence_id"], [])
        at.append((p["offset"], p["length"]))
        starts.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end and n > 0
            end += n
        assert end <= length
    for doc, ids in docs.items():
        end = 0
        for start, n, crc, total in sorted(starts[doc]):
            assert start == end and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            end += n
        assert end == len(ids)
    fill = [sum(n for _, n in s) for s in sequences.values()]
    return sum(length - f for f in fill if f & (f - 1)) / sum(fill)


def test_all_documents_are_packed(spark, library):
    docs = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids + [1] for r in table(spark, SF, "documents").collect()}
    assert check_pieces(packing.op8(spark, SF).collect(), docs, 2048) < 0.02


def test_small_blocks(spark, library):
    rows = [(k, t) for k, t in enumerate([None, "", LONG_RUN, "One. Two. Three is longer than the others are.\n" * 40, "tail", "w" * 300])]
    docs = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows}
    df = documents(spark, rows).coalesce(1)
    pieces = packing.pack(df, "doc_id", "text", PATH, length=64, block=256).collect()
    check_pieces(pieces, docs, 64)
    assert [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))] == sorted(p["doc_id"] for p in pieces)  # order kept
    assert packing.pack(empty(spark), "doc_id", "text", PATH).count() == 0


LONG_RUN = "no stop here " * 500


def test_plan_is_optimal():
    """The monotone queue against quadratic dynamic programming."""
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(5, 60)
        at = np.array(sorted({*r.sample(range(1, n), min(n - 1, r.randint(3, 30))), n, *range(4, n, 4)}))
        cost = np.array([r.choice([0.0, 1.0, 8.0]) for _ in at])
        windows = packing.plan(at, cost, 12)
        best = {0: 0.0}
        for j, c in zip(at.tolist(), cost):
            best[j] = min(best[i] + c + 12 - (j - i) for i in best if j - 12 <= i < j)
        pay = dict(zip(at.tolist(), cost))
        total = sum(pay[b] + 12 - (b - a) for a, b in zip([0, *windows], windows))
        assert total == pytest.approx(best[n]) and all(b - a <= 12 for a, b in zip([0, *windows], windows))
    assert packing.powers(3, 3 + 777) == [515, 771, 779, 780]


def test_halves_meet_in_threads_on_the_main_path(spark, monkeypatch):
    """The query's own encoder hands long texts to its threads, and gives the library's ids."""
    mine = bpe.encoder(PATH)
    text = ("some words, " * 9 + "x" * 700 + "\n") * 60
    assert mine.threads > 1 and len(text) >= bpe.PARALLEL
    ids = mine.encode(text)
    assert mine._pool is not None and ids.tolist() == bpe.ByteBpe(PATH, 1 << 30, 1)._leaf(text).tolist()
