"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from pixelwright.llm import jaccard_join as J
from pixelwright.llm.common import table
from pixelwright.llm.components import components
from tests.conftest import SF
from tests.llm.helpers import documents, empty


class Sets:
    def __init__(self, items):
        self.of = {i: i for i in items}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    u = Sets(sets)
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    u.join(i, j)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def found(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_components(df, **options).collect()}


def family(r, base, copies):
    """Near copies of a text by few word edits, some of them chained."""
    out, words = [], base.split()
    for _ in range(copies):
        w = list(r.choice([words, out[-1].split() if out else words]))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk": 300, "common_from": 3, "shared_bits": 1 << 12, "common_bits": 1 << 10}, {"chunk_rows": 7}, {"chunk_rows": 5, "shared_bits": 1 << 10, "common_bits": 1 << 8, "dealt": 0}])
def test_planted_families(spark, options):
    r = random.Random(8)
    texts = []
    passage = " ".join(f"shared{k}" for k in range(60))
    for f in range(12):
        base = " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(5, 120)))
        texts += family(r, base, r.choice([1, 2, 5, 40]))
    texts += [" ".join(f"u{r.randint(0, 9999)}" for _ in range(40)) + " " + passage for _ in range(30)]
    texts += ["one two", "ONE two", "one two three", "", None, "   ", "a b c d e", "a b c d e f"]
    docs = list(enumerate(texts))
    assert found(documents(spark, docs), **options) == brute(docs)


def test_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op9(spark, SF).collect()}
    assert got == brute(docs)


def test_oracle(spark):
    from pixelwright.llm.oracles import JACCARD_JOIN
    from tests.oracle import check, connect

    check(spark, connect(SF), J.op9, JACCARD_JOIN, SF)


def test_awkward_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = J.similar_components(documents(spark)).collect()
    assert len(got) == len(docs) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)
    assert J.similar_components(empty(spark)).count() == 0


def test_stage_keeps_one(spark):
    docs = documents(spark, [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words stand here now"), (9, "other words stand here now"), (4, None), (6, "")])
    kept = J.stage(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 9]


def test_tree_walk_is_exact():
    r = random.Random(1)
    for _ in range(400):
        base = [r.sample(range(120), r.randint(1, 40)) for _ in range(r.randint(1, 4))]
        sets = set()
        for _ in range(r.randint(2, 25)):
            b = set(r.choice(base))
            for _ in range(r.randint(0, 5)):
                b.add(r.randint(0, 119))
                b.discard(r.choice(sorted(b))) if len(b) > 1 else None
            sets.add(tuple(sorted(b)))
        sets = [np.array(s, np.uint32) for s in sets]
        tree = J.PrefixTree(sets, 120)
        for s in sets:
            got = {tree.order[k] for k in tree.walk(s, np.ones(len(sets), bool)).tolist()}
            want = {k for k, t in enumerate(sets) if 9 * len(np.intersect1d(s, t)) >= 4 * (len(s) + len(t))}
            assert got == want


def test_prefix_length():
    for n in range(1, 200):
        assert J.prefix_length(n) == n - (4 * n + 4) // 5 + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)]
    u = Sets({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.of if u.find(x) != x or any(u.find(y) == x for y in u.of if y != x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def written_rows(monkeypatch, df, **options):
    """Rows of each table that the join writes, by name."""
    rows, write = {}, J.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(J, "materialize", counted)
        got = found(df, **options)
    return got, rows


def test_unlinked_texts_with_one_passage_take_linear_work(spark, monkeypatch):
    """Texts that share a passage and nothing else send no keys, however many they are."""
    passage = " ".join(f"shared{k}" for k in range(80))
    for n in (500, 5000):
        texts = [" ".join(f"u{k}x{i}" for i in range(40)) + " " + passage for k in range(n)]
        got, rows = written_rows(monkeypatch, documents(spark, list(enumerate(texts))))
        assert all(got[k][1] == k for k in range(n)) and rows["postings"] == rows["groups"] == 0


def test_large_group_of_near_copies_takes_linear_work(spark, monkeypatch):
    """One group in many chunks: what is dealt is little more than the group."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    for n in (400, 1600):
        texts = []
        for _ in range(n):
            w = base.copy()
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
        got, rows = written_rows(monkeypatch, documents(spark, list(enumerate(texts))), chunk_rows=64, common_from=8)
        assert {v[1] for v in got.values()} == {0}
        assert rows["groups"] <= 4 * n and rows.get("again", 0) <= 4 * n and rows["links"] < 4 * n


def test_leaders_of_keys(spark):
    """Stretches of sizes by hand: (key, size, class)."""
    rows = [(1, 10, 5), (1, 12, 3), (1, 12, 3), (1, 16, 9), (1, 20, 8), (2, 10, 5), (2, 10, 5), (3, 7, 1), (3, 8, 2), (3, 100, 0)]
    got = {tuple(r) for r in J._groups(spark.createDataFrame(rows, "key long, n long, d long")).collect()}
    assert got == {(3, 5, 10), (3, 3, 12), (8, 9, 16), (8, 8, 20), (1, 1, 7), (1, 2, 8)}


def test_unlinked_texts_of_common_passages_take_linear_work(spark, monkeypatch):
    """Every shingle is shared, texts are made of passages that many others have, few of them link, and no order says which are common: groups are keyed again by themselves."""
    r = random.Random(6)
    passages = [" ".join(f"p{p}w{i}" for i in range(30)) for p in range(60)]
    dealt = {}
    for n in (200, 800):
        texts = [" ".join([passages[0], *(passages[p] for p in r.sample(range(1, 60), 4))]) for _ in range(n)]
        docs = list(enumerate(texts))
        got, rows = written_rows(monkeypatch, documents(spark, docs), chunk_rows=16, common_from=1 << 20)
        if n == 200:
            assert got == brute(docs)
        dealt[n] = rows.get("again", 0)
        assert rows["items"] > 0
    assert dealt[800] < 16 * max(dealt[200], 200)
