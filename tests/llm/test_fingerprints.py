"""Invertible Bloom sketches against plain sets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pixelwright.llm import iblt
from pixelwright.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import documents, empty


def units(text):
    return set(re.findall(rf"[^\n]{{1,{iblt.SEGMENT}}}[^\n.!?]{{0,{2 * iblt.SEGMENT}}}[.!?]*", text))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def run(df):
    chain = iblt.with_next(df, "doc_id", "text")
    return iblt.fingerprints(chain)


def check(docs, got):
    docs = sorted(((i, t or "") for i, t in docs))
    for (i, x), (_, y) in zip(docs, docs[1:] + docs[:1]):
        k = len(x) // 4
        e = x[: len(x) - k] + y[:k]
        r = got[i]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(units(x), units(e)))
        assert r["near_next"] == pytest.approx(jaccard(units(x), units(y)))


def test_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    check(docs, {r["doc_id"]: r for r in iblt.op7(spark, SF).collect()})


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (5, "a\nb\nc"), (3, "a\nb\nd"), (9, "\n".join(f"line {k}" for k in range(4000))), (11, "😀" * 500), (12, "a\na\na"), (40, "a\nb\nd")]
    got = {r["doc_id"]: r for r in run(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    check(rows, got)
    assert got[3]["fingerprint"] == got[40]["fingerprint"] != got[5]["fingerprint"]


def test_repeated_and_single_rows(spark):
    assert run(documents(spark)).count() == documents(spark).count()
    assert run(empty(spark)).count() == 0
    one = run(documents(spark, [(4, "x\ny")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 3


def test_peeling_recovers_or_fails(spark):
    r = random.Random(1)
    rows = []
    for k in range(300):
        common = [r.getrandbits(62) for _ in range(r.randint(0, 300))]
        left = [r.getrandbits(62) for _ in range(r.randint(0, 12))]
        right = [r.getrandbits(62) for _ in range(r.randint(0, 12))]
        rows.append((k, common + left, right + common))
    df = spark.createDataFrame(rows, "k long, a array<bigint>, b array<bigint>")
    once = iblt.peel(iblt.subtract(iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))))
    sure = iblt.recover(F.col("a"), F.col("b"))
    found = {r["k"]: r for r in df.select("k", once.alias("once"), sure.alias("sure")).collect()}
    peeled = 0
    for k, a, b in rows:
        want = {(d, 1) for d in set(a) - set(b)} | {(d, -1) for d in set(b) - set(a)}
        assert {tuple(x) for x in found[k]["sure"]} == want and len(found[k]["sure"]) == len(want)
        if found[k]["once"] is not None:
            peeled += 1
            assert {tuple(x) for x in found[k]["once"]} == want
    assert peeled > 150


def test_no_python_in_the_plan(spark):
    plan = iblt.op7(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_an_insertion_shifts_few_pieces():
    text = " ".join(f"Sentence {k} of a long line is of some length or other{', and on it goes' * (k % 4)}." for k in range(200))
    changed = text[:4000] + "an insertion " + text[4000:]
    assert len(units(text) ^ units(changed)) < 12 and len(units(text)) > 100


@pytest.mark.parametrize("differ", [0, 3, 20, 150, 1200])
def test_tables_follow_the_difference(spark, differ):
    """Two texts of 3,000 lines: the blocks of the larger table are as many as the difference asks for, and its digests are recovered."""
    lines = [f"line {k}" for k in range(3000)]
    other = lines[: 3000 - differ] + [f"other {k}" for k in range(differ)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    d = df.select(iblt.paragraphs(F.col("a")).alias("a"), iblt.paragraphs(F.col("b")).alias("b"))
    d = d.select("*", iblt.subtract(iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))).alias("x"))
    r = d.select(iblt.peel(F.col("x")).alias("peeled"), iblt.differing(F.col("x"), F.size("a"), F.size("b")).alias("about")).first()
    if differ <= 3:
        assert len(r["peeled"]) == 2 * differ
    else:
        assert r["peeled"] is None and differ / 3 < r["about"] < 8 * differ
    got = {r["doc_id"]: r for r in run(documents(spark, [(1, "\n".join(lines)), (2, "\n".join(other))])).collect()}
    assert got[1]["near_next"] == pytest.approx((3000 - differ) / (3000 + differ))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_BYTES", 40)
    docs = [(k * k % 1009, f"text {k}.\nand {k % 7}") for k in range(400)]
    chain = iblt.with_next(documents(spark, docs), "doc_id", "text").collect()
    want = sorted(docs)
    got = sorted((r["key"], r["text"], r["next_text"]) for r in chain)
    assert got == [(i, t, u) for (i, t), (_, u) in zip(want, want[1:] + want[:1])] and len({r["bucket"] for r in chain}) > 100
