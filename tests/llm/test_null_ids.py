"""Rows without an id count like any other row; joins leave them alone."""

import pytest

from pixelwright.llm import bpe, iblt, jaccard_join, langid, licenses, media, packing, quality, token_counts
from pixelwright.llm.common import tokenizer_path
from tests.conftest import SF
from tests.llm.helpers import documents

ROWS = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (8, "Released under the MIT License.")]
BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize(
    "run",
    [
        lambda d: bpe.round_trip(d, "doc_id", "text", BPE), lambda d: token_counts.token_counts(d, "doc_id", "text", PIECES), lambda d: media.documents_digests(d),
        lambda d: langid.predict(d, "doc_id", "text", None), lambda d: quality.score(d, "doc_id", "text", None), lambda d: jaccard_join.similar_components(d),
        lambda d: iblt.fingerprints(iblt.with_next(d, "doc_id", "text")),
    ],
)
def test_every_row_is_answered(spark, run):
    got = run(documents(spark, ROWS)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "8", "None", "None"]


def test_packing_and_licenses(spark):
    pieces = packing.pack(documents(spark, ROWS).coalesce(1), "doc_id", "text", BPE).collect()
    assert {r["doc_id"] for r in pieces} == {None, 3, 8}
    assert [r["doc_id"] for r in licenses.scan(documents(spark, ROWS + [(None, "Released under the MIT License.")]), "doc_id", "text").collect()].count(None) == 1


def test_stage_of_the_join(spark):
    kept = jaccard_join.stage(spark, documents(spark, ROWS), SF).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [3, 8]


def test_stage_keeps_rows_that_are_no_duplicates(spark):
    """Null ids and ids of several texts: one row of each component stays, and every text that nothing links."""
    long, other, third = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten", "red green blue white black brown grey pink gold teal")
    rows = [
        (None, long), (None, long), (None, None), (None, None), (None, ""), (5, other), (5, third), (6, other), (7, long + " extra"), (7, "a"), (7, "a"), (7, "b"), (9, third), (None, third), (None, "x y"),
    ]
    linked = {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_components(documents(spark, [(1, long), (2, long + " extra"), (3, other), (4, third)])).collect()}
    assert linked == {(1, 1), (2, 1), (3, 3), (4, 4)}
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.stage(spark, documents(spark, rows), SF).collect()]
    want = [(None, None), (None, None), (None, ""), (5, other), (5, third), (7, long + " extra"), (7, "a"), (7, "b"), (None, "x y")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
