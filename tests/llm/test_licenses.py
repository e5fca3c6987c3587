import re
from collections import Counter

from pixelwright.llm import licenses as L
from tests.conftest import SF
from tests.llm.helpers import documents, empty
from tests.oracle import check, connect


def brute(docs, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    def grams(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return Counter(zip(w, w[1:]))

    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        units = ([(0, grams(text))] if len(lines) > 1 else []) + [(k, grams(u)) for k, u in enumerate(lines, 1)]
        w = re.findall(r"[^\W_]+", (text or "").lower())
        pairs = list(zip(w, w[1:]))
        for name, body in templates:
            t = grams(body)
            size = sum(t.values())
            last = len(pairs) - size
            starts = {min(p, last) for p, g in enumerate(pairs) if g in t} if last >= 0 else ()
            hits = []
            for k, g in units + [(-p - 1, Counter(pairs[p : p + size])) for p in starts]:
                if g:
                    dice = 2 * sum((g & t).values()) / (sum(g.values()) + size)
                    if dice >= threshold:
                        hits.append((-dice, k < 0, abs(k)))
            if hits:
                dice, window, k = min(hits)
                out.append((doc, name, round(-dice, 9), -k if window else k, len(hits)))
    return sorted(out)


def found(df, **options):
    return sorted((r["doc_id"], r["license"], round(r["dice"], 9), r["unit"], r["n_units"]) for r in L.scan(df, "doc_id", "text", **options).collect())


def test_oracle(spark):
    check(spark, connect(SF), L.op4, L.ORACLE, SF)


def test_against_brute_force(spark):
    full = dict(L.TEMPLATES)
    docs = [
        (1, full["MIT"]), (2, full["MIT"].replace(". ", ".\n", 1).replace("to deal in", "to\ndeal in")), (3, "Some text.\nreleased UNDER the mit license\nmore text"),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (6, None), (7, ""), (8, "license"),
        (9, full["Apache-2.0-header"] + " Extra words at the end of the header."), (10, "the the the the the the"), (11, full["ISC"] + "\n" + full["GPL-3.0-notice"]),
    ]
    assert found(documents(spark, docs)) == brute(docs) and len(brute(docs)) >= 9


def test_other_templates_and_thresholds(spark):
    templates = (("x", "one two three four five six"), ("y", "one two one two one two"))
    docs = [(1, "one two three four five"), (2, "one two one two"), (3, "one two three x five six"), (4, "four five six")]
    for threshold in (0.3, 0.6, 0.9, 1.0):
        assert found(documents(spark, docs), templates=templates, threshold=threshold) == brute(docs, templates, threshold)


def test_awkward_rows(spark):
    assert found(documents(spark)) == [] and found(empty(spark)) == []
    twice = documents(spark, [(1, "Released under the MIT License.")] * 2)
    assert L.scan(twice, "doc_id", "text").count() == 2


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Pandas|Arrow", L.op4(spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_matches_at_the_threshold(spark):
    """Four of six bigrams and no others: Dice is exactly 0.8."""
    docs = [(1, "Some prose before.\nCC BY-SA 4.0\nSome prose after."), (2, "Some prose before.\nCC BY-NC 4.0\nSome prose after.")]
    assert found(documents(spark, docs)) == brute(docs) == [(1, "CC-BY-SA-4.0-notice", 0.8, 2, 1), (2, "CC-BY-NC-4.0-notice", 0.8, 2, 1)]


def test_pieces_of_templates_hold_an_anchor():
    for name, body in L.TEMPLATES:
        w = L.words(body)
        anchors = set(L.anchors([(name, body)], L.THRESHOLD))
        for n in range(2, len(w) + 1):
            if 10 * 2 * (n - 1) >= 8 * (n - 1 + len(w) - 1):
                assert all(anchors & set(L.bigrams(" ".join(w[k : k + n]))) for k in range(len(w) - n + 1)), (name, n)


def test_notices_within_prose_and_wrapped_texts(spark):
    full = dict(L.TEMPLATES)
    wrapped = "\n".join(re.sub(r"(.{1,60})(?: |$)", r"# \1|", full["MIT"]).strip("|").split("|"))
    docs = [
        (1, "A long line of prose that says it was released under the MIT License. And it goes on for a while after that, and on."),
        (2, "Words before.\n" * 40 + wrapped + "\nint main() {}\n" * 30),
        (3, "def f(): pass\n" + full["BSD-3-Clause"].replace(". ", ".\n").replace("copyright holder nor", "author nor") + "\nend of the file " * 5),
        (4, "This text ends with a notice: this work is licensed under\nthe GNU General Public License, version"),
        (5, ("licensed under cc by 4.0 " * 50) + "x"), (6, "of the use in the software or the other " * 30), (7, "the mit license"),
    ]
    got = found(documents(spark, docs))
    assert got == brute(docs)
    names = {(d, n) for d, n, *_ in got}
    assert {(1, "MIT-notice"), (2, "MIT"), (3, "BSD-3-Clause"), (5, "CC-BY-4.0-notice")} <= names and not {6, 7} & {d for d, _ in names}


def test_windows_by_brute_force(spark):
    """Random words of a small alphabet, so that windows start, end and repeat everywhere."""
    import random

    r = random.Random(3)
    templates = (("x", "a b a b c a"), ("y", "c c c a b"), ("z", "b a c"), ("w", "a b c a b c a b c a b c"))
    docs = [(k, " ".join(r.choice(["a", "b", "c", "d", "\n"]) for _ in range(r.randint(0, 40)))) for k in range(120)]
    for threshold in (0.5, 0.8, 1.0):
        assert found(documents(spark, docs), templates=templates, threshold=threshold) == brute(docs, templates, threshold)


def test_repeated_notice_in_a_long_text(spark):
    """Work grows with the text, not with the square of its hits."""
    assert found(documents(spark, [(1, "Licensed under CC BY 4.0. " * 20_000)]))[0][:3] == (1, "CC-BY-4.0-notice", 1.0)
