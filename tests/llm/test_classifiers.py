import numpy as np
import pytest

from pixelwright.llm import langid, quality
from pixelwright.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import documents, empty

SF01 = SF.replace("0.001", "0.01")


def test_language_held_out(spark):
    out = langid.op10(spark, SF01).join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.99
    assert all(0 <= r["score"] <= 1 for r in out)


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(k, t * 3, l) for k in range(40) for t, l in ((f"the cat and the dog {k} went there", "en"), (f"der hund und die katze {k} sind hier", "de"), (f"le chat et la souris {k} sont", "fr"))]
    return langid.train(spark.createDataFrame(rows, "k long, t string, l string"), "k", "t", "l")


def test_language_rows(spark, language_model):
    got = {r["doc_id"]: r for r in langid.predict(documents(spark), "doc_id", "text", language_model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["ambiguous"] for k in (2, 3, 4))
    assert got[1]["lang_pred"] == "en" and len(got) == 10
    assert langid.predict(empty(spark), "doc_id", "text", language_model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents(spark), "doc_id", "text", None).collect()} == {"und"}
    kept = langid.filtered(documents(spark), language_model)
    assert kept.columns == documents(spark).columns and not {2, 3, 4} & {r["doc_id"] for r in kept.collect()}


def test_no_labels(spark):
    assert langid.train(documents(spark).selectExpr("doc_id", "text", "cast(null as string) as l"), "doc_id", "text", "l") is None


def test_grams_do_not_depend_on_chunks(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8))
    whole = langid.counts(data)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.array_equal(whole, langid.counts(data))


def test_codewords():
    for n in range(2, 12):
        code = langid.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert code.shape[0] == n and min(apart) >= (2 if n > 2 else 1)


def test_quality_held_out(spark):
    out = quality.op3(spark, SF01).join(table(spark, SF01, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in out) / len(out) > 0.95
    good = [r["score"] for r in out if r["quality"]]
    bad = [r["score"] for r in out if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_rows(spark):
    model = quality._corpus_model(spark, SF01)
    got = quality.score(documents(spark), "doc_id", "text", model).collect()
    by = {}
    for r in got:
        assert 0 <= r["score"] <= 1
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(got) == 11 and all(len(v) == 1 for v in by.values()) and by[1] == by[10] and by[2] == by[3]
    assert quality.score(empty(spark), "doc_id", "text", model).count() == 0
    assert {r["score"] for r in quality.score(documents(spark), "doc_id", "text", None).collect()} == {0.5}
    kept = quality.filtered(documents(spark), model)
    assert kept.columns == documents(spark).columns and 0 < kept.count() < 11


def test_no_positives(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(documents(spark), labels, "doc_id", "text", "quality") is None


def test_features_do_not_depend_on_chunks(monkeypatch):
    data = ("Some words, some more! " * 300).encode()
    whole = quality.features(data)
    monkeypatch.setattr(quality, "CHUNK", 101)
    assert np.allclose(whole, quality.features(data))


def test_risk_never_rewards_negative_parts():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 0.4, (300, quality.SIZE)), rng.normal(-1, 0.4, (100, quality.SIZE))
    model = quality.fit(good[:150], np.concatenate([good[150:], bad]), 0.6, steps=300)
    assert (model.score(good) >= 0.7).mean() > 0.95 and (model.score(bad) < 0.7).mean() > 0.95


def test_hash_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from pixelwright.llm.common import hash_sample

    df = spark.range(20_000).select(F.col("id").alias("k"))
    want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(300).collect()]
    assert [r["k"] for r in hash_sample(df, "k", 300, 20_000).collect()] == want
    assert hash_sample(df.limit(5), "k", 300, 5).count() == 5 and hash_sample(df.where("false"), "k", 3, 0).count() == 0


def test_risk_by_hand():
    """The risk and its slope, text by text and by small differences."""
    rng = np.random.default_rng(4)
    x, n, prior = rng.normal(0, 1, (9, quality.SIZE)), 4, 0.4
    for shift, overfitted in ((0.0, False), (-6.0, True)):
        params = [rng.normal(0, 0.2, (quality.SIZE, quality.HIDDEN)), rng.normal(0, 0.1, quality.HIDDEN), rng.normal(0, 0.5, quality.HIDDEN), np.zeros(1)]
        if overfitted:  # unlabelled texts far below zero, positives far above
            x[:n], x[n:] = params[0].sum(axis=1) * np.sign(params[2].sum()) * 3, -params[0].sum(axis=1) * np.sign(params[2].sum()) * 3

        def parts(p):
            g = [float(np.tanh(row @ p[0] + p[1]) @ p[2] + p[3][0]) for row in x]
            loss = lambda z: np.log1p(np.exp(-z))
            gain = prior * sum(loss(z) for z in g[:n]) / n
            return gain, sum(loss(-z) for z in g[n:]) / (len(g) - n) - prior * sum(loss(-z) for z in g[:n]) / n

        assert quality.risk(params, x, n, prior) == pytest.approx(parts(params))
        assert (parts(params)[1] < 0) == overfitted
        target = (lambda p: -parts(p)[1]) if overfitted else (lambda p: sum(parts(p)))
        slopes = quality.risk_slope(params, x, n, prior)
        for which, at in ((0, (3, 2)), (1, (5,)), (2, (7,)), (3, (0,))):
            moved = []
            for step in (1e-5, -1e-5):
                p = [v.copy() for v in params]
                p[which][at] += step
                moved.append(target(p))
            assert slopes[which][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(8)
    good = lambda n: rng.normal(0.7, 0.5, (n, quality.SIZE))
    unlabelled = np.concatenate([good(int(3000 * share)), rng.normal(-0.7, 0.5, (3000 - int(3000 * share), quality.SIZE))])
    rng.shuffle(unlabelled)
    assert quality.estimate_prior(good(1500), unlabelled) == pytest.approx(share, abs=0.06)


def test_negative_labels_are_not_read(spark):
    docs = spark.createDataFrame([(k, "clean words here " * (k % 7 + 1) if k % 3 else "x9$ " * (k % 5 + 1)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    both, positives = quality.train(docs, labels, "doc_id", "text", "quality"), quality.train(docs, labels.where("quality = 1"), "doc_id", "text", "quality")
    assert both.prior == positives.prior and np.array_equal(both.w1, positives.w1)


def test_very_long_text_scores_like_its_parts(spark, monkeypatch):
    """A text of many chunks and parts: the same score however it is cut."""
    model = quality._corpus_model(spark, SF01)
    df = documents(spark, [(1, "One long text, sentence after sentence. " * 4000), (2, "y" * 300_000)])
    want = sorted(r["score"] for r in quality.score(df, "doc_id", "text", model).collect())
    monkeypatch.setattr(quality, "CHUNK", 1000)
    from pixelwright.llm import common

    monkeypatch.setattr(common, "PART", 2000)
    local = sorted(float(model.score(quality.features(r["text"].encode())[None, :])[0]) for r in df.collect())
    assert local == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n", [2, 3, 4, 6])
def test_decoding_ties_are_flagged(n):
    names = [chr(97 + k) for k in range(n)]
    code = langid.codewords(n)
    model = langid.Model(names, code, np.zeros((code.shape[1], langid.BUCKETS), np.float32), np.zeros(code.shape[1], np.float32))
    between = 2.0 * (code[0] + code[1])  # as near to the first codeword as to the second
    lang, score, ambiguous = model.decode(between)
    loss = [sum(np.log1p(np.exp(-float(b) * float(m))) for b, m in zip(row, between)) for row in code]
    assert lang == "a" and ambiguous and score == pytest.approx(np.exp(-loss[0]) / sum(np.exp(-v) for v in loss))
    for k in range(n):
        assert model.decode(2.0 * code[k])[::2] == (names[k], False)
    assert model.decode(np.zeros(code.shape[1]))[2]


def test_decoding_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 7):
        code = langid.codewords(n)
        model = langid.Model([chr(97 + k) for k in range(n)], code, np.zeros((code.shape[1], langid.BUCKETS), np.float32), np.zeros(code.shape[1], np.float32))
        for margins in rng.normal(0, 1.5, (40, code.shape[1])):
            share = [np.prod([1 / (1 + np.exp(-float(b) * m)) for b, m in zip(row, margins)]) for row in code]
            first, second = sorted(share, reverse=True)[:2]
            lang, score, ambiguous = model.decode(margins)
            assert lang == chr(97 + int(np.argmax(share))) and score == pytest.approx(first / sum(share)) and ambiguous == (second >= langid.AMBIGUOUS * first)


def test_mixed_text_is_ambiguous(spark):
    """Two languages of mirrored words: a text of both halves is flagged, one of a single language is not."""
    rows = [(k, ("aba abba baab " if k % 2 else "xyx xyyx yxxy ") * (2 + k % 5), "ab" if k % 2 else "xy") for k in range(80)]
    model = langid.train(spark.createDataFrame(rows, "k long, t string, l string"), "k", "t", "l")
    margin = lambda t: float(model.margins(t.encode())[0])
    assert not model.decode(model.margins(b"aba abba baab"))[2] and not model.decode(model.margins(b"xyx xyyx"))[2]
    texts = ["aba abba baab " * a + "xyx xyyx yxxy " * (40 - a) for a in range(41)]
    nearest = min(texts, key=lambda t: abs(margin(t)))
    assert abs(margin(nearest)) < 0.2 and model.decode(model.margins(nearest.encode()))[2]
    kept = langid.filtered(documents(spark, [(1, nearest), (2, "aba abba baab")]), model)
    assert [r["doc_id"] for r in kept.collect()] == [2]


def test_repeated_ids_and_many_languages(spark):
    rows = [(1, t, "en") for t in ("b b b", "a a a", "a a a")] * 20 + [(k, "zz yy " * 3, f"l{k:02}") for k in range(2, 30)]
    df = spark.createDataFrame(rows, "k long, t string, l string")
    one, other = langid.train(df, "k", "t", "l", rows=12), langid.train(df.repartition(7), "k", "t", "l", rows=12)
    assert one.languages == other.languages == ["en", *(f"l{k:02}" for k in range(2, 13))] and np.array_equal(one.weights, other.weights)
