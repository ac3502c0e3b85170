"""The trained operators: held-out accuracy, odd rows, and the same result each time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlog.llm import common, language, quality, toxicity
from oracle import SF

ODD = [(None, None), (1, ""), (2, " \n"), (3, "12 34 !!"), (4, "the same words"), (4, "the same words"), (5, "word " * 60000)]


@pytest.fixture(scope="module")
def tables(spark):
    sf = SF.replace("0.001", "0.01")
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels.filter(F.col(label).isin(0, 1)), "doc_id").select("score", "predicted", label).collect()
    ones, zeros = [r[0] for r in rows if r[2] == 1], [r[0] for r in rows if r[2] == 0]
    return sum(r[1] == r[2] for r in rows) / len(rows), sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def odd(spark):
    return spark.createDataFrame([(i, t, "xx", None, None, 0.5) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_quality(spark, tables):
    machine = quality.train(*tables)
    right, auc = accuracy(quality.scored(tables[0], machine), tables[1], "quality")
    assert right > 0.9 and auc > 0.95
    rows = quality.scored(odd(spark), machine).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.train(tables[0], tables[1].limit(0)) is None and quality.scored(odd(spark), None).count() == len(ODD)


def test_toxicity(spark, tables):
    scored = toxicity.scored(*tables)
    right, auc = accuracy(scored, tables[1], "toxic")
    assert right > 0.85 and auc > 0.9
    kept = toxicity.without_toxic(*tables)
    assert kept.columns == tables[0].columns and kept.count() == scored.filter("predicted = 0").count()


def test_toxicity_of_odd_rows(spark):
    texts = [("fine words here", 0), ("good words there", 0), ("you foul thing", 1), ("so foul indeed", 1)]
    known = [(100 + i, *texts[i % 4]) for i in range(400)]
    rows = [*((i, t, "xx", 0.5) for i, t in ODD), *((i, t, "en", 0.5) for i, t, _ in known)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, raw double")
    labels = spark.createDataFrame([*((i, y) for i, _, y in known), (None, 1), (100, 7)], "doc_id long, toxic int")
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    wrong = {i for i, _, y in known} & {r["doc_id"] for r in found if r["doc_id"] and r["predicted"] != dict((i, y) for i, _, y in known).get(r["doc_id"])}
    assert not wrong
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["raw"] for r in kept.collect()} == {0.5}
    none = docs.limit(0)
    assert toxicity.train(none, labels) is None and toxicity.scored(none, labels).count() == 0 and toxicity.without_toxic(none, labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == len(rows) and {r["predicted"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0}


def small_network(seed=1):
    rng = np.random.default_rng(seed)
    n, e, f = 30, toxicity.EMBEDDING, toxicity.FILTERS
    net = toxicity.Network(rng.normal(size=(n, e)), [rng.normal(size=(w, e, f)) for w in toxicity.WIDTHS], [rng.normal(size=f) for _ in toxicity.WIDTHS], rng.normal(size=3 * f), rng.normal(size=1))
    net.embedding[-1] = 0
    texts = [rng.integers(0, n - 1, (2, k + 2)).astype(np.int32) for k in (1, 2, 5, 40, 3)]
    for t in texts:
        t[:, -2:] = n - 1
    return net, texts


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_convolution_equals_loops_however_it_is_cut(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    net, texts = small_network()
    slow = []
    for ids in texts:
        words = net.embedding[ids[0]] + net.embedding[ids[1]]
        slow.append([max(0, max(sum(words[i + j] @ own[j, :, f] for j in range(w)) for i in range(ids.shape[1] - 2)) + net.filter_bias[k][f]) for k, (w, own) in enumerate(zip(toxicity.WIDTHS, net.filters, strict=True)) for f in range(toxicity.FILTERS)])
    assert np.allclose(net.pooled(texts), slow, atol=1e-4)


def test_gradient_equals_differences():
    net, texts = small_network()
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 1.0])
    grads = toxicity.gradients(net, texts, y, weight)[1]
    rng = np.random.default_rng(2)
    for p, g in zip([net.embedding, *net.filters, *net.filter_bias, net.weights, net.bias], grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p is net.embedding and at[0] == len(p) - 1:
                continue
            old, sides = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                sides.append(toxicity.gradients(net, texts, y, weight)[0])
            p[at] = old
            assert abs((sides[0] - sides[1]) / 2e-6 - g[at]) < 1e-5


def test_minority_languages_are_calibrated(spark):
    many = [(i, lang, label, (8.0 if lang == "xx" else 0.0) + (1.0 if label else -1.0)) for i, (lang, label) in enumerate([("en", k % 2) for k in range(2000)] + [("xx", k % 2) for k in range(600)] + [("yy", k % 2) for k in range(9)])]
    raws = spark.createDataFrame([(i, raw, lang) for i, lang, _, raw in many], "doc_id long, raw double, lang string")
    whole, cuts = toxicity.thresholds(raws, spark.createDataFrame([(i, label) for i, _, label, _ in many], "doc_id long, toxic int"))
    assert set(cuts) == {"en", "xx"} and -1 < cuts["en"] < 1 and 7 < cuts["xx"] < 9 and -1 < whole < 9
    found = raws.select("lang", toxicity.score(F.col("raw"), F.col("lang"), (whole, cuts)).alias("s"), "raw").collect()
    assert all((r["s"] >= 0.5) == (r["raw"] >= cuts.get(r["lang"], whole)) for r in found)


def test_language(spark, tables):
    model = language.train(tables[0].filter(~common.held_out(F.col("doc_id"), 5, 0)))
    known = tables[0].filter("lang is not null and length(text) > 0").select("doc_id", "lang")
    rows = language.predict(tables[0], model).join(known, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.97 * len(rows)
    found = [(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(odd(spark), model).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(None, True), (1, True), (2, True), (3, True), (4, False), (4, False), (5, False)]))
    assert language.train(tables[0].limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(odd(spark), None).collect()} == {"und"}


def test_decoding_equals_loops_and_ties_go_to_the_first():
    rng = np.random.default_rng(3)
    code = language.codewords(6)
    width = language.BUCKETS * len(language.ORDERS)
    model = language.Model(list("abcdef"), code, rng.normal(size=(width, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32), rng.random(code.shape[1]).astype(np.float32))
    texts = ["some words", "ein Satz", "x", "more of the same words again"]
    for text, row in zip(texts, model.scores(texts), strict=True):
        margin = [float(language.features(text) @ model.weights[:, b] + model.bias[b]) for b in range(code.shape[1])]
        loss = [sum(model.trust[b] * np.log1p(np.exp(-margin[b] * code[c, b])) for b in range(code.shape[1])) for c in range(6)]
        p = np.exp(min(loss) - np.array(loss))
        assert np.allclose(row, p / p.sum(), atol=1e-4)
    none = language.Model(["a", "b", "c"], language.codewords(3), np.zeros((width, 3), np.float32), np.zeros(3, np.float32), np.ones(3, np.float32))
    assert none.scores(["any text"]).argmax() == 0 and np.allclose(none.scores(["any text"]), 1 / 3)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_parts_of_a_long_text_count_as_the_whole(monkeypatch, chunk):
    texts = ["", "a", "ab cd", "Größe und Maß 123 " * 9]
    whole = [language.features(t) for t in texts]
    monkeypatch.setattr(language, "CHUNK", chunk)
    assert all(np.allclose(a, language.features(t)) for a, t in zip(whole, texts, strict=True))


def test_no_rows_are_no_rows(spark):
    none = odd(spark).limit(0)
    assert quality.scored(none, None).count() == 0 and language.predict(none, None).count() == 0
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_no_language_is_left_out(spark):
    rows = spark.range(1050).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 250) as lang")
    found = {r["lang"]: r["count"] for r in common.sample_by(rows, "lang", 3).groupBy("lang").count().collect()}
    assert len(found) == 250 and set(found.values()) == {3}
    assert common.sample_by(rows, "lang", 5).count() == 1050


def test_samples_are_bounded_and_the_same_each_time(spark):
    rows = spark.range(5000).selectExpr("id % 1000 as doc_id", "id % 7 as n", "if(id % 100 = 0, 'b', 'a') as lang")
    take = lambda df: sorted(map(str, common.sample_by(df, "lang", 20).collect()))
    assert take(rows) == take(rows.repartition(5)) and len(take(rows)) == 40
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(200)] + [(2, "x"), (None, "y")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, _label int")
    assert sorted(r["_label"] for r in common.labelled_sample(docs, known, 9).collect()) == [0, 1]


def test_factorisation_identity():
    rng = random.Random(1)
    machine = quality.fit([(k % 2, " ".join(rng.choice(["good", "fine"] if k % 2 else ["bad", "poor"]) for _ in range(9)), 9) for k in range(40)], epochs=2)
    at, x = quality.features("good bad and other words", 24)
    slow = machine.bias + machine.linear[at] @ x + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(machine.raw(at, x) - slow) < 1e-9


def test_codewords_differ():
    for n in (1, 2, 4, 5, 9, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n or n == 1


def test_threshold():
    assert common.best_threshold([0, 1, 2, 3], [0, 0, 1, 1]) == 1.5
    assert common.best_threshold([1, 1], [1, 1]) == 0.0
