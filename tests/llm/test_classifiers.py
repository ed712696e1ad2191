import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from shutterlake.llm import language_id, quality

ROWS = {"en": "the and of to in that is with for this".split(), "fr": "le la les des une est dans pour avec cette".split(), "de": "der die das und nicht mit für ein ist über".split()}


def sentences(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        yield i, " ".join(rng.choice(ROWS[lang]) for _ in range(rng.randint(5, 120))), lang


def test_languages_of_held_out_texts(spark):
    rows = [*sentences(400), (1000, None, "en"), (1001, "", "fr"), (1002, "12 + 3!", "de"), (1003, "the and of with that", None), (None, "der die das und nicht", "de"), (1004, "le la les " * 40_000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = language_id.identified(df).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in out}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1004].lang_pred == "fr" and all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)


def test_stage_drops_only_what_has_no_language(spark):
    df = spark.createDataFrame([*sentences(60), (90, "1234", "en"), (91, None, None)], "doc_id long, text string, lang string")
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60))


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identified(df).collect()] == [("und", 0.0)]
    assert language_id.identified(df.limit(0)).count() == 0


def test_windows_cover_all_bytes():
    windows, weight = language_id.windows_of(b"x" * 600, 256)
    assert windows.shape == (3, 256) and weight.tolist() == [256, 256, 88] and (windows[2, 88:] == 256).all()
    assert language_id.windows_of(b"")[1].tolist() == [0]


def grades(n, seed=2):
    rng = random.Random(seed)
    for i in range(n):
        g = i % 3
        bad = [["spam!!!", "###"], ["worthless"], []][g]
        words = [rng.choice(ROWS["en"]) for _ in range(rng.randint(5, 60))] + bad
        rng.shuffle(words)
        yield i, " ".join(words), g


def test_expected_grades_are_ordered_on_held_out_texts(spark):
    rows = list(grades(900))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(5000, None, 1), (5001, "", 1), (0, "the and", 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.rated(docs, quality.learned(docs, quality.graded(labels))).filter(quality.held_out_of(F.col("doc_id"))).collect()
    truth = {i: g for i, _, g in rows}
    means = [np.mean([r.expected_grade for r in out if truth.get(r.doc_id) == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert np.mean([r.kept == (truth[r.doc_id] == 2) for r in out if r.doc_id in truth]) > 0.95


def test_thresholds_are_ordered_and_tails_add_up():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(300)]
    y = np.array([min(2, int((v < 10).sum())) for v in x])
    m = quality.fit(x, y, bits=6)
    tails = m.tails(m.scores(x))
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all() and len(m.scores([])) == 0


def test_no_ratings_and_empty(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [tuple(r)[2:] for r in quality.rated(docs, quality.learned(docs, none)).collect()] == [(1.0, 0.5, True)]
    assert quality.rated(docs.limit(0), None).count() == 0


def test_language_stage_keeps_texts_where_no_label_teaches(spark):
    from shutterlake.llm.language_id import held_out_of, keep_identified

    rows = [(i, f"some clean words number {i}", None) for i in range(20)] + [(20, "12 34", None), (21, None, None), (22, "é", None), (23, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = [*range(20), 22]
    assert sorted(r.doc_id for r in keep_identified(df).collect()) == want
    held = df.withColumn("lang", F.when(held_out_of(F.col("doc_id")), "en"))  # labels, all of them held out
    assert held.filter("lang is not null").count() > 0 and sorted(r.doc_id for r in keep_identified(held).collect()) == want


def small_network(seed=4):
    """Two widths, three filters, two labels, in double precision."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 1, (k, 257, 3)) for k in (2, 3)]
    for t in tables:
        t[:, 256] = 0
    return language_id.Network(["a", "b"], tables, rng.normal(0, 1, (6, 2)), rng.normal(0, 1, 2))


def test_pooling_equals_a_direct_convolution():
    net, windows = small_network(), np.random.default_rng(1).integers(0, 257, (5, 20))
    pooled, places = net.pooled(windows)
    for r, row in enumerate(windows):
        for k, table in enumerate(net.tables):
            own = [[sum(table[j, row[at + j], f] for j in range(len(table))) for at in range(len(row) - len(table) + 1)] for f in range(3)]
            assert np.allclose(pooled[r, 3 * k : 3 * k + 3], [max(x) for x in own]) and places[k][r].tolist() == [int(np.argmax(x)) for x in own]


def test_network_gradients_equal_finite_differences():
    net, rng = small_network(), np.random.default_rng(2)
    x, y, share = rng.integers(0, 256, (7, 15)).astype(np.int64), rng.integers(0, 2, 7), rng.dirichlet(np.ones(7))

    def entropy():
        p = net.probabilities(net.pooled(x)[0])
        return -(share * np.log(p[np.arange(7), y])).sum()

    for values, grad in zip([*net.tables, net.weights, net.bias], language_id.gradients(net, x, y, share), strict=True):
        places = [tuple(p) for p in np.argwhere(np.abs(grad) > 1e-6)[:40]] + [tuple(rng.integers(0, n) for n in grad.shape)]
        for at in places:
            if values.ndim == 3 and at[1] == 256:
                continue
            old, step = values[at], 1e-6
            values[at] = old + step
            up = entropy()
            values[at] = old - step
            down = entropy()
            values[at] = old
            assert np.isclose((up - down) / (2 * step), grad[at], atol=1e-5)


def test_predictions_equal_plain_python_over_whole_texts(spark):
    net = small_network()
    texts = ["short é", "abc " * 300, "x" * 256, "y" * 257 + "é", None, "123", "", "word " * 30_000, "abc " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.x.lang_pred, r.x.score) for r in df.select("doc_id", language_id.predictor(net, spark)(F.col("text")).alias("x")).collect()}
    assert got[1] == got[8]
    for i, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        data, total = text.encode(), np.zeros(2)
        for at in range(0, len(data), language_id.WINDOW):
            own = [*data[at : at + language_id.WINDOW]]
            row = own + [256] * (language_id.WINDOW - len(own))
            top = [max(sum(t[j, row[p + j], f] for j in range(len(t))) for p in range(len(row) - len(t) + 1)) for t in net.tables for f in range(3)] if at < 4 * language_id.WINDOW or at + 2 * language_id.WINDOW > len(data) else net.pooled(np.array([row]))[0][0]
            logits = np.maximum(top, 0) @ net.weights + net.bias
            odds = np.exp(logits - logits.max())
            total += odds / odds.sum() * len(own)
        assert got[i][0] == net.labels[int(total.argmax())] and np.isclose(got[i][1], total.max() / total.sum())


def test_ordinal_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    features = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    flat, owner = np.concatenate(features), np.repeat(np.arange(40), [len(f) for f in features])
    y, share = rng.integers(0, 4, 40), rng.dirichlet(np.ones(40))
    w, raw = rng.normal(0, 0.5, 12), np.array([-0.7, 0.2, -0.4])
    sizes = rng.uniform(0.1, 1, len(flat))
    value = lambda: quality.loss(w, raw, flat, owner, sizes, y, share, 0.01)
    _, d_w, d_raw = value()
    for values, grad in ((w, d_w), (raw, d_raw)):
        for at in range(len(values)):
            old = values[at]
            values[at] = old + 1e-6
            up = value()[0]
            values[at] = old - 1e-6
            down = value()[0]
            values[at] = old
            assert np.isclose((up - down) / 2e-6, grad[at], atol=1e-6)


def test_ratings_equal_plain_python_over_whole_texts(spark):
    rng = np.random.default_rng(6)
    weighed = rng.random(1 << quality.BITS) < 0.7
    model = quality.Ordinal(rng.normal(0, 1, 1 << quality.BITS) * weighed, weighed, np.array([-0.5, 0.75]))
    texts = ["Plain words here.", "SPAM!!! $$$ 100% free", None, "", "é ü 123", "long text " * 50_000 + "END!!!", "Plain words here."]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, _rating string").repartition(2)
    out = {r.doc_id: r for r in quality.rated(df, model).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        words = set(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-/:-@\[-`]+", raw.lower()))
        kinds = [sum(33 <= b < 127 and not chr(b).isalnum() for b in raw), sum(48 <= b < 58 for b in raw), sum(65 <= b <= 90 for b in raw)]
        words |= {b"\0%d %d" % (k + 1, min(9, int(20 * n / max(1, len(raw))))) for k, n in enumerate(kinds)}
        own = [f for f in {zlib.crc32(x) & ((1 << quality.BITS) - 1) for x in words} if weighed[f]]
        score = sum(model.weights[f] for f in own) / max(1, len(own)) ** 0.5
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert np.isclose(out[i].expected_grade, sum(tails)) and np.isclose(out[i].tail_prob, tails[1]) and out[i]._rating == "mine"
        assert out[i].kept == (out[i].tail_prob >= quality.KEEP)


def test_features_with_a_weight_equal_a_count_by_hand(spark):
    rows = list(grades(300))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "spam!!! twice")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = quality.learned(docs, ratings)
    own = quality.Features()
    sample = [(own.of(t), g) for i, t, g in [*rows, (7, "spam!!! twice", 1)] if zlib.crc32(str(i).encode()) % 5 != 1]
    want = quality.fit([f for f, _ in sample], np.array([g for _, g in sample]))
    assert np.allclose(model.weights, want.weights, atol=1e-3) and np.allclose(model.thresholds, want.thresholds, atol=1e-3)
