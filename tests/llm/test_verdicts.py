"""Labels and scores of the learned operators against plain loops, and the ordinal model's gradient against differences."""

import math

import numpy as np
import pytest
from test_llm import EDGES, frame, rows

from auditlake.llm import langid, quality_classifier


def plain_prediction(net, text):
    """(label, score) by a convolution written out: every window, filter and place."""
    raw = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return langid.UNKNOWN, 0.0
    e = net.p["e"].astype(float)
    total, size = np.zeros(len(net.languages)), 0
    for start in range(0, len(raw), langid.WINDOW):
        part = raw[start : start + langid.WINDOW]
        x = list(part) + [0] * (langid.WINDOW - len(part))
        pooled = []
        for w in langid.WIDTHS:
            k, b = net.p[f"k{w}"].astype(float), net.p[f"b{w}"].astype(float)
            best = np.full(k.shape[2], -np.inf)
            for at in range(langid.WINDOW - w + 1):
                best = np.maximum(best, sum(e[x[at + j]] @ k[j] for j in range(w)))
            pooled.extend(max(v, 0.0) for v in best + b)
        z = np.array(pooled) @ net.p["o"].astype(float) + net.p["c"]
        total += len(part) * (z - z.max() - math.log(np.exp(z - z.max()).sum()))
        size += len(part)
    mean = np.exp(total / size - (total / size).max())
    mean /= mean.sum()
    return net.languages[int(mean.argmax())], float(mean.max())


def test_language_labels_and_scores_by_a_plain_convolution(spark):
    docs = frame(spark, rows())
    net = langid.train(docs.select("doc_id", "text", "lang"), steps=30)
    other = langid.Network(["aa", "bb", "cc"], seed=3)
    data = rows(12) + [(7000 + i, t) for i, (_, t) in enumerate(EDGES)] + [(7100, "ß"), (7101, "x" * 700), (7102, "12 34")]
    data = [(i, t[:1500] if t else t) for i, t in data]
    for model in (net, other):
        df = langid.predict(spark.createDataFrame(data, "doc_id long, text string"), model)
        got = {r.doc_id: (r.lang_pred, r.score) for r in df.collect()}
        for i, t in data:
            label, score = plain_prediction(model, t)
            assert got[i][1] == pytest.approx(score, abs=1e-4)
            assert got[i][0] == label or abs(score - 1 / len(model.languages)) < 1e-4


def test_fit_follows_the_gradient_of_the_likelihood():
    """One step over all texts is rate x g / sqrt(1e-4 + g^2): its g is the difference quotient of the weighted likelihood."""
    rng = np.random.default_rng(9)
    texts = [np.unique(rng.integers(0, 40, rng.integers(3, 30))).astype(np.int32) for _ in range(60)]
    grade = rng.integers(0, 3, 60)
    grade[:30] = 2  # grades that are not even
    model = quality_classifier.Ordinal(3).fit(texts, grade, epochs=1, batch=60, rate=0.1, decay=0.0, least_texts=1)
    start = quality_classifier.Ordinal(3)
    weight = (1 / np.bincount(grade))[grade]
    weight = weight / weight.mean() / 60
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def loss(w, theta):
        m = quality_classifier.Ordinal(3)
        m.w, m.theta = w, theta
        cum = np.concatenate([np.zeros((60, 1)), m.below(m.scores(np.concatenate(texts), first))], 1)
        return -(weight * np.log(cum[np.arange(60), grade + 1] - cum[np.arange(60), grade])).sum()

    def of_step(delta):
        u = -delta / 0.1
        return 0.01 * u / np.sqrt(np.maximum(1 - u * u, 1e-12))

    checked = 0
    for b in range(40):
        if abs(model.w[b]) < 0.0995:
            w = np.zeros(len(start.w))
            w[b] = 1e-4
            up = loss(w, start.theta)
            w[b] = -1e-4
            assert of_step(float(model.w[b])) == pytest.approx((up - loss(w, start.theta)) / 2e-4, rel=2e-2, abs=2e-5)
            checked += 1
    assert checked > 20
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-5
        g = (loss(np.zeros(len(start.w)), start.theta + step) - loss(np.zeros(len(start.w)), start.theta - step)) / 2e-5
        assert np.sign(start.theta[k] - model.theta[k]) == np.sign(g) and 0.1 * abs(g) / math.sqrt(1e-4 + g * g) == pytest.approx(abs(start.theta[k] - model.theta[k]), rel=1e-3)
