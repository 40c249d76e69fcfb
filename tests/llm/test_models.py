"""The models against plain versions of them: kernel ridge, log-count ratios, neighbours' votes."""

import math
from collections import Counter

import numpy as np

from ledgerloom.llm import language, quality, toxicity
from ledgerloom.llm import features as grams_of
from ledgerloom.llm.features import character_hashes


def texts(seed, n, letters):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), int(rng.integers(20, 60)))) for _ in range(n)]


def test_language_scores_are_those_of_kernel_ridge_regression():
    """With every text a landmark the Nystrom map loses nothing: weighted kernel ridge regression in its dual form."""
    rows = texts(1, 30, "abcd ") + texts(2, 20, "cdefg ")
    langs = ["x"] * 30 + ["y"] * 20
    features = np.stack([language.presence(t) for t in rows])
    model = language.Model.fit(features, langs, landmarks=100, ridge=1e-2)
    assert model.languages == ["x", "y"]
    sets = [set(np.flatnonzero(f)) for f in features]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    w = np.array([1 / langs.count(g) for g in langs])
    w /= w.mean()
    y = np.array([1.0 if g == "x" else -1.0 for g in langs])
    dual = np.linalg.solve(k + 1e-2 * len(rows) * np.diag(1 / w), y)
    new = texts(3, 10, "abcdefg ")
    want = [sum(a * kernel(set(np.flatnonzero(language.presence(t))), s) for a, s in zip(dual, sets, strict=True)) for t in new]
    got = model.scores(new)
    assert np.allclose(got[:, 0], want, atol=2e-3) and np.allclose(got[:, 1], -got[:, 0], atol=2e-3)


def test_every_language_is_learned(spark):
    """More languages than landmarks, each with a script of its own."""
    rows = [(8 * k + i + 1, "".join(chr(0x4E00 + 40 * k + (7 * i + j) % 40) for j in range(60)), f"l{k:03}") for k in range(300) for i in range(8)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and len(model.landmarks) <= language.MAX_LANDMARKS
    scores = model.scores([t for _, t, _ in rows[::8]])
    right = sum(model.languages[i] == g for i, (_, _, g) in zip(scores.argmax(1), rows[::8], strict=True))
    assert right > 270


def hashed(text, orders, bits):
    return {int(h) for n in orders for part in character_hashes(text.lower(), n, bits) for h in part}


def test_character_grams_are_of_code_points(monkeypatch):
    """Equal grams of any script hash equally wherever they stand and however the text is cut; others hardly ever."""
    text = "añb漢字😀x" * 40 + "ß漢字😀x end"
    for n in (4, 5):
        whole = np.concatenate(list(character_hashes(text, n, 30)))
        assert len(whole) == len(text) - n + 1
        of = {}
        for i, h in enumerate(whole.tolist()):
            assert of.setdefault(text[i : i + n], h) == h
        assert len(set(of.values())) == len(of)
        monkeypatch.setattr(grams_of, "_STEP", 7)
        assert np.array_equal(np.concatenate(list(character_hashes(text, n, 30))), whole)
        monkeypatch.undo()
        assert list(character_hashes("漢" * (n - 1), n, 30)) == []


def test_toxicity_ratios_and_scores_by_hand():
    rows = texts(4, 40, "abcd ") + texts(5, 30, "bcdex ")
    label = [0] * 40 + [1] * 30
    counts = np.zeros((2, 1 << toxicity.BITS), np.int32)
    for t, y in zip(rows, label, strict=True):
        counts[y, toxicity.grams(t)] += 1
    seen = [Counter(g for t, y in zip(rows, label, strict=True) if y == k for g in hashed(t, toxicity.ORDERS, toxicity.BITS)) for k in (0, 1)]
    ratio, kept = toxicity.log_count_ratios(counts, np.array([40, 30]))
    for g in list(seen[0])[:200] + list(seen[1])[:200]:
        assert math.isclose(ratio[g], math.log((seen[1][g] + 1) / 32) - math.log((seen[0][g] + 1) / 42), rel_tol=1e-9)
    x = np.stack([np.isin(kept, toxicity.grams(t)) for t in rows]).astype(np.uint8)
    y = np.array(label, float)
    w, b = toxicity.logistic(x, ratio[kept], y, steps=4000)
    z = x @ (w * ratio[kept]) + b  # at the optimum the gradient is zero
    miss = 1 / (1 + np.exp(-z)) - y
    assert np.abs((x.T @ miss) * ratio[kept] / len(y) + w / len(y)).max() < 1e-3 and abs(miss.mean()) < 1e-3
    kept, w = kept[:50], w[:50]
    model = toxicity.Model(kept, w * ratio[kept], b, ratio, 0.7)
    weight = dict(zip(kept.tolist(), (w * ratio[kept]).tolist(), strict=True))
    for t in texts(6, 10, "abcdex ") + [""]:
        every = [int(h) for n in toxicity.ORDERS for part in character_hashes(t.lower(), n, toxicity.BITS) for h in part]
        s = b + sum(weight.get(g, 0.0) for g in set(every))
        s += 0.7 * sum(0.0 if g in weight else ratio[g] for g in every) / max(1, len(every))
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-s)), rel_tol=1e-5)
    assert model.score(None) == model.score("")


def test_quality_votes_are_those_of_the_nearest_by_cosine():
    rows = texts(7, 60, "abcdefg .,") + texts(8, 60, "xyz!?#")
    labels = np.array([1] * 60 + [0] * 60)
    x = np.stack([quality.terms(t) for t in rows])
    model = quality.Model.fit(x, labels, dimensions=8)
    new = texts(9, 15, "abcxyz.!") + ["", None]
    got = model.scores(new)
    for t, s in zip(new, got, strict=True):
        v = (quality.terms(t) * model.weights) @ model.axes
        v = v / max(float(np.linalg.norm(v)), 1e-9)
        near = sorted(((float(np.dot(v, u)), i) for i, u in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 1e-6) for c, _ in near]
        want = sum(w * labels[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(s - want) < 1e-4
