"""Scores of long texts under the recurrent model."""

import numpy as np

from barline.llm import language_model


def test_last_steps_of_long_texts_are_scored_together(monkeypatch):
    """A long text's last steps, with no other text beside it, went through all classes every 16 tokens."""
    words = np.arange(1, 3000, dtype=np.uint64)
    types = language_model.Types(words, np.arange(3000, 1, -1), 5, 7)
    net = language_model.fresh(types)
    rng = np.random.default_rng(2)
    net["ww"] = rng.normal(0, 0.3, net["ww"].shape).astype(np.float32)
    lengths = [0, 5, 4000, 17, 300, 0]
    at = np.append(0, np.cumsum(lengths))
    tokens = rng.integers(0, language_model.TYPES, at[-1])

    plain = language_model.log_probabilities
    want = []
    for a, b in zip(at[:-1], at[1:]):
        h, total = np.zeros((1, language_model.HIDDEN), np.float32), 0.0
        for token in [*tokens[a:b], types.end]:
            total += plain(net, h, np.array([token]))[0][0]
            h = language_model.advance(net, h, np.array([token]))[0]
        want.append(total)

    calls = []
    monkeypatch.setattr(language_model, "log_probabilities", lambda *a: calls.append(len(a[2])) or plain(*a))
    got = language_model.document_scores(net, tokens, at, types.end)
    assert np.allclose(got, want, rtol=1e-5)
    assert sum(calls) == sum(lengths) + len(lengths) and len(calls) <= 3


def test_a_window_needs_few_passes_over_its_rows(monkeypatch):
    """Rows of all classes are gathered once and put back once; large values still do not overflow."""
    types = language_model.Types(np.arange(2, 3000, dtype=np.uint64), np.arange(3000, 2, -1), 5, 7)
    net = language_model.fresh(types)
    rng = np.random.default_rng(2)
    net["ww"] += rng.normal(0, 0.5, net["ww"].shape).astype(np.float32)
    net["cw"] += rng.normal(0, 0.5, net["cw"].shape).astype(np.float32)
    h = rng.uniform(-1, 1, (700, language_model.HIDDEN)).astype(np.float32)
    tokens = rng.integers(0, language_model.TYPES, 700)
    limits, plain = [], language_model._low
    monkeypatch.setattr(language_model, "_low", lambda *a: limits.append(plain(*a)) or limits[-1])
    for scale, low in ((1, True), (300, False)):
        limits.clear()
        big = {k: v * scale if k in ("ww", "cw") else v for k, v in net.items()}
        gradient = {k: np.zeros_like(v) for k, v in big.items()}
        got, back = language_model.log_probabilities(big, h, tokens, gradient)
        assert limits == [low, low] and np.isfinite(back).all()
        for i in range(0, 700, 50):
            c, n = divmod(int(tokens[i]), language_model.WIDTH)
            want, slope = 0.0, 0.0
            for w, b, own in ((big["cw"], big["cb"], c), (big["ww"][c], big["wb"][c], n)):
                x = h[i].astype(np.float64) @ w + b
                p = np.exp(x - x.max())
                p /= p.sum()
                want += x[own] - x.max() - np.log(np.exp(x - x.max()).sum())
                slope = slope + w @ (p - (np.arange(len(x)) == own))
            assert np.isclose(got[i], want, rtol=1e-4, atol=1e-4)
            assert np.allclose(back[i], slope, rtol=1e-3, atol=1e-3 * scale)
