"""The learnt parts against what they are defined by: the risk by differences, the label model by Bayes' rule with known rates."""

import numpy as np
import pytest

from lexmill.llm import quality, toxicity


def sides(n=40, u=90, shift=1.0):
    rng = np.random.default_rng(6)
    return rng.normal(shift, 1, (n, quality.WIDTH)), rng.normal(0, 1, (u, quality.WIDTH))


@pytest.mark.parametrize("scale", [0.2, 3.0, -3.0])
def test_gradient_of_the_risk(monkeypatch, scale):
    seen = []
    plain = quality._train
    monkeypatch.setattr(quality, "_train", lambda grad, x, params: seen.append(grad) or plain(grad, x, params))
    positive, unlabelled = sides()
    model = quality.fit(positive, unlabelled, quality.QualityParams(epochs=3))
    prior, n = float(model["prior"]), len(positive)
    z = scale * np.random.default_rng(7).normal(size=n + len(unlabelled)) + (scale if scale < 0 else 0) * (np.arange(n + len(unlabelled)) >= n)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def parts(v):
        """Risk of positives, and of the rest taken as negatives without the positives' share."""
        return prior * sig(-v[:n]).mean(), sig(v[n:]).mean() - prior * sig(v[:n]).mean()

    # below zero the step goes back up the negative part alone
    value = (lambda v: sum(parts(v))) if parts(z)[1] >= 0 else (lambda v: -parts(v)[1])
    e = 1e-5
    want = [(value(z + e * np.eye(len(z))[i]) - value(z - e * np.eye(len(z))[i])) / (2 * e) for i in range(len(z))]
    assert np.allclose(seen[-1](z), want, atol=1e-8)


def test_negative_part_is_reached():
    z = np.r_[np.full(40, 5.0), np.full(90, -9.0)]
    sig = 1 / (1 + np.exp(-z))
    assert sig[40:].mean() - 0.3 * sig[:40].mean() < 0  # the case of the step back exists


def test_label_model_finds_rates_and_posteriors():
    rng = np.random.default_rng(8)
    n, share = 4000, 0.3
    true = np.array([[0.04, 0.03, 0.06, 0.02, 0.05], [0.6, 0.5, 0.7, 0.4, 0.55]])  # how often each voter fires, by class
    y = rng.random(n) < share
    votes = rng.random((n, 5)) < true[y.astype(int)]
    row, voter = np.nonzero(votes)
    q, rates, _ = toxicity.label_model(row, voter, n, 5, share)
    assert np.abs(rates - true).max() < 0.06
    # Bayes' rule with the true rates, of which no classifier can be better
    evidence = votes @ np.log(true[1] / true[0]) + ~votes @ np.log((1 - true[1]) / (1 - true[0])) + np.log(share / (1 - share))
    best = ((evidence > 0) == y).mean()
    assert ((q > 0.5) == y).mean() > best - 0.03 and q.mean() == pytest.approx(share, abs=0.01)


def test_copied_voters_do_not_count_twice():
    rng = np.random.default_rng(9)
    n = 3000
    y = rng.random(n) < 0.4
    own = rng.random((n, 3)) < np.where(y[:, None], 0.6, 0.05)
    noise = rng.random((n, 1)) < 0.15  # fires anywhere, and its four copies with it
    votes = np.hstack([own, np.repeat(noise, 5, axis=1)])
    q, _, corr = toxicity.label_model(*np.nonzero(votes), n, 8, 0.4)
    assert corr[3:, 3:].min() > 0.9 and ((q > 0.5) == y).mean() > 0.85
