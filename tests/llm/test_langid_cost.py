"""Labelling text does not add up what only learning needs, and gives the same marginals without it."""

import numpy as np

from siltstone.llm import langid


def test_labelling_leaves_the_expected_transitions_out(monkeypatch):
    rng = np.random.default_rng(2)
    count = np.array([3, 0, 7, 1])
    args = rng.normal(size=(11, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), np.cumsum(count) - count, count
    whole, pairs = langid.forward_backward(*args)
    alone, none = langid.forward_backward(*args, counted=False)
    assert np.array_equal(whole, alone) and abs(pairs.sum() - (2 + 6)) < 1e-9 and not none.any()

    seen, real = [], langid.forward_backward
    model = langid.fit(["the sun and the moon"] * 3 + ["der mond und die sonne"] * 3, ["en"] * 3 + ["de"] * 3)
    monkeypatch.setattr(langid, "forward_backward", lambda *a, **k: seen.append(k) or real(*a, **k))
    assert model.predict(langid.pa.array(["the moon and sun"]))[0] == ["en"] and seen == [{"counted": False}]
