"""The label model finds the rules' accuracies and the classes behind the votes."""

import numpy as np

from stationproof.operators import labels


def test_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    share, n = np.array([0.7, 0.2, 0.1]), 60_000
    truth = rng.choice(3, n, p=share)
    right, silent = [0.9, 0.8, 0.7, 0.85, 0.75], [0.1, 0.3, 0.2, 0.5, 0.4]
    cast = np.zeros((n, 5), int)
    for j in range(5):
        wrong = (truth + rng.integers(1, 3, n)) % 3
        answer = np.where(rng.random(n) < right[j], truth, wrong) + 1
        cast[:, j] = np.where(rng.random(n) < silent[j], 0, answer)
    seen, at, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    got, table, post = labels.estimate(seen, counts.astype(float))
    assert np.abs(got - share).max() < 0.03
    for j in range(5):
        said = table[j, range(3), range(1, 4)] / (1 - table[j, :, 0])
        assert np.abs(said - right[j]).max() < 0.06
    assert (post.argmax(axis=1)[at.ravel()] == truth).mean() > 0.9
