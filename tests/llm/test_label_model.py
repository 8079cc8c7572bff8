"""The label model on votes of labelers whose accuracies are known."""

import numpy as np
import pytest

from recordforge.llm.label_model import fit

ACCURACY = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5)


def planted(n, prior, accuracy, seed, silent=0.3):
    """Classes, and votes that are right with each labeler's accuracy where it doesn't abstain."""
    r = np.random.default_rng(seed)
    y = r.random(n) < prior
    right = r.random((n, len(accuracy))) < np.array(accuracy)
    votes = np.where(right == y[:, None], 1, -1)
    votes[r.random(votes.shape) < silent] = 0
    return y, votes


@pytest.mark.parametrize("prior", [0.5, 0.8])
def test_accuracies_are_found(prior):
    y, votes = planted(40000, prior, ACCURACY, 3)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit(patterns, counts.astype(float))
    assert abs(model.prior - prior) < 0.05
    for j, accuracy in enumerate(ACCURACY):
        for k, v in ((0, 0), (1, 2)):
            found = model.rates[j, k, v] / (model.rates[j, k, 0] + model.rates[j, k, 2])
            assert abs(found - accuracy) < 0.06, (j, k, found)
    said = model.posterior(votes) >= 0.5
    majority = np.where(votes.sum(axis=1) == 0, prior >= 0.5, votes.sum(axis=1) > 0)
    assert (said == y).mean() > (majority == y).mean() + 0.01


def test_a_labeler_that_others_contradict_is_overruled():
    y, votes = planted(20000, 0.8, (0.95, 0.9, 0.9, 0.9), 5, silent=0.0)
    false_alarm = np.where(np.random.default_rng(7).random(len(y)) < 0.2, -1, 0)  # whatever the class
    votes = np.column_stack((votes, false_alarm))
    model = fit(*(lambda p, c: (p, c.astype(float)))(*np.unique(votes, axis=0, return_counts=True)))
    row = np.array([[1, 1, 1, 1, -1]])
    assert model.posterior(row)[0] > 0.9
    assert abs(model.rates[4, 1, 0] - model.rates[4, 0, 0]) < 0.05


def test_no_rows_and_one_row():
    none = fit(np.empty((0, 3), dtype=np.int64), np.empty(0))
    assert none.posterior(np.array([[1, 1, 1], [-1, -1, -1]])).round().tolist() == [1, 0]
    one = fit(np.array([[1, 0, -1]]), np.array([1.0]))
    assert np.isfinite(one.posterior(np.array([[1, 0, -1], [0, 0, 0]]))).all()
