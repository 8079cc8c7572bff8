"""A label model for weak supervision: labelers vote or abstain, and expectation-maximisation estimates how far to trust each.

The model is fitted on counts of vote patterns. There are at most 3 ** labelers patterns, however many rows there are,
so the counts are a small aggregate over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Votes: against, abstain, for.
VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of positives; rates[j, y, v]: how often labeler j gives vote VOTES[v] on class y."""

    prior: float
    rates: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds of the prior, and what each vote of each labeler adds to them."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.rates[:, 1, :]) - np.log(self.rates[:, 0, :])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bias, add = self.weights()
        return 1 / (1 + np.exp(-(bias + add[np.arange(votes.shape[1]), votes + 1].sum(axis=1))))


def fit(votes: np.ndarray, counts: np.ndarray, *, prior: float = 0.8, trust: float = 0.9, strength: float = 2.0, rounds: int = 500) -> LabelModel:
    """Estimate the prior and the labelers' rates from vote patterns (rows of -1, 0, 1) and how often each occurs.

    Before any data a labeler that votes is right with probability ``trust``, and rows that any labeler votes against
    start out as negatives; that belief weighs as ``strength`` rows a class and settles which class is which. From there
    the data decide: a labeler whose votes the others contradict ends with a low rate, down to one that counts for
    nothing or for the opposite. With no rows the model is the belief.
    """
    n = votes.shape[1]
    base = np.empty((n, 2, 3))
    base[:, 0], base[:, 1] = (trust, 0.5, 1 - trust), (1 - trust, 0.5, trust)
    base /= base.sum(axis=2, keepdims=True)
    model = LabelModel(prior, base)
    if not len(votes):
        return model
    hot = (votes[:, :, None] == np.array(VOTES)).astype(float)
    p = np.where((votes < 0).any(axis=1), 1 - trust, np.where((votes > 0).any(axis=1), trust, prior))
    for _ in range(rounds):
        on, off = counts * p, counts * (1 - p)
        seen = np.stack((np.einsum("i,ijv->jv", off, hot), np.einsum("i,ijv->jv", on, hot)), axis=1)
        rates = seen + strength * base
        rates /= rates.sum(axis=2, keepdims=True)
        share = (on.sum() + strength * prior) / (counts.sum() + strength)
        model = LabelModel(float(np.clip(share, 1e-6, 1 - 1e-6)), rates)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model
