"""Weak supervision shared by the toxicity and quality operators: a latent-class label model and a hashed linear scorer.

Both work on summaries and bounded samples: the label model on the number of documents with each pattern of votes (at most
2**voters rows, counted over all documents), the scorer on a sample whose size is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class LabelModel:
    """Voters that fire or don't; what each does in either class is found by expectation-maximisation.

    `hit[c, j]` is the chance that voter j fires in class c, `prior` that of class 1.  Voters that agree more often within a
    class than independence allows are correlated; each voter's evidence is divided by 1 + the sum of its correlations.
    """

    voters: list[str]
    hit: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    prior: float = 0.1
    absence: float = 1.0  # weight of a voter's silence; low where each voter looks for its own kind of case
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    discount: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def unpack(self, patterns: np.ndarray) -> np.ndarray:
        return ((patterns[:, None] >> np.arange(len(self.voters))[None, :]) & 1).astype(float)

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        v = self.unpack(patterns)
        gain = v @ (self.discount * np.log(self.hit[1] / self.hit[0])) + self.absence * ((1 - v) @ (self.discount * np.log((1 - self.hit[1]) / (1 - self.hit[0]))))
        return gain + np.log(self.prior / (1 - self.prior))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -30, 30)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, first_hit: tuple[float, float] = (0.01, 0.5), prior: float = 0.1, steadiness: float = 0.1, rounds: int = 60) -> LabelModel:
        """`counts` of documents by pattern; `gold[p, c]` of known ones among further documents.  `steadiness`: weight of
        `first_hit` and `prior` against the data, as a share of the documents."""
        m, v, total = len(self.voters), self.unpack(patterns), max(1.0, counts.sum())
        self.hit = np.array([[first_hit[0]] * m, [first_hit[1]] * m])
        self.prior, self.discount, self.correlations = prior, np.ones(m), np.zeros((m, m))
        gold = np.zeros((len(patterns), 2)) if gold is None else gold
        for turn in range(rounds):
            p = self.posterior(patterns)
            mass = np.stack([counts * (1 - p) + gold[:, 0], counts * p + gold[:, 1]])
            held = np.array([steadiness * total * (1 - prior), steadiness * total * prior])
            self.hit = (mass @ v + held[:, None] * np.array(first_hit)[:, None]) / np.maximum(mass.sum(1) + held, 1e-9)[:, None]
            self.hit = np.clip(self.hit, 1e-4, 1 - 1e-4)
            self.hit[1] = np.maximum(self.hit[1], self.hit[0] * 1.01).clip(None, 1 - 1e-4)
            self.prior = float(np.clip((mass[1].sum() + held[1]) / (mass.sum() + held.sum()), 1e-3, 0.5))
            if turn in (rounds // 3, 2 * rounds // 3):
                self._correlate(v, mass)
        return self

    def _correlate(self, v: np.ndarray, mass: np.ndarray) -> None:
        rho = np.zeros((v.shape[1], v.shape[1]))
        for c in (0, 1):
            w = mass[c] / max(mass[c].sum(), 1e-9)
            centred = v - w @ v
            cov = (centred * w[:, None]).T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            rho += cov / np.outer(sd, sd) / 2
        np.fill_diagonal(rho, 0)
        self.correlations = rho
        self.discount = 1 / (1 + np.maximum(rho, 0).sum(1))


@dataclass
class LinearScorer:
    """Logistic regression on hashed binary features."""

    size: int
    weights: np.ndarray
    bias: float

    def scores(self, indices: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[indices])])
        z = sums[offsets[1:]] - sums[offsets[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def parts(offsets: np.ndarray, most: int = 500_000):
    """Yield (first, last) documents so that a part has about `most` features: temporary arrays on the driver stay small."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def bucket_sums(indices: np.ndarray, offsets: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Of each bucket, the sum of the `weights` of the documents that have it; without weights their number."""
    total = np.zeros(size)
    for a, b in parts(offsets):
        each = None if weights is None else np.repeat(weights[a:b], np.diff(offsets[a : b + 1]))
        total += np.bincount(indices[offsets[a] : offsets[b]], weights=each, minlength=size)
    return total


def train_scorer(indices: np.ndarray, offsets: np.ndarray, target: np.ndarray, importance: np.ndarray, size: int, screen: float, lasso: float = 0.001, least_documents: int = 3, rounds: int = 200) -> LinearScorer:
    """Fit to soft targets by proximal gradient steps of falling size.

    Only features of `least_documents` or more whose own correlation with the target reaches `screen` are weighed; `lasso`
    thins them further.  Without documents the scorer says 0 (its bias is far below 0).
    """
    n = len(target)
    if not n:
        return LinearScorer(size, np.zeros(size), -20.0)
    importance = importance / importance.sum()
    share = float(importance @ target)
    seen = bucket_sums(indices, offsets, size)
    mass = np.maximum(bucket_sums(indices, offsets, size, importance), 1e-9)
    pull = np.abs(bucket_sums(indices, offsets, size, importance * (target - share))) / np.sqrt(mass)
    wanted = (seen >= least_documents) & (pull >= screen)
    names = np.flatnonzero(wanted)
    column_of = (np.cumsum(wanted) - 1).astype(np.int32)
    rows, columns = [], []
    for a, b in parts(offsets):
        own = indices[offsets[a] : offsets[b]]
        at = np.flatnonzero(wanted[own])
        columns.append(column_of[own[at]])
        rows.append((np.searchsorted(offsets, at + offsets[a], side="right") - 1).astype(np.int32))
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    d, scale = len(names), 1 / np.sqrt(mass[names])  # rare features move as fast as frequent ones
    w, bias = np.zeros(d), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    gw, gb = np.full(d, 1e-4), 1e-4
    for turn in range(rounds):
        z = np.bincount(rows, weights=w[columns], minlength=n) + bias
        slip = importance * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - target)
        grad = np.bincount(columns, weights=slip[rows], minlength=d) * scale
        gw = 0.9 * gw + 0.1 * grad * grad
        gb = 0.9 * gb + 0.1 * slip.sum() ** 2
        step = 0.3 / (1 + turn / 12)
        rate = step / (np.sqrt(gw) + 1e-3)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        bias -= step * slip.sum() / (np.sqrt(gb) + 1e-3)
    weights = np.zeros(size)
    weights[names] = w
    return LinearScorer(size, weights, bias)
