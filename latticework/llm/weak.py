"""The label model of the weak-supervision operators: labelers err independently, each with its own rates."""

from __future__ import annotations

import numpy as np


def reliabilities(ballot: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (0 abstains, 1 no, 2 yes) with counts n: P(vote | class) as [labeler, class, vote], P(yes), and each pattern's posterior.

    Starts from the majority, which fixes what the classes mean, and keeps counts smoothed, so that no labeler gets a zero.
    """
    yes, no = (ballot == 2).sum(1), (ballot == 1).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)
    table, prior = np.zeros((ballot.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        prior = ((post * n).sum() + 1) / (n.sum() + 2)
        for c, w in ((0, (1 - post) * n), (1, post * n)):
            for v in range(3):
                table[:, c, v] = ((ballot == v) * w[:, None]).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        odd = np.log(prior / (1 - prior)) + sum(np.log(table[i, 1, ballot[:, i]] / table[i, 0, ballot[:, i]]) for i in range(ballot.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odd, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            return table, prior, new
        post = new
    return table, prior, post


def accuracies(ballot: np.ndarray, n: np.ndarray, rounds: int = 200, trust: float = 0.8, strength: float = 10.0) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for labelers that may vote one way only: each has one accuracy, and an abstention says nothing.

    Returns accuracies, P(yes) and each pattern's posterior. Labelers are taken to be right more often than not (0.6 at least), which fixes what the classes mean; accuracies are drawn towards ``trust`` with the weight of ``strength`` votes; patterns without votes get the prior.
    """
    yes, no = ballot == 2, ballot == 1
    accuracy, prior, post = np.full(ballot.shape[1], trust), 0.5, np.full(len(n), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        odd = np.log(prior / (1 - prior)) + (yes.astype(float) - no) @ weight
        new = 1 / (1 + np.exp(-np.clip(odd, -30, 30)))
        right = ((yes * new[:, None] + no * (1 - new)[:, None]) * n[:, None]).sum(0) + trust * strength
        accuracy = np.clip(right / (((yes | no) * n[:, None]).sum(0) + strength), 0.6, 0.999)
        prior = float(np.clip((new * n).sum() / n.sum(), 0.01, 0.99))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return accuracy, prior, new
