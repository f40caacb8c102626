"""What is linked in a block of comparisons, told by few links."""

from __future__ import annotations

import numpy as np


def spanning(near: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Links (n, 2) that join whatever the pairs ``near[own, others]`` join.

    Few pairs are listed. Many are replaced: labels spread over them until they are
    stable, and each id is linked to its label, so that there is at most one link
    for each row and column.
    """
    rows, columns = np.nonzero(near)
    if len(rows) <= 4 * sum(near.shape):
        pairs = np.column_stack([own[rows], others[columns]])
        return pairs[pairs[:, 0] != pairs[:, 1]]
    top = np.iinfo(own.dtype).max
    linked = np.flatnonzero(near.any(0))
    near, others, label = near[:, linked], others[linked], own.copy()
    while True:
        across = np.minimum(np.where(near, label[:, None], top).min(0), others)
        back = np.minimum(np.where(near, across[None, :], top).min(1), label)
        if (back == label).all():
            break
        label = back
    pairs = np.concatenate([np.column_stack([own, label]), np.column_stack([others, across])])
    return pairs[pairs[:, 0] != pairs[:, 1]]
