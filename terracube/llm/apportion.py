"""Sainte-Laguë apportionment: seats go to the highest quotients votes / (2 * seats + 1)."""

from __future__ import annotations

import numpy as np


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Integer seats that sum to ``seats``; ties go to the lower index. Votes must be 0 or more.

    Seat ``j`` of party ``i`` has the price ``(2 j + 1) / votes[i]``; the cheapest ``seats`` seats are
    given out. Starting from the proportional share, only a few seats have to move, so the cost does
    not depend on the number of seats, and the result for ``n`` seats always contains that for fewer.
    """
    votes = np.asarray(votes, np.float64)
    out = np.zeros(len(votes), np.int64)
    live = np.flatnonzero(votes > 0)
    if not len(live) or seats <= 0:
        return out
    v = votes[live]
    at = int(seats)
    n = np.floor(v * (seats / v.sum()) + 0.5).astype(np.int64)
    n = np.maximum(n, 0)
    for _ in range(8):  # get near with whole steps first
        if abs(short := at - int(n.sum())) <= len(v):
            break
        n = np.maximum(n + np.floor(v * (short / v.sum()) + 0.5).astype(np.int64), 0)
    while True:
        short = at - int(n.sum())
        ask = (2 * n + 1) / v
        paid = np.where(n > 0, (2 * n - 1) / v, -1.0)
        cheap, dear = int(np.argmin(ask)), len(v) - 1 - int(np.argmax(paid[::-1]))
        if short > 0:
            n[cheap] += 1
        elif short < 0:
            n[dear] -= 1
        elif (ask[cheap], cheap) < (paid[dear], dear):
            n[cheap] += 1
            n[dear] -= 1
        else:
            break
    out[live] = n
    return out
