"""Exact binomial tails."""

from __future__ import annotations

import math


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at probability p, summed exactly."""
    if k >= n:
        return 1.0
    lg = math.lgamma
    return min(1.0, sum(math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))
