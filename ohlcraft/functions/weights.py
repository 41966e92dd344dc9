"""Weight vectors of the weighted averages, oldest value first."""

from __future__ import annotations

import math


def _norm(w: list[float]) -> list[float]:
    total = sum(w)
    return [v / total for v in w]


def linear(n: int, asc: bool = True) -> list[float]:
    w = [float(i) for i in range(1, n + 1)]
    return _norm(w if asc else w[::-1])


def gauss(n: int, sigma: float, offset: float) -> list[float]:
    centre = offset * (n - 1)
    return _norm([math.exp(-0.5 * (sigma / n * (i - centre)) ** 2) for i in range(n)])


def fibonacci(n: int, asc: bool = True) -> list[float]:
    w = [1.0, 1.0]
    while len(w) < n:
        w.append(w[-1] + w[-2])
    w = w[:n]
    return _norm(w if asc else w[::-1])


def pascal(n: int, asc: bool = True) -> list[float]:
    w = [float(math.comb(n - 1, k)) for k in range(n)]
    return _norm(w if asc else w[::-1])


def sine(n: int) -> list[float]:
    return _norm([math.sin(i * math.pi / (n + 1)) for i in range(1, n + 1)])


def triangle(n: int) -> list[float]:
    return _norm([float(min(i, n + 1 - i)) for i in range(1, n + 1)])
