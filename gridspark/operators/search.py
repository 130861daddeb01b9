"""Small searches on the driver: golden section for one number, a simplex for a few."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def golden(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-6) -> float:
    """Where a function of one number is least between two bounds, if it has one dip there."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def simplex(f: Callable[[np.ndarray], float], start, step: float = 0.5, evaluations: int = 400, tolerance: float = 1e-8) -> tuple[np.ndarray, float, int, bool]:
    """Least point, value, evaluations and whether the simplex shrank to the tolerance, by reflection, expansion,
    contraction and shrinking."""
    points = [np.asarray(start, float)]
    points += [points[0] + step * e for e in np.eye(len(points[0]))]
    values = [f(p) for p in points]
    n = len(points)
    while n < evaluations:
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance and max(np.abs(p - points[0]).max() for p in points) < math.sqrt(tolerance):
            return points[0], values[0], n, True
        middle = np.mean(points[:-1], axis=0)
        away = middle - points[-1]
        tried = middle + away
        value = f(tried)
        n += 1
        if value < values[0]:
            further = middle + 2 * away
            there = f(further)
            n += 1
            points[-1], values[-1] = (further, there) if there < value else (tried, value)
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            inner = middle + (0.5 if value < values[-1] else -0.5) * away
            there = f(inner)
            n += 1
            if there < min(value, values[-1]):
                points[-1], values[-1] = inner, there
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                n += len(points) - 1
    best = int(np.argmin(values))
    return points[best], values[best], n, False
