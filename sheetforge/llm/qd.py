"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations.

All on one matrix of as many rows and columns as a vector has dimensions; what grows with the data never comes here.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, p) of a square matrix: diagonal and superdiagonal of U' r p, all not negative, by reflections from both sides; p is orthogonal."""
    m = r.astype(np.float64).copy()
    n = len(m)
    p = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """v with (I - 2 v v') x = a multiple of the first unit vector; None if x is that already."""
        if not np.abs(x[1:]).max(initial=0):
            return None
        v = x / np.abs(x).max()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for i in range(n):
        v = reflector(m[i:, i].copy())
        if v is not None:
            m[i:, i:] -= 2 * np.outer(v, v @ m[i:, i:])
        if i < n - 1:
            v = reflector(m[i, i + 1 :].copy())
            if v is not None:
                m[i:, i + 1 :] -= 2 * np.outer(m[i:, i + 1 :] @ v, v)
                p[:, i + 1 :] -= 2 * np.outer(p[:, i + 1 :] @ v, v)
    a, b = np.diag(m).copy(), np.diag(m, 1).copy()
    # signs of rows and columns make all entries not negative
    sign = 1.0
    for i in range(n):
        row = sign if a[i] >= 0 else -sign
        p[:, i] *= sign
        sign = row if i == n - 1 or b[i] >= 0 else -row
    return np.abs(a), np.abs(b), p


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds step; the third list has the d whose least bounds the smallest value from above (and tells a shift that was too large)."""
    n = len(q)
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for k in range(n - 1):
        ds[k] = d
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            new_e[k] = 0.0
            d = q[k + 1] - shift
            continue
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    ds[n - 1] = new_q[n - 1] = d
    return new_q, new_e, ds


def _two_by_two(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """Both values of a qd array of two, the larger first; the smaller by the product, so it keeps its digits."""
    if q1 == 0 or q2 == 0:
        return q1 + e1 + q2, 0.0
    t = 0.5 * (q1 - q2 + e1)
    root = math.hypot(t, math.sqrt(q2 * e1))
    large = q2 + t + root if t >= 0 else q2 + q2 * e1 / (root - t)
    return large, q1 * (q2 / large)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the upper bidiagonal (a, b), falling; small ones have full relative accuracy.

    Shifts: near the end of a run the trailing value of the last step is tried, and taken back if it was too large; else Newton's bound
    1 / sum(1 / d), which never is.
    """
    found: list[float] = []
    work = [(list(map(float, a * a)), list(map(float, b * b)), 0.0)]
    while work:
        q, e, base = work.pop()
        flips = 0
        for _ in range(30 * len(q) + 100):
            n = len(q)
            if n == 0:
                break
            if n == 1:
                found.append(max(q[0], 0.0) + base)
                q = []
                break
            if n == 2:
                found.extend(x + base for x in _two_by_two(*q[:1], *e, *q[1:]))
                q = []
                break
            if e[-1] <= _EPS * _EPS * (base + q[-1]):
                found.append(max(q[-1], 0.0) + base)
                q, e = q[:-1], e[:-1]
                continue
            if e[-2] <= _EPS * _EPS * (base + q[-2]):
                found.extend(x + base for x in _two_by_two(q[-2], e[-1], q[-1]))
                q, e = q[:-2], e[:-2]
                continue
            split = next((k for k in range(n - 1) if e[k] <= _EPS * _EPS * (base + min(q[k], q[k + 1]))), None)
            if split is not None:
                work.append((q[: split + 1], e[:split], base))
                q, e = q[split + 1 :], e[split + 1 :]
                flips = 0
                continue
            if flips < 2 and q[0] < 1.5 * q[-1]:
                # the small end to the back, where shifts work
                q, e = q[::-1], e[::-1]
                flips += 1
                continue
            plain_q, plain_e, ds = _sweep(q, e, 0.0)
            if min(ds) <= 0:
                q, e = plain_q, plain_e
                continue
            newton = 1.0 / sum(1.0 / d for d in ds)
            tries = [min(ds) * (1 - 4 * _EPS)] if ds[-1] == min(ds) else []
            if tries:
                _, _, over = _sweep(q, e, tries[0])
                if min(over[:-1]) > 0 and over[-1] < 0:
                    tries.append((tries[0] + over[-1]) * (1 - 4 * _EPS))
            tries.append(newton * (1 - 8 * _EPS * n))
            for shift in sorted((t for t in tries if t >= tries[-1]), reverse=True):
                new_q, new_e, got = _sweep(q, e, shift)
                if min(got) >= 0:
                    q, e, base = new_q, new_e, base + shift
                    break
            else:
                q, e = plain_q, plain_e
        if q:
            raise ArithmeticError("dqds did not settle")
    return np.sqrt(np.array(sorted(found, reverse=True)))


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, list[float], list[float], np.ndarray, np.ndarray]:
    """Stationary and progressive factorisations of B'B - value: (gamma, d of the first, d of the second, l, u)."""
    n = len(a)
    q, e = a * a, b * b
    tiny = np.finfo(float).tiny ** 0.5
    lower, upper = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    # B'B = L D L' with D = a^2 and l = b / a; l^2 D = b^2
    up, down = [0.0] * n, [0.0] * n
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i]
        d = d if abs(d) > tiny else math.copysign(tiny, d)
        up[i] = d
        lower[i] = a[i] * b[i] / d
        s[i + 1] = (e[i] / d) * s[i] - value if q[i] else -value
        if q[i] == 0:
            s[i + 1] = e[i] - value
    up[n - 1] = s[n - 1] + q[n - 1]
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        d = e[i] + p[i + 1]
        d = d if abs(d) > tiny else math.copysign(tiny, d)
        down[i + 1] = d
        upper[i] = a[i] * b[i] / d
        p[i] = (p[i + 1] * (q[i] / d) if e[i] else q[i]) - value
    down[0] = p[0]
    return s + p + value, up, down, lower, upper


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal, as columns, in the order of ``values``.

    Each is the twist of the two factorisations at the least pivot. Values that agree to three digits share a group, whose vectors are made
    orthogonal one after the other, with steps of inverse iteration.
    """
    n = len(a)
    full = np.diag(a) + np.diag(b, 1) if n > 1 else np.diag(a)
    gram = full.T @ full
    scale = max(float(values.max(initial=0)) ** 2, np.finfo(float).tiny)
    out = np.zeros((n, len(values)))
    random = np.random.default_rng(0)
    start = 0
    for j, sigma in enumerate(values):
        value = float(sigma) ** 2
        if j and values[j - 1] ** 2 - value > 1e-3 * values[j - 1] ** 2:
            start = j
        gamma, _, _, lower, upper = _twisted(a, b, value)
        group = out[:, start:j]
        z = None
        for at in np.argsort(np.abs(gamma), kind="stable")[: 1 + j - start]:
            z = np.zeros(n)
            z[at] = 1.0
            for i in range(at - 1, -1, -1):
                z[i] = -lower[i] * z[i + 1]
            for i in range(at, n - 1):
                z[i + 1] = -upper[i] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= group @ (group.T @ z)
            if np.linalg.norm(z) > 0.1:
                break
        else:
            z = random.normal(size=n)
        if j > start:
            for _ in range(3):
                for _ in range(2):
                    z -= group @ (group.T @ z)
                z /= np.linalg.norm(z)
                z = np.linalg.solve(gram - (value - 2 * _EPS * scale) * np.eye(n), z)
            for _ in range(2):
                z -= group @ (group.T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of a square matrix."""
    size = float(np.abs(r).max(initial=0))
    if not size:
        return np.zeros(len(r)), np.eye(len(r))
    a, b, p = bidiagonalise(r / size)
    # entries that no digit of the matrix reaches are zero: then the matrix falls into parts
    b[b <= _EPS * float(max(a.max(), b.max(initial=0))) * 1e-3] = 0.0
    values = dqds(a, b)
    return values * size, p @ right_vectors(a, b, values)
