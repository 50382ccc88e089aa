"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

LDL' factors of the shifted matrix count the eigenvalues above a shift
(Sylvester's law of inertia). Bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration with the same factors converges to it,
and two more counts certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = float(np.finfo(float).eps)
PIVOT = (1 + 17**0.5) / 8  # Bunch and Kaufman's bound on the growth of entries


class Factors:
    """P(A - shift I)P' = L D L' with blocks of one and two rows in D."""

    def __init__(self, matrix: np.ndarray, shift: float):
        a = matrix - shift * np.eye(len(matrix))
        n = len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        self.least = EPS * max(float(np.abs(a).max()), float(np.finfo(float).tiny) / EPS)

        def swap(i: int, j: int) -> None:
            if i != j:
                a[[i, j]] = a[[j, i]]
                a[:, [i, j]] = a[:, [j, i]]
                self.lower[[i, j], :k] = self.lower[[j, i], :k]
                self.order[[i, j]] = self.order[[j, i]]

        k = 0
        while k < n:
            size = 1
            below = np.abs(a[k + 1 :, k])
            if below.size and (most := below.max()) > 0 and abs(a[k, k]) < PIVOT * most:
                r = k + 1 + int(below.argmax())
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if abs(a[k, k]) * row.max() < PIVOT * most**2:
                    if abs(a[r, r]) >= PIVOT * row.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
            block = a[k : k + size, k : k + size].copy()
            if size == 1 and abs(block[0, 0]) < self.least:
                block[0, 0] = self.least
            rest = a[k + size :, k : k + size].copy()
            part = np.linalg.solve(block, rest.T).T
            self.lower[k + size :, k : k + size] = part
            a[k + size :, k + size :] -= part @ rest.T
            self.blocks.append((k, block))
            k += size

    def above(self) -> int:
        """How many eigenvalues lie above the shift."""
        return sum(int((np.linalg.eigvalsh(block) > 0).sum()) if len(block) > 1 else int(block[0, 0] > 0) for _, block in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.order].copy()
        for i in range(1, len(y)):
            y[i] -= self.lower[i, :i] @ y[:i]
        for k, block in self.blocks:
            y[k : k + len(block)] = np.linalg.solve(block, y[k : k + len(block)])
        for i in range(len(y) - 2, -1, -1):
            y[i] -= self.lower[i + 1 :, i] @ y[i + 1 :]
        x = np.empty_like(y)
        x[self.order] = y
        return x


@dataclass(frozen=True)
class Pair:
    value: float
    vector: np.ndarray


class Slicer:
    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.scale = float(np.abs(matrix).sum(axis=1).max())
        self.tiny = 8 * EPS * self.scale * max(1, len(matrix) ** 0.5)
        top = self.scale * (1 + 1e-9)
        self.counts = {-top: len(matrix), top: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = Factors(self.matrix, shift).above()
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the k-th largest eigenvalue."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """Halve the bracket until it holds one eigenvalue, or equal ones to working precision."""
        low, high = self.bracket(k)
        while (self.counts[low] > k or self.counts[high] < k - 1) and high - low > self.tiny:
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        return low, high

    def pair(self, k: int, found: list[Pair]) -> Pair:
        low, high = self.isolate(k)
        others = np.array([p.vector for p in found]).reshape(len(found), len(self.matrix))

        def free(v: np.ndarray) -> np.ndarray:
            for _ in range(2 if len(found) else 0):
                v = v - others.T @ (others @ v)
            return v / np.linalg.norm(v)

        v = free(np.random.default_rng(k).standard_normal(len(self.matrix)))
        shift = (low + high) / 2
        for _ in range(200):
            v = free(Factors(self.matrix, shift).solve(v))
            image = self.matrix @ v
            value = float(v @ image)
            error = float(np.linalg.norm(image - value * v))
            inside = low - self.tiny <= value <= high + self.tiny
            if inside and error <= self.tiny:
                gap = 2 * max(error, self.tiny)
                if self.above(value + gap) <= k - 1 and self.above(value - gap) >= k:
                    return Pair(value, v)
            if not inside and high - low > self.tiny:
                self.above((low + high) / 2)
                low, high = self.bracket(k)
            shift = value if inside else (low + high) / 2
        raise ArithmeticError(f"eigenvalue {k} is not certified")


def leading_pairs(matrix: np.ndarray, k: int) -> list[Pair]:
    """The ``k`` largest eigenvalues with unit vectors, falling; all if there are fewer."""
    k = min(k, len(matrix))
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    if scale == 0:
        return [Pair(0.0, row) for row in np.eye(len(matrix))[:k]]
    slicer = Slicer(matrix / scale)
    found: list[Pair] = []
    for i in range(1, k + 1):
        found.append(slicer.pair(i, found))
    return [Pair(p.value * scale, p.vector) for p in found]
