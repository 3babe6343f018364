"""Eigenvalues and eigenvectors of a growing scatter matrix: rank-one updates by the secular equation.

A spectrum describes ``n`` vectors: their exact sums, and the eigenvalues and eigenvectors (columns of ``basis``) of
their centred scatter matrix. Only directions that the vectors span are held, so a few vectors cost little.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    """``sums`` are Python integers or 64-bit ones, exact; ``values`` ascend."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, object), np.zeros(0), np.zeros((size, 0)))

    def add(self, rows: np.ndarray) -> None:
        """Take in integer vectors one by one: each is a rank-one update by its distance from the mean so far."""
        for row in rows:
            if self.n:
                away = row - (self.sums / self.n).astype(float)
                self.values, self.basis = updated(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
            self.sums = self.sums + row.astype(object)
            self.n += 1

    def join(self, other: Spectrum) -> None:
        """Take in another spectrum: its eigenpairs and the distance of the means, each a rank-one update."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.basis = other.n, other.sums, other.values, other.basis
            return
        for value, column in zip(other.values, other.basis.T, strict=True):
            self.values, self.basis = updated(self.values, self.basis, column * np.sqrt(max(value, 0.0)))
        away = (other.sums / other.n - self.sums / self.n).astype(float)
        weight = self.n / (self.n + other.n) * other.n
        self.values, self.basis = updated(self.values, self.basis, away * np.sqrt(weight))
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def updated(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis diag(values) basis^T + vector vector^T``, values ascending.

    A part of the vector outside the basis becomes a new direction with eigenvalue 0. Directions that the vector
    does not touch, and all but one of those that share an eigenvalue, are deflated: they stay as they are.
    """
    inner = basis.T @ vector
    rest = vector - basis @ inner
    missed = basis.T @ rest  # once more, for accuracy
    inner, rest = inner + missed, rest - basis @ missed
    size, outside = np.linalg.norm(vector), np.linalg.norm(rest)
    if not size:
        return values, basis
    if basis.shape[1] < basis.shape[0] and outside > 1e-13 * max(size, np.sqrt(values[-1]) if len(values) else 0.0):
        basis = np.column_stack([rest / outside, basis])
        values, inner = np.append(0.0, values), np.append(outside, inner)
    if not len(values):
        return values, basis
    tolerance = 8 * _EPS * max(values[-1], size * size)
    basis, inner = _without_repeats(values, basis, inner, tolerance)
    touched = np.flatnonzero(np.abs(inner) * size > tolerance)
    if not len(touched):
        return values, basis
    roots, turn = _secular(values[touched], inner[touched])
    values, basis = values.copy(), basis.copy()
    values[touched], basis[:, touched] = roots, basis[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def _without_repeats(values: np.ndarray, basis: np.ndarray, inner: np.ndarray,
                     tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Turn the directions of each repeated eigenvalue so that the vector touches the last of them alone."""
    far = np.diff(values) > tolerance
    if far.all():
        return basis, inner
    basis, inner = basis.copy(), inner.copy()
    edges = np.flatnonzero(np.concatenate([[True], far, [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        norm = np.linalg.norm(inner[a:b])
        if b - a == 1 or not norm:
            continue
        mirror = inner[a:b] / norm
        sign = 1.0 if mirror[-1] >= 0 else -1.0
        mirror[-1] += sign  # Householder: the vector goes to -sign * norm in the last direction
        basis[:, a:b] -= np.outer(basis[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
        inner[a:b] = 0.0
        inner[b - 1] = -sign * norm
    return basis, inner


def _secular(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(poles) + z z^T`` for distinct ascending poles and no zero in z.

    The roots of 1 + sum z_i^2 / (pole_i - x) lie one above each pole. All are sought at once, each as the distance
    from its nearer pole: a rational function with the poles on both sides gives the next guess, a bracket guards
    it. The vectors use the z that belongs to the roots found, which keeps them orthogonal.
    """
    k = len(poles)
    squares = z * z
    top = np.append(poles[1:], poles[-1] + squares.sum())
    if k == 1:
        return top, np.ones((1, 1))
    gaps = top - poles
    at_middle = 1 + (squares[:, None] / (poles[:, None] - poles - gaps / 2)).sum(axis=0)
    right = (at_middle < 0) & (np.arange(k) < k - 1)  # the last root has no pole above it
    origin = np.where(right, top, poles)
    away = poles[:, None] - origin
    low = np.where(right, -gaps / 2, np.where(at_middle < 0, gaps / 2, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0, gaps, gaps / 2))
    guess = (low + high) / 2
    below = np.triu(np.ones((k, k)))
    nearer = np.arange(k - 1)
    for _ in range(80):
        distance = away - guess
        inverse = 1 / distance
        value = 1 + squares @ inverse
        size = 1 + squares @ np.abs(inverse)
        inverse *= inverse
        slope = squares @ inverse
        psi = squares @ (inverse * below)
        low, high = np.where(value < 0, guess, low), np.where(value < 0, high, guess)
        here = distance[np.arange(k), np.arange(k)]
        step = np.empty(k)
        # inner roots: c + s / (pole - x) + S / (next pole - x) with the same value and slopes
        d, e, f = here[:-1], distance[nearer + 1, nearer], value[:-1]
        c = f - d * psi[:-1] - e * (slope - psi)[:-1]
        a, b = (d + e) * f - d * e * slope[:-1], d * e * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step[:-1] = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # the last root: c + s / (pole - x)
            rest = value[-1] - here[-1] * slope[-1]
            step[-1] = here[-1] + here[-1] ** 2 * slope[-1] / rest
        following = guess + step
        odd = ~((following > low) & (following < high))
        following = np.where(odd, (low + high) / 2, following)
        small = np.abs(value) <= 4 * _EPS * k * size
        done = small | (np.abs(following - guess) <= 2 * _EPS * np.abs(guess))
        guess = np.where(small, guess, following)
        if done.all():
            break
    distance = away - guess  # pole_j - root_i
    distance = np.where(distance == 0, np.finfo(float).tiny, distance)
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    # z_j^2 = prod_i (root_i - pole_j) / prod_{i != j} (pole_i - pole_j)
    ratio = distance / np.where(np.eye(k, dtype=bool), 1.0, between)
    weight = np.sqrt(np.abs(np.prod(ratio, axis=1)))
    vectors = np.copysign(weight, z)[:, None] / distance
    return origin + guess, vectors / np.linalg.norm(vectors, axis=0)
