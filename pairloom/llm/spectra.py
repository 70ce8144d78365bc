"""Eigendecompositions that grow by one vector at a time, with numpy.

``rank_one`` turns the eigenpairs of M into those of M + z z' by the secular
equation; a ``Spectrum`` keeps those of a centred scatter matrix."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps

#: updates between two re-orthonormalisations of the basis
STEADY = 1024


def _deflated(d, z, u):
    """Which entries of ``z`` change an eigenpair.  Tiny ones change nothing;
    of two (nearly) equal eigenvalues a rotation frees one.  ``d`` ascending;
    all three are changed in place."""
    norm = np.linalg.norm(z)
    tol = 8 * EPS * max(abs(d[-1]), norm * norm)
    live = np.abs(z) * norm > tol
    at = np.flatnonzero(live)
    if at.size > 1:
        a, b = z[at[:-1]], z[at[1:]]
        if (np.diff(d[at]) * np.abs(a * b) <= tol * (a * a + b * b)).any():
            p = at[0]
            for i in at[1:]:
                r = np.hypot(z[p], z[i])
                c, s = z[i] / r, z[p] / r
                if (d[i] - d[p]) * abs(c * s) <= tol:
                    z[i], z[p], live[p] = r, 0.0, False
                    u[:, p], u[:, i] = c * u[:, p] - s * u[:, i], s * u[:, p] + c * u[:, i]
                    d[p], d[i] = d[p] * c * c + d[i] * s * s, d[p] * s * s + d[i] * c * c
                p = i
    return live


def secular_roots(d, z):
    """The roots of 1 + sum(z_i^2 / (d_i - x)) = 0 for ascending distinct ``d``
    and nonzero ``z``, one in each gap and one beyond the last: as differences
    ``d_i - root_j`` (row j), each from the nearer pole, so that none cancels.
    All roots advance together by rational steps, kept inside by bisection."""
    k, z2 = d.size, z * z
    total = z2.sum()
    if k == 1:
        return np.array([[-total]])
    right = np.append(d[1:], d[-1] + total)
    half = (right - d) / 2
    gap = d[None, :] - d[:, None]
    value = 1 + (z2 / (gap - half[:, None])).sum(1)
    low = value >= 0  # the root lies in the left half
    low[-1] = True
    origin = np.arange(k) + ~low
    delta = d[None, :] - d[origin][:, None]
    lo = np.where(low, 0.0, -half)
    hi = np.where(low, half, 0.0)
    hi[-1] = total
    x = (lo + hi) / 2
    lower = np.tri(k, dtype=bool)
    j = np.arange(k - 1)
    for _ in range(80):
        away = delta - x[:, None]
        term = z2 / away
        slope = term / away
        f = 1 + term.sum(1)
        done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(term).sum(1))
        if done.all():
            break
        hi = np.where(f >= 0, x, hi)
        lo = np.where(f <= 0, x, lo)
        low_slope = np.where(lower, slope, 0).sum(1)
        high_slope = slope.sum(1) - low_slope
        near = np.append(away[j, j], away[-1, -1])
        far = np.append(away[j, j + 1], 0.0)
        c = f - low_slope * near - high_slope * far
        a = f * (near + far) - near * far * (low_slope + high_slope)
        b = f * near * far
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = near[-1] + low_slope[-1] * near[-1] ** 2 / c[-1]
            new = x + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        x = np.where(done | (step == 0), x, new)
    return delta - x[:, None]


def rank_one(d, u, v):
    """Eigenvalues (ascending) and eigenvectors of ``u diag(d) u' + v v'``."""
    d, u, z = d.copy(), u.copy(), u.T @ v
    if not z.any():
        return d, u
    live = _deflated(d, z, u)
    at = np.flatnonzero(live)
    if at.size:
        order = at[np.argsort(d[at], kind="stable")]
        dk, zk = d[order], z[order]
        away = secular_roots(dk, zk)  # [root, pole]
        # the z whose exact roots these are: its vectors are orthogonal
        between = dk[None, :] - dk[:, None]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs(away / between).prod(0)) * np.sign(zk)
        w = (exact / away).T
        w /= np.linalg.norm(w, axis=0)
        u[:, order] = u[:, order] @ w
        near = np.abs(away).argmin(1)
        d[order] = dk[near] - away[np.arange(order.size), near]
    by = np.argsort(d, kind="stable")
    return d[by], u[:, by]


class Spectrum:
    """Count, mean and eigenpairs of the scatter (sum of centred outer
    products) of the vectors seen."""

    def __init__(self, dim: int, n: int = 0, mean=None, values=None, vectors=None):
        self.n = n
        self.mean = np.zeros(dim) if mean is None else mean
        self.values = np.zeros(dim) if values is None else values
        self.vectors = np.eye(dim) if vectors is None else vectors
        self.updates = 0

    def _grow(self, v):
        self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.updates += 1
        if self.updates % STEADY == 0:
            self.vectors = orthonormal(self.vectors)

    def add(self, x) -> None:
        """One more vector, by one rank-one update about the moving mean."""
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self._grow(off * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: "Spectrum") -> None:
        """The vectors of both: the other's scaled eigenvectors and the
        distance of the means come in as successive rank-one updates."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._grow(vector * np.sqrt(value))
        off, n = other.mean - self.mean, self.n + other.n
        self._grow(off * np.sqrt(self.n / n * other.n))
        self.mean, self.n = self.mean + off * (other.n / n), n


def orthonormal(u):
    """The basis made exact again: its QR factor, signs kept."""
    q, r = np.linalg.qr(u)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)
