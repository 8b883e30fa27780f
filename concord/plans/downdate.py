"""Complete-case fits without one row each, from the fit of all rows.

In the basis that makes the penalized cross products of all rows the identity and their
shared problem diagonal, leaving a row out changes each table's matrix by a rank-one term and,
because variables are scaled anew, by a small term of penalty times squared values. The top
pairs of the changed problem are found by Rayleigh-Ritz steps from those of all rows, whose
corrections invert the rank-one terms exactly, so a row costs O(P^2) and not O(P^3). An
eigenvalue count by the signs of a Schur complement proves that no larger pair was missed.
Rows of which that cannot be proven are reported and left to the dense solver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Residuals against the least gap between eigenvalues; what the components' errors follow.
TOLERANCE = 1e-9
#: Rayleigh-Ritz steps before a row is left to the dense solver.
STEPS = 6
#: A row that takes away more than this share of a table's matrix is left to the dense solver.
MOST = 0.5


@dataclass
class Whole:
    """The fit of all ``m`` rows for one set of penalties. ``basis``: P x P, with basis' B basis
    the identity and basis' G basis diag(``values``), largest first; ``image``: G basis."""

    values: np.ndarray
    basis: np.ndarray
    image: np.ndarray
    diagonal: np.ndarray
    starts: np.ndarray
    lam: tuple[float, ...]
    m: int
    nfac: int

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, nfac) outer explained variance of the fits without each of the z-scored
        ``rows``, and which of them are proven."""
        k, count, take = self.nfac, len(rows), self.m / (self.m - 1)
        tables = list(zip(self.starts, self.starts[1:]))
        own = np.stack([rows[:, a:b] @ self.basis[a:b] for a, b in tables], axis=2)  # rows, P, tables
        every = own.sum(axis=2)
        lam = np.concatenate([np.full(b - a, v) for (a, b), v in zip(tables, self.lam)])
        left = self.diagonal - take * rows**2  # squared deviations without the row
        loss = np.where(lam > 0, take * rows**2 / self.diagonal, 0.0).max(axis=1)
        proven = take * (own**2).sum(axis=1).max(axis=1) + loss < MOST
        weight = lam * take / (self.m - 2) * rows**2
        out = np.zeros((count, k))
        at = np.flatnonzero(proven)
        if not len(at):
            return out, proven
        own, every, weight, loss = own[at], every[at], weight[at], loss[at]

        def both(c):
            a = self.values[:, None] * c - take * every[:, :, None] * (every[:, None, :] @ c)
            b = c - take * own @ (np.swapaxes(own, 1, 2) @ c)
            if any(self.lam):
                b -= self.basis.T @ (weight[:, :, None] * (self.basis @ c))
            return a, b

        size = k + 2
        space = np.broadcast_to(np.eye(len(self.values), size), (len(at), len(self.values), size))
        for step in range(STEPS):
            q = np.linalg.qr(space)[0] if step else space
            a, b = both(q)
            qt = np.swapaxes(q, 1, 2)
            lower = np.linalg.inv(np.linalg.cholesky(qt @ b))
            inner = lower @ (qt @ a) @ np.swapaxes(lower, 1, 2)
            theta, y = np.linalg.eigh((inner + np.swapaxes(inner, 1, 2)) / 2)
            theta, y = theta[:, ::-1][:, :size], np.swapaxes(lower, 1, 2) @ y[:, :, ::-1][:, :, :size]
            x, ax, bx = q @ y, a @ y, b @ y
            missed = ax[:, :, :k] - theta[:, None, :k] * bx[:, :, :k]
            gap = (theta[:, :k] - theta[:, 1 : k + 1]).min(axis=1)
            good = np.sqrt((missed**2).sum(axis=1)).max(axis=1) <= TOLERANCE * gap
            if good.all() or step == STEPS - 1:
                break
            new = [x]
            for j in range(k):
                new.append(self._inverted(own, theta[:, j], take, np.stack([missed[:, :, j], bx[:, :, j]], axis=2)))
            space = np.concatenate(new, axis=2)
        good &= theta[:, k - 1] > 1e-10 * np.maximum(theta[:, 0], 1e-300)
        good &= self._larger(own, theta[:, k - 1] - 1e-6 * gap, loss, take) == k
        loadings = self.basis @ x[:, :, :k]
        cov = self.image @ x[:, :, :k] - take * rows[at][:, :, None] * (rows[at][:, None, :] @ loadings)
        spread = (x[:, :, :k] * ax[:, :, :k]).sum(axis=1)
        out[at] = (cov**2 / (left[at][:, :, None] * spread[:, None, :])).sum(axis=1) / len(self.values)
        proven[at] = good
        return out, proven

    def _inverted(self, own, theta, take, right):
        """(A - theta B)^-1 of the columns of ``right``, without the penalty's small term; of
        length one, because only the directions matter."""
        d = self.values[None, :] - theta[:, None]
        d = 1 / np.where(np.abs(d) < 1e-13, 1e-13, d)
        n = own.shape[2]
        middle = take * (theta[:, None, None] * np.eye(n) - np.ones((n, n)))
        t = np.swapaxes(own, 1, 2) @ (d[:, :, None] * own)
        y = d[:, :, None] * right
        y = y - d[:, :, None] * (own @ np.linalg.solve(np.eye(n) + middle @ t, middle @ (np.swapaxes(own, 1, 2) @ y)))
        y = np.nan_to_num(y, posinf=0.0, neginf=0.0)
        return y / np.maximum(np.sqrt((y**2).sum(axis=1, keepdims=True)), 1e-300)

    def _larger(self, own, shift, loss, take):
        """At least as many as there are eigenvalues above ``shift``: -1 if it cannot be told.
        The penalty's term is at most ``loss`` of the whole, so the count is of a diagonal matrix
        with one rank-one term a table, whose signs a matrix of tables x tables adds."""
        n = own.shape[2]
        d = self.values[None, :] - (shift * (1 - loss))[:, None]
        clear = (np.abs(d) > 1e-14).all(axis=1) & (shift > 1e-12) & (np.abs(shift - n) > 1e-9)
        d, shift = np.where(clear[:, None], d, 1.0), np.where(clear, shift, n / 2)
        inverse = (np.eye(n) + np.ones((n, n)) / (shift - n)[:, None, None]) / (take * shift)[:, None, None]
        schur = -inverse - np.swapaxes(own, 1, 2) @ (own / d[:, :, None])
        found = (d > 0).sum(axis=1) + (np.linalg.eigvalsh(schur) > 0).sum(axis=1) - (shift < n)
        return np.where(clear, found, -1)


def whole(g: np.ndarray, widths: list[int], lam: list[float], nfac: int, m: int) -> Whole | None:
    """The fit of all rows from cross products of z-scores; ``None`` if a table's matrix is
    singular, as it then is without any row."""
    starts = np.concatenate([[0], np.cumsum(widths)])
    diagonal = np.diag(g).copy()
    w = np.zeros_like(g)
    for a, b, v in zip(starts, starts[1:], lam):
        try:
            lower = np.linalg.cholesky(g[a:b, a:b] + np.diag(v * diagonal[a:b] / (m - 2)))
        except np.linalg.LinAlgError:
            return None
        w[a:b, a:b] = np.linalg.inv(lower).T
    inner = w.T @ g @ w
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    basis = w @ vectors[:, ::-1]
    return Whole(values[::-1].copy(), basis, g @ basis, diagonal, starts, tuple(lam), m, nfac)
