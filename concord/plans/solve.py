"""Small dense algebra on the driver: everything here is as large as the number of
variables, never as the number of individuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

METHODS = ("solve", "penalized", "ginv")


def match_method(method: str) -> str:
    """The method that ``method`` is a prefix of; ``ValueError`` if there is not just one."""
    found = [m for m in METHODS if method and m.startswith(method)]
    if len(found) != 1:
        raise ValueError(f"method must be one of {', '.join(METHODS)}; {method!r} is not")
    return found[0]


def penalties(method: str, lam, count: int) -> list[float]:
    if method in ("solve", "ginv"):
        return [0.0] * count
    if lam is None:
        raise ValueError("the penalized method needs lam, one value for each table")
    values = [float(v) for v in (lam if np.ndim(lam) else [lam])]
    if len(values) != count:
        raise ValueError(f"lam has {len(values)} values for {count} tables")
    return values


def cholesky(matrix: np.ndarray, name: str, diagonal: np.ndarray | None = None) -> np.ndarray:
    """The lower factor; ``ValueError`` with the table's name if it is not positive definite,
    also where only rounding makes a pivot positive. ``diagonal``: that of the whole matrix,
    where ``matrix`` is what is left of a part of it."""
    try:
        lower = np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        raise ValueError(f"table {name}: its cross-product matrix is not positive definite; use the penalized method") from None
    pivots = np.diag(lower) ** 2
    if len(pivots) and (pivots <= 1e-12 * np.maximum(np.diag(matrix) if diagonal is None else diagonal, 1e-300)).any():
        raise ValueError(f"table {name}: its variables are linearly dependent; use the penalized method")
    return lower


def pivoted_cholesky(matrix: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """L, p x rank, with L L' = matrix: each step takes the largest pivot that is left, until
    none exceeds ``tol`` of the variable's own square, so that dependent variables add no column."""
    left, size = np.array(matrix, dtype=float), np.maximum(np.diag(matrix), 1e-300)
    diagonal, columns = np.diag(left).copy(), []
    for _ in range(len(left)):
        k = int(np.argmax(diagonal / size))
        if not diagonal[k] > tol * size[k]:
            break
        column = left[:, k] - (np.stack(columns, axis=1) @ np.array([c[k] for c in columns]) if columns else 0.0)
        column = column / np.sqrt(diagonal[k])
        columns.append(column)
        diagonal = diagonal - column**2
        diagonal[k] = 0.0
    return np.stack(columns, axis=1) if columns else np.zeros((len(left), 0))


def half_inverse(matrix: np.ndarray, lam: float, name: str, ginv: bool = False) -> np.ndarray:
    """W with W W' = (matrix + lam)^-1; with ``ginv`` the generalised inverse, of which W has
    as many columns as the matrix has rank."""
    if ginv:
        lower = pivoted_cholesky(matrix)
        if not lower.shape[1]:
            raise ValueError(f"table {name}: its variables are all zero")
        # (L L')^+ = L (L'L)^-2 L': the least-norm solution
        return np.linalg.solve(lower.T @ lower, lower.T).T
    lower = cholesky(matrix + lam * np.eye(len(matrix)), name)
    return np.linalg.solve(lower, np.eye(len(matrix))).T


@dataclass
class Solution:
    """``values``: eigenvalues. ``loadings`` (P x F): components are rows times these, over
    ksum. ``weights``: for each table its unit-deviation score weights."""

    values: np.ndarray
    loadings: np.ndarray
    weights: list[np.ndarray]


def sign_of(products: np.ndarray) -> np.ndarray:
    """For each column +1 or -1, so that its largest entry is positive; of entries that tie
    up to rounding, the first."""
    size = np.abs(products)
    first = (size >= (1 - 1e-8) * size.max(axis=0)).argmax(axis=0)
    return np.where(products[first, np.arange(products.shape[1])] < 0, -1.0, 1.0)


def solve(own: np.ndarray, cross: np.ndarray, sums: np.ndarray, widths: list[int], names: list[str], lam: list[float], nfac: int, m: int, unit: bool = False, ginv: bool = False) -> Solution:
    """Top components from moments.

    ``own``: P x P of which the diagonal blocks are X_i' X_i; ``cross``: Xc' Ksum^-1 Xc for
    all tables side by side; ``sums``: column sums; ``m``: individuals. The non-zero
    eigenvalues of the m x m problem are those of W' cross W with W = blockdiag(L_i^-T).
    ``unit``: components of complete cases, unit vectors with eigenvalues times the number
    of tables. ``ginv``: generalised inverses, so that variables may depend on each other."""
    n, p = len(widths), sum(widths)
    starts = np.concatenate([[0], np.cumsum(widths)])
    halves = [half_inverse(own[a:b, a:b], v, name, ginv) for a, b, v, name in zip(starts, starts[1:], lam, names)]
    ends = np.concatenate([[0], np.cumsum([h.shape[1] for h in halves])])
    w = np.zeros((p, ends[-1]))
    for k, half in enumerate(halves):
        w[starts[k] : starts[k + 1], ends[k] : ends[k + 1]] = half
    g = w.T @ cross @ w
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    if nfac < 1 or nfac > len(values) or values[nfac - 1] <= 1e-10 * max(values[0], 1e-300):
        raise ValueError(f"there are fewer than {nfac} components")
    values, vectors = values[:nfac], vectors[:, :nfac]
    loadings = np.sqrt(n) * w @ vectors / np.sqrt(values)
    products = cross @ loadings
    sign = sign_of(products)
    loadings, products = loadings * sign, products * sign
    if unit:  # with complete cases the components are unit vectors as they are
        values = values * n
    weights = []
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        raw = halves[k] @ (halves[k].T @ products[a:b])
        mean = sums[a:b] @ raw / m
        variance = (np.einsum("ij,ik,kj->j", raw, own[a:b, a:b], raw) - m * mean**2) / (m - 1)
        weights.append(raw / np.sqrt(np.maximum(variance, 0)))
    return Solution(values, loadings, weights)
