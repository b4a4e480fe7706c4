"""Eigenvectors of a symmetric matrix: float32 first, then refined to double precision.

The refinement is the one of Ogita and Aishima: a matrix of approximate eigenvectors is corrected
by matrix products alone, in higher precision, and the error falls to about its square in
every round. Eigenvalues closer to each other than the error of the round form a cluster; for
such a cluster the correction only keeps its vectors orthogonal, and a sub-solve of the cluster's
own small matrix, scaled to its own spread, turns them to the right place within their span.
"""

import numpy as np

#: Precision of the matrix products: 64 bits of mantissa where the machine has them, else 53.
WIDE = np.longdouble
ROUNDS, PATIENCE = 60, 5
#: Eigenvalues nearer than so many times the error are a cluster: corrections stay small beyond.
NEAR = 64


def _parts(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three float64 matrices that add up to `a`; in each, the entries of a row are whole
    multiples of one power of two, of at most `bits` bits."""
    out = []
    for _ in range(3):
        top = np.abs(a).max(1, keepdims=True, initial=0)
        step = np.ldexp(WIDE(1), np.frexp(np.where(top > 0, top, 1))[1] - bits)
        part = np.rint(a / step) * step
        out.append(part.astype(np.float64))
        a = a - part
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in `WIDE`: float64 products of parts so short that each is exact, added up."""
    bits = (52 - max(1, a.shape[1]).bit_length()) // 2
    left, right = _parts(a, bits), [p.T for p in _parts(b.T, bits)]
    out = np.zeros((a.shape[0], b.shape[1]), dtype=WIDE)
    for i, j in ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)):
        out += left[i] @ right[j]
    return out


def _start(matrix: np.ndarray) -> np.ndarray:
    """Eigenvectors by float32 arithmetic, made orthonormal in `WIDE` by Newton steps."""
    size = np.abs(matrix).max(initial=0)
    if not size:
        return np.eye(len(matrix), dtype=WIDE)
    return _orthonormal(np.linalg.eigh((matrix / size).astype(np.float32))[1].astype(WIDE))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Newton steps towards orthonormal columns, from columns that nearly are."""
    one = np.eye(x.shape[1], dtype=WIDE)
    for _ in range(3):
        x = x + times(x, one - times(x.T, x)) / 2
    return x


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Indexes of eigenvalues tied by gaps of at most `near`, for ties of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _sub_solve(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cluster's vectors, turned within their span to eigenvectors of what the matrix does
    there. The middle of the cluster is taken off first, so that float32 sees its spread."""
    middle = values.mean()
    inner = times(vectors.T, times(matrix, vectors) - middle * vectors)
    return times(vectors, _start((inner + inner.T) / 2))


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, correct to double precision.

    `matrix` is symmetric, of any float type; give it in `WIDE` if it has more than 53 bits.
    Equal eigenvalues get some orthonormal basis of their space. The largest entry of each
    vector is positive.
    """
    a = np.asarray(matrix, dtype=WIDE)
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    x, one = _start(a), np.eye(n, dtype=WIDE)
    norm = np.sqrt((a * a).sum())
    unit = np.finfo(WIDE).eps
    best, late = None, 0
    for _ in range(ROUNDS):
        r = one - times(x.T, x)
        s = times(x.T, times(a, x))
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over small gaps undoes orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())
        late = late + 1 if best is not None and error >= best[0] / 2 else 0
        if best is None or error < best[0]:
            best = (error, values, x)
        if error <= unit * norm or late >= PATIENCE:
            break  # rounding is all that is left
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > NEAR * error
        turn = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + times(x, turn)
        for part in _clusters(values, NEAR * error):
            x[:, part] = _sub_solve(a, x[:, part], values[part])
    _, values, x = best
    x = _orthonormal(x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(n)] < 0, -1, 1)
    return values[order].astype(np.float64), x.astype(np.float64)
