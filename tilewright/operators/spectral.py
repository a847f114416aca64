"""Groups inside one session's graph: Louvain, spectral order and clusters, k-means. Sessions fit a task."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LARGEST = 2000  # nodes of a session that is solved as a dense matrix


def louvain(w: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Communities of a symmetric weight matrix by greedy modularity moves and contraction."""
    a, b = np.nonzero(w)
    return communities(a, b, w[a, b], len(w), rounds)


def communities(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: int, rounds: int = 20) -> np.ndarray:
    """The same from the matrix's entries (a, b, x), both directions of each: memory grows with the edges."""
    place = np.arange(n)
    while True:
        order = np.lexsort((b, a))
        a, b, x = a[order], b[order], x[order]
        at = np.searchsorted(a, np.arange(n + 1)).tolist()
        total, degree = max(float(x.sum()), 1e-12), np.bincount(a, x, n).tolist()
        label, mass, members, empty, moved = list(range(n)), list(degree), [1] * n, [], False
        for _ in range(rounds):
            changed = False
            for i in range(n):
                own, share = label[i], degree[i] / total
                members[own] -= 1
                mass[own] = mass[own] - degree[i] if members[own] else 0.0
                links = {own: 0.0}
                for j, weight in zip(b[at[i] : at[i + 1]].tolist(), x[at[i] : at[i + 1]].tolist(), strict=True):
                    if j != i:
                        links[label[j]] = links.get(label[j], 0.0) + weight
                stay = links[own] - mass[own] * share
                gain, best = max((weight - mass[c] * share, -c) for c, weight in links.items())
                best = -best
                if gain < 0:  # on its own it loses nothing
                    while empty and members[empty[0]]:
                        heapq.heappop(empty)
                    if empty:
                        gain, best = 0.0, empty[0]
                if gain <= stay + 1e-12:
                    best = own
                elif not members[own]:
                    heapq.heappush(empty, own)
                label[i] = best
                members[best] += 1
                mass[best] += degree[i]
                changed |= best != own
            moved |= changed
            if not changed:
                break
        _, label = np.unique(label, return_inverse=True)
        place, k = label[place], int(label.max()) + 1 if n else 0
        if not moved or k == n:
            return place
        pair, where = np.unique(label[a] * k + label[b], return_inverse=True)
        a, b, x, n = pair // k, pair % k, np.bincount(where, x), k


def entries(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of every edge between two nodes, the greatest weight of the pair; none of 0 or less."""
    some = (a != b) & (w > 0)
    lo, hi, w = np.minimum(a, b)[some], np.maximum(a, b)[some], w[some]
    order = np.lexsort((hi, lo))
    lo, hi, w = lo[order], hi[order], w[order]
    head = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])) if len(lo) else np.zeros(0, int)
    w = np.maximum.reduceat(w, head) if len(head) else w
    lo, hi = lo[head], hi[head]
    return np.concatenate([lo, hi]), np.concatenate([hi, lo]), np.concatenate([w, w])


def fiedler(w: np.ndarray) -> np.ndarray:
    """Second eigenvector of the normalised Laplacian; its greatest component is positive."""
    d = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, v = np.linalg.eigh(np.eye(len(w)) - d[:, None] * w * d)
    x = d * v[:, min(1, len(w) - 1)]
    return x * np.sign(x[np.abs(x).argmax()])


def parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's connected component, from both directions of the edges."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, root[a], root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def leading(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: int, k: int, known: np.ndarray, keep: int = 24, most: int = 72, rounds: int = 60) -> np.ndarray:
    """The k greatest eigenvectors, beside the ``known`` ones, of the symmetric matrix with entries (a, b, x) and
    eigenvalues of -1 to 1: block Lanczos on a Chebyshev polynomial of the matrix, which stays within -1 and 1 below
    the best ``keep`` eigenvalues and grows above. A round starts from the last one's best vectors; the polynomial's
    degree rises as far as the eigenvalues lie close. It holds 2 * ``most`` vectors and the entries."""
    order = np.lexsort((b, a))
    a, b, x = a[order], b[order], x[order]
    head = np.flatnonzero(np.diff(a, prepend=-1))

    def times(v):
        out = np.zeros((v.shape[1], n))
        for c, o in zip(v.T, out, strict=True):
            o[a[head]] = np.add.reduceat(x * np.ascontiguousarray(c).take(b), head)
        return out.T - known @ (known.T @ v)

    def grown(v, cut, degree):
        mid, half = (cut - 1) / 2, (cut + 1) / 2
        before, now = v, (times(v) - mid * v) / half
        for _ in range(degree - 1):
            before, now = now, (times(now) - mid * now) * (2 / half) - before
        return now

    def fresh(v, basis):  # what is new in v, orthonormal
        for _ in range(3):
            for q in (known, basis):
                v = v - q @ (q.T @ v)
            v = np.linalg.qr(v)[0]
        return v

    width, cut, degree, none = k + 2, 0.0, 1, np.zeros((n, 0))
    block = fresh(np.random.default_rng(0).normal(size=(n, width)), none)
    for _ in range(rounds):
        basis = image = none
        while True:
            new = grown(block, cut, degree)
            basis, image = np.hstack([basis, block]), np.hstack([image, new])
            if basis.shape[1] + width > most:
                break
            block = fresh(new, basis)
        h = basis.T @ image
        basis = basis @ np.linalg.eigh((h + h.T) / 2)[1][:, : -keep - 1 : -1]
        image = times(basis)
        value = (basis * image).sum(0)
        best = np.argsort(-value, kind="stable")
        off = (image - basis * value)[:, best[:k]]
        if np.linalg.norm(off, axis=0).max(initial=0.0) < max(1e-11, 4e-15 * degree):  # rounding grows with the degree
            return basis[:, best[:k]]
        block, cut = fresh(basis[:, best[:width]], none), value.min()
        degree = int(np.clip(np.arccosh(100) / np.arccosh(1 + 2 * max(value.max() - cut, 1e-14) / (cut + 1)), 1, 4 * degree))
    raise ValueError("eigenvectors did not settle")


def embedded(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least eigenvectors of the normalised Laplacian from both directions of the edges, the square roots of
    the degrees, and each node's component. A component has an eigenvector of 0 of its own: the largest come first."""
    d = np.sqrt(np.maximum(np.bincount(a, w, n), 1e-12))
    root = parts(a, b, n)
    linked = np.bincount(a, minlength=n) > 0
    tops, size = np.unique(root[linked], return_counts=True)
    tops = tops[np.lexsort((tops, -size))]
    zero = np.zeros((n, min(k, len(tops))))
    for j, top in enumerate(tops[:k]):
        zero[:, j] = np.where(root == top, d, 0.0)
    zero /= np.linalg.norm(zero, axis=0)
    if len(tops) >= k:
        return zero, d, root
    return np.hstack([zero, leading(a, b, w / (d[a] * d[b]), n, k - len(tops), zero)]), d, root


def sparse_fiedler(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """``fiedler`` from edges. Of several components, the largest is split from the rest."""
    v, d, root = embedded(a, b, w, n, 2)
    x = v[:, 1] / d
    if v[:, 1].min() >= 0:  # an eigenvector of 0, turned to be orthogonal to that of the whole
        largest, mass = root == root[v[:, 0].argmax()], d**2
        x = np.where(largest, mass[~largest].sum(), -mass[largest].sum()) / mass.sum()
    return x * np.sign(x[np.abs(x).argmax()])


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Farthest-first start, then Lloyd's rounds."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    c = np.array(centres)
    for _ in range(rounds):
        label = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral(w: np.ndarray, k: int) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, v = np.linalg.eigh(np.eye(len(w)) - d[:, None] * w * d)
    return clustered(v[:, :k], k)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k)


def groups(edges: DataFrame, method: str, k: int = 2) -> DataFrame:
    """(session, id, group, place) for edges (session, src, dst, w): louvain, bisect, order or spectral."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        a, b = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        place = np.zeros(len(ids))
        if method == "louvain":
            group = communities(*entries(a, b, pdf["w"].to_numpy()), len(ids))
        else:
            n, dense = len(ids), len(ids) <= LARGEST
            a, b, w = entries(a, b, pdf["w"].to_numpy())
            if dense:
                whole = np.zeros((n, n))
                whole[a, b] = w
            if method == "spectral":
                group = spectral(whole, k) if dense else clustered(embedded(a, b, w, n, k)[0], k)
            else:
                place = fiedler(whole) if dense else sparse_fiedler(a, b, w, n)
                group = (place > 0).astype(int)
                place = np.argsort(np.argsort(place, kind="stable"), kind="stable").astype(float)
        return pd.DataFrame({"session": pdf["session"].iloc[0], "id": ids, "group": group.astype("int32"), "place": place})

    kind = dict(edges.dtypes)["session"]
    return edges.select("session", "src", "dst", "w").groupBy("session").applyInPandas(run, f"session {kind}, id long, group int, place double")
