"""Columns in order and in groups: agglomeration of columns by their distances, and sparse random projections.

The distances of all columns come from one pass of moments over the rows (p x p numbers, whatever the
number of rows); the merges follow from that table by the rules of Lance and Williams.  Groups and projections are then
column expressions over the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gaussian as G


def column_distances(rows: DataFrame, width: int) -> np.ndarray:
    """Squared Euclidean distances of the columns of x over all rows."""
    n, mean, cov = G.moments(rows.select(F.lit(0).alias("model"), F.lit(0).alias("y"), "x"), width)[0, 0]
    gram = n * (cov + np.outer(mean, mean))
    square = np.diag(gram)
    return np.maximum(square[:, None] + square - 2 * gram, 0)


def merges(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of each merge, p - 1 of them: the nearest two clusters, ties to the smaller numbers; a merge's cluster is p + its place.

    distance: Euclidean distances of the items (not squared).  ward: heights are those of Ward's criterion; average: mean distances.
    """
    if method not in ("ward", "average"):
        raise ValueError(method)
    p = len(distance)
    d = np.array(distance, float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    name, size, alive, out = list(range(p)), np.ones(p), np.ones(p, bool), []
    for k in range(p - 1):
        low = d.min()
        near = np.argwhere(d <= low * (1 + 1e-12))
        i, j = min((tuple(t) for t in near if t[0] != t[1]), key=lambda t: (min(name[t[0]], name[t[1]]), max(name[t[0]], name[t[1]])))
        height = d[i, j]
        if method == "ward":
            t = size + size[i] + size[j]
            row = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * height) / t
        else:
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        out.append((*sorted((name[i], name[j])), float(np.sqrt(height) if method == "ward" else height), int(size[i] + size[j])))
        alive[j] = False
        row[~alive], row[i] = np.inf, np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        name[i], size[i] = p + k, size[i] + size[j]
    return out


def order(found: list[tuple[int, int, float, int]], p: int) -> list[int]:
    """The leaves from left to right: columns that merge early are neighbours."""
    inside = {i: [i] for i in range(p)}
    for k, (a, b, *_) in enumerate(found):
        inside[p + k] = inside.pop(a) + inside.pop(b)
    return next(iter(inside.values())) if p else []


def groups(found: list[tuple[int, int, float, int]], p: int, k: int) -> list[list[int]]:
    """The k clusters that are left when p - k merges are made, by their smallest column."""
    inside = {i: [i] for i in range(p)}
    for step, (a, b, *_) in enumerate(found[: max(0, p - k)]):
        inside[p + step] = sorted(inside.pop(a) + inside.pop(b))
    return sorted(inside.values())


def agglomerated(x: Column, clusters: list[list[int]]) -> Column:
    """The mean of each cluster's columns."""
    return F.array(*[sum((F.get(x, F.lit(j)) for j in c), F.lit(0.0)) / float(len(c)) for c in clusters])


def signs(width: int, components: int, seed: int = 3, sparsity: int = 4) -> list[list[int]]:
    """For each component a sign per column: 0, or with a chance of 1 in `sparsity` 1 or -1, by MD5 of seed, component and column."""
    import hashlib

    out = []
    for c in range(components):
        digits = [int(hashlib.md5(f"{seed}:{c}:{j}".encode()).hexdigest()[:4], 16) for j in range(width)]
        out.append([0 if d % (2 * sparsity) > 1 else 1 if d % 2 else -1 for d in digits])
    return out


def projected(x: Column, rows: list[list[int]], sparsity: int = 4) -> Column:
    """The sparse random projection with these signs: distances are kept in expectation."""
    scale = float(np.sqrt(sparsity / len(rows)))
    return F.array(*[sum((F.get(x, F.lit(j)) * float(s) for j, s in enumerate(r) if s), F.lit(0.0)) * scale for r in rows])
