"""Union of nodes in arrays, many edges at a time."""

from __future__ import annotations

import numpy as np


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of x[k] and y[k] for every k; afterwards root names, for each node,
    the least node of its tree.  ``root`` must have that form before, as arange has."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up
