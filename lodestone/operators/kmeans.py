"""Lloyd's k-means on a bounded sample, nearest centroids, and the rule for the number of clusters."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the index.
TARGET_CLUSTER_BYTES = 2 << 20
TARGET_CLUSTER_ROWS = 256
MAX_CLUSTERS = 256
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 8 << 20
ITERATIONS = 6
#: Distances held at once.
DISTANCES = 1 << 22


def cluster_count(live: int, dim: int, most: int | None = MAX_CLUSTERS, cluster_rows: int = TARGET_CLUSTER_ROWS) -> int:
    """Clusters by the rows' bytes and number; ``most`` of None sets no bound."""
    wanted = max(math.ceil(live * dim * 4 / TARGET_CLUSTER_BYTES), math.ceil(live / cluster_rows))
    return max(1, min(wanted if most is None else most, wanted, live // 2 or 1))


def sample_size(live: int, dim: int) -> int:
    return max(1, min(live, SAMPLE_ROWS, SAMPLE_BYTES // (dim * 4)))


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.square(rows).sum(axis=1)[:, None] - 2 * rows @ centroids.T + np.square(centroids).sum(axis=1)[None, :])


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties to the first) and its squared distance, for some rows at a time."""
    step = max(1, DISTANCES // len(centroids))
    owner, own = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for at in range(0, len(rows), step):
        d = squared_distances(rows[at : at + step], centroids)
        owner[at : at + step] = best = d.argmin(axis=1)
        own[at : at + step] = d[np.arange(len(d)), best]
    return owner, own


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay."""
    size = np.sqrt(np.square(rows).sum(axis=1, keepdims=True))
    return np.where(size == 0, rows, rows / np.where(size == 0, 1, size))


def kmeans(rows: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 1) -> np.ndarray:
    """k centroids from distinct random rows; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), k, replace=False)].astype(np.float64)
    owner = np.full(len(rows), -1)
    for step in range(iterations):
        found, own = nearest(rows, centroids)
        moved = (found != owner).any()
        owner = found
        if step and not moved:
            break
        count = np.bincount(owner, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        for c in range(k):
            if count[c]:
                centroids[c] = sums[c] / count[c]
            else:
                far = int(own.argmax())
                centroids[c], own[far] = rows[far], 0.0
    return centroids


def nearest_centroids(centroids: np.ndarray, query: np.ndarray, n: int) -> list[int]:
    """The n nearest by squared distance; ties go to the first."""
    d = np.square(centroids - query).sum(axis=1)
    return np.argsort(d, kind="stable")[:n].tolist()
