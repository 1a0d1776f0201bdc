"""Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np


def partition(weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Divide weights into k parts of nearly equal sums: the part of each weight, and the sums.

    Every weight starts as a partial partition of k parts, all but one empty. The two partial partitions with the
    largest differences are merged, the fullest part of one with the emptiest of the other, until one is left.
    Ties follow the order of the weights. No weights: empty parts.
    """
    weights = np.asarray(weights, dtype=np.int64)
    n = len(weights)
    if n == 0 or k <= 1:
        return np.zeros(n, dtype=np.int64), np.array([weights.sum()] + [0] * (max(k, 1) - 1), dtype=np.int64)
    sums: list[np.ndarray | None] = []
    for w in weights:
        s = np.zeros(k, dtype=np.int64)
        s[0] = w
        sums.append(s)
    joined: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        s = sums[i] + sums[j][::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        sums[i] = sums[j] = None
        joined.append((i, j, order))
        sums.append(s)
        heapq.heappush(heap, (-int(s[0] - s[-1]), len(sums) - 1))
    root = heap[0][1]
    parts = np.empty(n, dtype=np.int64)
    todo = [(root, np.arange(k))]
    while todo:
        node, final = todo.pop()
        made = joined[node]
        if made is None:
            parts[node] = final[0]
            continue
        i, j, order = made
        unsorted = np.empty(k, dtype=np.int64)
        unsorted[order] = final
        todo.append((i, unsorted))
        todo.append((j, unsorted[::-1]))
    return parts, sums[root]


def pack(weights: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each weight such that no window holds more than capacity; no weight may exceed it.

    Starts with the fewest windows that could do and adds windows whenever the fullest is over capacity.
    """
    weights = np.asarray(weights, dtype=np.int64)
    if len(weights) == 0:
        return np.zeros(0, dtype=np.int64)
    if weights.max() > capacity:
        raise ValueError("a weight exceeds the capacity")
    k = max(1, -(-int(weights.sum()) // capacity), int((weights * 2 > capacity).sum()))
    while True:
        parts, sums = partition(weights, k)
        if sums.max() <= capacity:
            return parts
        k += max(1, k // 200)
