"""The k best of many scored keys per query, kept by a task as batches pass."""

from __future__ import annotations

import numpy as np


class Best:
    """Per query the k highest scores and their keys, ties by the least key; -inf is no score."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores[query, row] of the rows with these keys. Only what reaches a query's k-th best so far is looked at."""
        if scores.shape[1] > self.k:
            inner = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            floor = np.maximum(self.floor, inner)
        else:
            floor = self.floor
        q, r = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self._merge(q, scores[q, r], keys[r])

    def _merge(self, q: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        query, score, key = np.concatenate([self.query, q]), np.concatenate([self.score, scores]), np.concatenate([self.key, keys])
        _, rank = np.unique(key, return_inverse=True) if len(key) else (None, np.zeros(0, np.int64))
        order = np.lexsort((rank, -score, query))
        query, score, key = query[order], score[order], key[order]
        start = np.searchsorted(query, query, "left")
        kept = np.arange(len(query)) - start < self.k
        self.query, self.score, self.key = query[kept], score[kept], key[kept]
        last = np.flatnonzero(np.arange(len(self.query)) - np.searchsorted(self.query, self.query, "left") == self.k - 1)
        self.floor[self.query[last]] = self.score[last]

    def add_some(self, queries: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """``add`` for some of the queries: scores[i, row] is of queries[i]."""
        if scores.shape[1] > self.k:
            inner = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
        else:
            inner = np.full(len(queries), -np.inf)
        q, r = np.nonzero(scores >= np.maximum(self.floor[queries], inner)[:, None])
        self._merge(queries[q], scores[q, r], keys[r])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.query, self.key, self.score
