"""The best keys of many questions, kept while scores come in parts."""

from __future__ import annotations

import numpy as np

#: Scores, or postings, that a task handles at a time, whatever the number of questions.
CELLS = 1 << 20


class Best:
    """The ``top`` best keys of each question, ties by key.  Scores up to ``least`` don't count; ``floor``: what a score has to reach by now."""

    def __init__(self, questions: int, top: int, least: float = -np.inf):
        self.n, self.top, self.least = questions, top, least
        self.floor = np.full(questions, least)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, q: np.ndarray, keys: np.ndarray, score: np.ndarray) -> None:
        """Takes what reaches the floor."""
        kept = ~((score < self.floor[q]) | (score <= self.least))
        if not kept.any():
            return
        self.found.append((q[kept], keys[kept], score[kept]))
        self.waiting += len(self.found[-1][0])
        if self.waiting > 4 * self.n * self.top:
            self.settle()

    def reaching(self, scores: np.ndarray, questions: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of what may be among the best, in a matrix of these questions by keys, whose scores are off by less than ``slack``,
        one number a question.  Where many of a row reach the floor, it is raised to the row's ``top``-th best first."""
        width, slack = scores.shape[1], np.asarray(slack, np.float64)

        def reached() -> np.ndarray:
            return ~(scores < (np.maximum(self.floor[questions], self.least) - slack).astype(scores.dtype)[:, None])

        hits = reached()
        crowded = np.flatnonzero(np.count_nonzero(hits, axis=1) > 2 * self.top)
        if len(crowded):
            place = width - self.top
            sure = np.partition(scores[crowded], place, axis=1)[:, place] - slack[crowded]
            self.floor[questions[crowded]] = np.fmax(self.floor[questions[crowded]], sure)
            hits = reached()
        return np.divmod(np.flatnonzero(hits), width)

    def settle(self) -> None:
        if not self.found:
            return
        q, keys, score = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        by_key = np.argsort(keys, kind="stable")
        order = by_key[np.lexsort((-score[by_key], q[by_key]))]
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[place < self.top]
        last = np.flatnonzero(place[place < self.top] == self.top - 1)
        self.floor[q[order[last]]] = score[order[last]]
        self.found, self.waiting = [(q[order], keys[order], score[order])], len(order)
