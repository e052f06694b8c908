"""Recursive graph bisection: an order of documents in which those that share terms are near.

A list of documents is halved, and documents change sides in pairs as long as that lowers the
estimated size of the terms' postings, sum over terms of d log(n / (d + 1)) on each side; then each
half is halved. Documents are rows of a CSR matrix: `starts` into `terms`, numbers from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of swaps at each halving.
ROUNDS = 8


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    return d * np.log2(max(n, 1) / (d + 1))


def _edges(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of docs, the place of its document in docs, and its term."""
    n = starts[docs + 1] - starts[docs]
    owner = np.repeat(np.arange(len(docs)), n)
    first = np.cumsum(n) - n
    return owner, terms[np.arange(len(owner)) - first[owner] + starts[docs][owner]]


def halve(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """docs in two halves, of which the first is the larger by one document at most."""
    owner, term = _edges(docs, starts, terms)
    _, term = np.unique(term, return_inverse=True)
    most = int(term.max(initial=-1)) + 1
    total = np.bincount(term, minlength=most).astype(float)
    half = (len(docs) + 1) // 2
    left = np.arange(len(docs)) < half
    for _ in range(rounds):
        at_left = np.bincount(term[left[owner]], minlength=most).astype(float)
        at_right = total - at_left
        now = _cost(at_left, half) + _cost(at_right, len(docs) - half)
        to_right = now - _cost(np.maximum(at_left - 1, 0), half) - _cost(at_right + 1, len(docs) - half)
        to_left = now - _cost(at_left + 1, half) - _cost(np.maximum(at_right - 1, 0), len(docs) - half)
        gain = np.bincount(owner, np.where(left[owner], to_right[term], to_left[term]), minlength=len(docs))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        swaps = int((gain[a[:pairs]] + gain[b[:pairs]] > 1e-9).sum())  # gains fall, so these come first
        if not swaps:
            break
        left[a[:swaps]], left[b[:swaps]] = False, True
    return docs[left], docs[~left]


def ordered(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, leaf: int) -> np.ndarray:
    """docs reordered down to runs of at most `leaf`."""
    todo, out = [docs], []
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
        else:
            a, b = halve(part, starts, terms)
            todo += [b, a]
    return np.concatenate(out) if out else docs


@dataclass(frozen=True)
class Router:
    """Halvings fitted on a sample, for documents outside of it: the words known, and their weights at each node.

    The nodes of a tree of `depth` halvings are numbered as in a heap. A document goes to the side
    where its words cost less.
    """

    words: dict[bytes, int]
    weights: np.ndarray
    depth: int

    def cluster(self, words: list[bytes]) -> int:
        """A number below 2^depth."""
        known = [i for i in map(self.words.get, words) if i is not None]
        sums = self.weights[known].sum(0)
        node = 0
        for _ in range(self.depth):
            node = 2 * node + (1 if sums[node] < 0 else 2)
        return node + 1 - (1 << self.depth)


def fit_router(sample: list[list[bytes]], depth: int) -> Router:
    """sample: the different words of each document."""
    numbers: dict[bytes, int] = {}
    terms = np.array([numbers.setdefault(w, len(numbers)) for doc in sample for w in doc], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(doc) for doc in sample])]).astype(np.int64)
    weights = np.zeros((len(numbers), (1 << depth) - 1), np.float32)
    level = [np.arange(len(sample))]
    for node in range((1 << depth) - 1):
        halves = halve(level[node], starts, terms)
        level += halves
        cost = []
        for side in halves:
            d = np.bincount(_edges(side, starts, terms)[1], minlength=len(numbers)).astype(float)
            cost.append(_cost(d + 1, len(side) + 1) - _cost(d, len(side) + 1))
        weights[:, node] = cost[0] - cost[1]
    # A word of one sampled document says little about others.
    kept = np.flatnonzero(np.bincount(terms, minlength=len(numbers)) > 1)
    names = list(numbers)
    return Router({names[i]: k for k, i in enumerate(kept.tolist())}, weights[kept], depth)
