"""Forward-backward over many label sequences at once, for linear-chain conditional random fields.

A chain is any object with ``first`` (scores of first labels) and ``steps`` (scores of
transitions). Sequences lie end to end: ``emission`` has a row of label scores for every
place, and ``bounds`` are the n + 1 places where sequences start.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np

CHUNK = 32


class Chain(Protocol):
    first: np.ndarray
    steps: np.ndarray


def _scaled(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def posteriors(emission: np.ndarray, bounds: np.ndarray, field: Chain) -> np.ndarray:
    """Label probabilities of every word of several sequences, by forward-backward.

    Sequences are cut to chunks. The chunks' transfer matrices are multiplied out for all
    chunks at once, then the messages into each chunk follow from chunk to chunk, and then
    the words' own messages again for all at once. Exact for sequences of any length.
    """
    size = len(field.first)
    lengths = np.diff(bounds)
    chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = bounds[:-1][owner] + rank * CHUNK
    used = np.minimum(CHUNK, bounds[1:][owner] - start)
    grid = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < used[:, None]
    local = np.exp(emission - emission.max(axis=1, keepdims=True))[np.where(inside, grid, 0)]
    step = np.exp(field.steps - field.steps.max())
    through = np.broadcast_to(np.eye(size), (len(owner), size, size)).copy()
    first_row = (rank == 0)[:, None, None]
    for t in range(CHUNK):
        moved = through @ step
        if t == 0:
            moved = np.where(first_row, through, moved)
        moved = moved * local[:, t, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        through = np.where(inside[:, t, None, None], moved, through)
    entering = np.broadcast_to(_scaled(np.exp(field.first - field.first.max())), (len(owner), size)).copy()
    leaving = np.ones((len(owner), size))
    last = np.cumsum(chunks) - 1
    for r in range(1, int(chunks.max(initial=1))):
        at = np.flatnonzero(rank == r) if r < 4 else np.flatnonzero(chunks > r)
        at = at if r < 4 else (last - chunks + 1)[at] + r
        entering[at] = _scaled(np.einsum("ni,nij->nj", entering[at - 1], through[at - 1]))
    for r in range(int(chunks.max(initial=1)) - 1, 0, -1):
        at = (last - chunks + 1)[np.flatnonzero(chunks > r)] + r
        leaving[at - 1] = _scaled(np.einsum("nij,nj->ni", through[at], leaving[at]))
    forward = np.empty(local.shape)
    message = entering
    for t in range(CHUNK):
        moved = message if t == 0 else message @ step
        if t == 0:
            moved = np.where(first_row[:, 0], message, message @ step)
        message = np.where(inside[:, t, None], _scaled(moved * local[:, t]), message)
        forward[:, t] = message
    out = np.empty((len(emission), size))
    message = leaving
    for t in range(CHUNK - 1, -1, -1):
        here = inside[:, t]
        out[grid[here, t]] = _scaled(forward[here, t] * message[here])
        moved = _scaled((message * local[:, t]) @ step.T)
        message = np.where(here[:, None], moved, message)
    return out


def batch_gradient(emission: np.ndarray, labels: np.ndarray, bounds: np.ndarray, field: Chain):
    """Gradients by word emission, first label and transition of the log-likelihood."""
    size = len(field.first)
    node = posteriors(emission, bounds, field)
    target = np.zeros_like(node)
    target[np.arange(len(labels)), labels] = 1.0
    inner = np.ones(len(labels), bool)
    inner[bounds[:-1]] = False
    right = np.flatnonzero(inner)
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(field.steps - field.steps.max())
    # With p(y_t, y_t+1) = p(y_t) p(y_t+1 | y_t): the conditional needs the message from the right.
    message = node / np.maximum(_forward_only(emission, bounds, field), 1e-30)
    pair = step[None] * (local[right] * message[right])[:, None, :]
    pair *= (node[right - 1] / np.maximum(pair.sum(axis=2), 1e-30))[:, :, None]
    seen = np.zeros((size, size))
    np.add.at(seen, (labels[right - 1], labels[right]), 1.0)
    return target - node, (target - node)[bounds[:-1]].sum(axis=0), seen - pair.sum(axis=0)


def _forward_only(emission: np.ndarray, bounds: np.ndarray, field: Chain) -> np.ndarray:
    """Scaled forward messages of short sequences, one place at a time."""
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(field.steps - field.steps.max())
    lengths, out = np.diff(bounds), np.empty(emission.shape)
    at = bounds[:-1]
    out[at] = _scaled(np.exp(field.first - field.first.max()) * local[at])
    for t in range(1, int(lengths.max(initial=1))):
        at = bounds[:-1][lengths > t] + t
        out[at] = _scaled((out[at - 1] @ step) * local[at])
    return out
