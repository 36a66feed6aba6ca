"""Breadth-first search from many nodes of one graph at once; neighbours of node k are ``near[ptr[k] : ptr[k + 1]]``."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits in which the sources of a block are kept.
WORDS = 8
#: Neighbours of a node that are looked up one column at a time; nodes with more have the rest as a span.
_COLUMNS = 8


def blocks(ptr: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The nodes in an order in which those of a block are near each other, so that they reach others in about the same steps."""
    starts, others, taken, order = ptr.tolist(), near.tolist(), bytearray(len(ptr) - 1), []
    beside: list[int] = []
    for first in range(len(taken)):
        beside.append(first)
        while beside:
            start = beside.pop()
            if taken[start]:
                continue
            taken[start] = 1
            ball = [start]
            for node in ball:
                for other in others[starts[node] : starts[node + 1]]:
                    if not taken[other] and len(ball) < 64 * WORDS:
                        taken[other] = 1
                        ball.append(other)
            order += ball
            beside += (o for node in ball for o in others[starts[node] : starts[node + 1]] if not taken[o])
    return np.array(order, np.int64)


def _spans(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of spans in a row, and where each span begins among them."""
    begin = np.cumsum(length) - length
    return np.arange(length.sum()) + np.repeat(first - begin, length), begin


def farthest(ptr: np.ndarray, near: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """How many steps the farthest node that can be reached is from each of ``sources``; every node must have a neighbour.

    A node's bits say from which sources of a block it has been reached. A step looks only at the
    neighbours of what the last one reached.
    """
    n, degree, out = len(ptr) - 1, np.diff(ptr), np.zeros(len(sources), np.int64)
    columns = np.full((min(int(degree.max()), _COLUMNS), n), n, np.int32)
    for k, column in enumerate(columns):
        has = np.flatnonzero(degree > k)
        column[has] = near[ptr[has] + k]
    rest, after = np.maximum(degree - len(columns), 0), ptr[:-1] + len(columns)
    # Row n stands for no neighbour.
    seen, fresh, mark = np.zeros((n + 1, WORDS), np.uint64), np.zeros((n + 1, WORDS), np.uint64), np.zeros(n + 1, bool)
    for low in range(0, len(sources), 64 * WORDS):
        own = sources[low : low + 64 * WORDS]
        at = np.arange(len(own))
        seen[own, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        front = np.sort(own)
        fresh[front] = seen[front]
        met = [front]
        while len(front):
            for column in columns:
                mark[column.take(front)] = True
            hubs = front[rest.take(front) > 0]
            mark[near[_spans(after[hubs], rest[hubs])[0]]] = True
            mark[n] = False
            to = np.flatnonzero(mark)
            mark[to] = False
            new = fresh.take(columns[0].take(to), axis=0)
            for column in columns[1:]:
                new |= fresh.take(column.take(to), axis=0)
            crowded = np.flatnonzero(rest.take(to) > 0)
            if len(crowded):
                places, begin = _spans(after[to[crowded]], rest[to[crowded]])
                new[crowded] |= np.bitwise_or.reduceat(fresh.take(near[places], axis=0), begin, axis=0)
            new &= ~seen.take(to, axis=0)
            kept = new.any(axis=1)
            fresh[front] = 0
            front, new = to[kept], new[kept]
            seen[front] |= new
            fresh[front] = new
            met.append(front)
            reached = np.bitwise_or.reduce(new, axis=0).astype("<u8").view(np.uint8)
            out[low : low + 64 * WORDS] += np.unpackbits(reached, bitorder="little")[: len(own)]
        seen[np.concatenate(met)] = 0
    return out
