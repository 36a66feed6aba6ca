"""Numpy kernels for the pixels of one tile."""

from __future__ import annotations

from collections import deque

import numpy as np

FOUR = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, -1), (1, 0), (1, 1))


def moved(a: np.ndarray, di: int, dj: int, fill) -> np.ndarray:
    """``a`` at (i + di, j + dj) for each place; ``fill`` outside."""
    out = np.full(a.shape, fill, a.dtype)
    h, w = a.shape
    if abs(di) >= h or abs(dj) >= w:
        return out
    rows, columns = slice(max(0, di), min(h, h + di)), slice(max(0, dj), min(w, w + dj))
    out[max(0, -di) : min(h, h - di), max(0, -dj) : min(w, w - dj)] = a[rows, columns]
    return out


def regions(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """For each place of a mask the flat index of its region's first place; -1 elsewhere."""
    flat = np.arange(mask.size).reshape(mask.shape)
    left, right = [], []
    for di, dj in EIGHT if eight else FOUR:
        other = moved(flat, di, dj, -1)
        both = mask & (other >= 0) & moved(mask, di, dj, False)
        left.append(flat[both])
        right.append(other[both])
    a, b, label = np.concatenate(left), np.concatenate(right), flat.ravel().copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return np.where(mask, label.reshape(mask.shape), -1)
        label = new


def without_small(root: np.ndarray, least: int) -> np.ndarray:
    """``root`` with -1 for regions of fewer than ``least`` places."""
    size = np.bincount(root[root >= 0], minlength=root.size)
    return np.where((root >= 0) & (size[root] >= least), root, -1)


def holes(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """The places of background regions that do not reach the edge, of at most ``most`` places."""
    root = regions(~mask, eight=False)
    size = np.bincount(root[root >= 0], minlength=root.size)
    edge = np.zeros(root.size, bool)
    for side in (root[0], root[-1], root[:, 0], root[:, -1]):
        edge[side[side >= 0]] = True
    inside = (root >= 0) & ~edge[root]
    return inside if most is None else inside & (size[root] <= most)


#: Places at which a flood's front is followed one by one rather than as arrays.
_FEW = 24


def flood(height: np.ndarray, marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The marker (above 0) that reaches each place of the mask over the lowest pass; 0 where none does.

    Places look at their four neighbours: the lower pass wins, then the fewer steps, then the smaller
    marker. The queue is ordered by steps and holds the places that changed in the last one; only they
    can change their neighbours, so each place is met once for every lower pass by which it is reached,
    and not once for every step of the longest path.
    """
    start = (marker > 0) & mask
    level = np.pad(np.where(mask, height, np.inf).astype(float), 1, constant_values=np.inf).ravel()
    cost = np.pad(np.where(start, height, np.inf).astype(float), 1, constant_values=np.inf).ravel()
    held = np.pad(np.where(start, marker, 0).astype(np.int64), 1).ravel()
    wide = height.shape[1] + 2
    around = (-wide, wide, -1, 1)
    front = np.flatnonzero(held)
    views = memoryview(level), memoryview(cost), memoryview(held)
    while len(front):
        if len(front) <= _FEW:
            front = _few_steps(list(map(int, front)), around, *views)
            continue
        to = np.concatenate([front + d for d in around])
        source, by = np.tile(cost[front], 4), np.tile(held[front], 4)
        good = np.flatnonzero(np.maximum(source, level[to]) < cost[to])
        to, source, by = to[good], source[good], by[good]
        # Of the neighbours that changed, the one with the lowest pass counts, then that with the smallest marker.
        order = np.lexsort((by, source, to))
        to, source, by = to[order], source[order], by[order]
        first = np.concatenate(([True], to[1:] != to[:-1]))[: len(to)]
        front, source = to[first], source[first]
        cost[front] = np.maximum(source, level[front])
        held[front] = by[first]
    return held.reshape(height.shape[0] + 2, wide)[1:-1, 1:-1].astype(marker.dtype)


def _few_steps(front: list[int], around: tuple[int, ...], level: memoryview, cost: memoryview, held: memoryview) -> np.ndarray:
    """Steps of a flood as long as few places change in each."""
    while 0 < len(front) <= _FEW:
        best: dict[int, tuple[float, int]] = {}
        for place in front:
            own = cost[place], held[place]
            for d in around:
                to = place + d
                if own[0] < cost[to] and level[to] < cost[to] and (to not in best or own < best[to]):
                    best[to] = own
        for to, (source, by) in best.items():
            cost[to], held[to] = max(source, level[to]), by
        front = list(best)
    return np.array(front, np.int64)


def _disk_maximum(a: np.ndarray, radius: int) -> np.ndarray:
    """The greatest value of the disk around each place, its lines' maxima put together from windows of lengths that are powers of two."""
    high, wide = a.shape
    padded = np.pad(a, ((radius, radius), (radius, radius)), constant_values=-np.inf)
    windows = [padded]
    while 2 << len(windows) - 1 <= 2 * radius + 1:
        step = 1 << len(windows) - 1
        windows.append(np.maximum(windows[-1][:, :-step], windows[-1][:, step:]))
    out = np.full(a.shape, -np.inf)
    for d in range(-radius, radius + 1):
        half = int((radius * radius - d * d) ** 0.5 + 1e-9)
        k = (2 * half + 1).bit_length() - 1
        line = windows[k][radius + d : radius + d + high]
        left, right = radius - half, radius + half + 1 - (1 << k)
        np.maximum(out, np.maximum(line[:, left : left + wide], line[:, right : right + wide]), out=out)
    return out


#: Side of the squares that a reconstruction looks at one by one.
_SQUARE = 64


def reconstructed(seed: np.ndarray, limit: np.ndarray, radius: int) -> np.ndarray:
    """``seed`` grown by disks of ``radius`` under ``limit`` until nothing changes.

    Squares are taken from a queue and grown by themselves until they rest; only when a place near a
    side has changed do the squares beyond it join the queue again.
    """
    out = np.minimum(seed, limit)
    if radius < 1:
        return out
    side = max(_SQUARE, 2 * radius)
    rows, columns = -(-out.shape[0] // side), -(-out.shape[1] // side)
    queue = deque((r, c) for r in range(rows) for c in range(columns))
    queued = set(queue)
    while queue:
        r, c = queue.popleft()
        queued.discard((r, c))
        top, left = r * side, c * side
        at = slice(max(0, top - radius), top + side + radius), slice(max(0, left - radius), left + side + radius)
        own = slice(top - at[0].start, top - at[0].start + side), slice(left - at[1].start, left - at[1].start + side)
        part, most = out[at].copy(), limit[top : top + side, left : left + side]
        before = part[own].copy()
        while True:
            grown = np.minimum(most, _disk_maximum(part, radius)[own])
            if (grown == part[own]).all():
                break
            part[own] = np.maximum(part[own], grown)
        changed = part[own] != before
        if not changed.any():
            continue
        out[top : top + side, left : left + side] = part[own]
        near = {0: changed.any(), -1: changed[:radius].any(), 1: changed[-radius:].any()}, {0: True, -1: changed[:, :radius].any(), 1: changed[:, -radius:].any()}
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                beside = r + dr, c + dc
                if (dr or dc) and near[0][dr] and near[1][dc] and 0 <= beside[0] < rows and 0 <= beside[1] < columns and beside not in queued:
                    queue.append(beside)
                    queued.add(beside)
    return out


def correlate(a: np.ndarray, weights: list[tuple[int, int, float]]) -> np.ndarray:
    """The weighted sum of the places around each; outside counts as zero."""
    out = np.zeros(a.shape)
    for di, dj, w in weights:
        out += w * moved(a, di, dj, 0.0)
    return out


def median(a: np.ndarray, before: int, after: int) -> np.ndarray:
    """The median of the box around each place, of those places that are numbers; some rows at a time."""
    wide = np.pad(a, ((before, after), (before, after)), constant_values=np.nan)
    size, out = before + after + 1, np.empty(a.shape)
    step = max(1, (1 << 22) // (a.shape[1] * size * size))
    for at in range(0, len(a), step):
        part = wide[at : at + step + size - 1]
        boxes = np.lib.stride_tricks.sliding_window_view(part, (size, size)).reshape(len(part) - size + 1, a.shape[1], -1)
        known = ~np.isnan(boxes)
        n = known.sum(axis=2)
        ordered = np.sort(boxes, axis=2)  # numbers first
        pick = lambda k: np.take_along_axis(ordered, np.clip(k, 0, size * size - 1)[..., None], 2)[..., 0]
        out[at : at + step] = (pick((n - 1) // 2) + pick(n // 2)) / 2
    return out


def stretched(a: np.ndarray) -> np.ndarray:
    """``a`` from its own range to 0..1; a constant array becomes 0."""
    low, high = a.min(), a.max()
    return (a - low) / (high - low) if high > low else np.zeros(a.shape)
