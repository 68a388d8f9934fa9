"""Algorithms on a graph that one task can hold, on its arrays; ``algorithms`` decides which graphs those are.

Each function takes a task's Arrow batches of (src, dst), where a row without dst is a vertex, and gives Arrow batches. Vertices are numbered by
their ids, so the order of numbers is that of ids. Edges with an end that is no vertex carry nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def _read(batches: Batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and of the edges between them the numbers of both ends; all edges that leave each vertex."""
    vids, srcs, dsts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in batches:
        src, dst = b.column(0), b.column(1)
        if dst.null_count:
            vids.append(src.filter(dst.is_null()).to_numpy(zero_copy_only=False))
            src, dst = src.filter(dst.is_valid()), dst.filter(dst.is_valid())
        srcs.append(src.to_numpy(zero_copy_only=False))
        dsts.append(dst.to_numpy(zero_copy_only=False))
    ids = np.unique(np.concatenate(vids))
    (u, from_v), (w, to_v) = _numbers(ids, np.concatenate(srcs)), _numbers(ids, np.concatenate(dsts))
    degree = np.bincount(u[from_v], minlength=len(ids))
    inside = from_v & to_v
    return ids, u[inside], w[inside], degree


def _numbers(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return np.zeros(len(of), np.int32), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1).astype(np.int32)
    return at, ids[at] == of


def _give(**columns: np.ndarray) -> Batches:
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=100_000)


class _Out:
    """The edges by their first end."""

    def __init__(self, u: np.ndarray, w: np.ndarray, n: int) -> None:
        self.w = w[np.argsort(u, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))])

    def of(self, front: np.ndarray) -> np.ndarray:
        begin, many = self.start[front], self.start[front + 1] - self.start[front]
        return self.w[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def levels(self, source: int) -> np.ndarray:
        """Hops from ``source``, -1 for what it does not reach."""
        level = np.full(len(self.start) - 1, -1, np.int32)
        front, k = np.array([source]), 0
        while len(front):
            level[front] = k
            k += 1
            to = self.of(front)
            front = np.unique(to[level[to] < 0])
        return level


def pagerank(batches: Batches, iterations: int, tolerance: float | None, damping: float) -> Batches:
    """vid, rank, and in every row delta and rounds."""
    ids, u, w, degree = _read(batches)
    n = len(ids)
    order = np.argsort(u, kind="stable")
    u, w = u[order], w[order]
    share = damping / np.maximum(degree, 1)
    x, delta, done = np.full(n, 1.0 / max(n, 1)), 2.0, 0
    while n and done < iterations and (tolerance is None or delta > tolerance):
        y = np.bincount(w, weights=(x * share)[u], minlength=n)
        y += (1.0 - y.sum()) / n
        delta, x, done = float(np.abs(y - x).sum()), y, done + 1
    yield from _give(vid=ids, rank=x / (x.sum() or 1.0), delta=np.full(n, delta), rounds=np.full(n, done, np.int32))


def wcc(batches: Batches) -> Batches:
    """vid, component: roots hang on the smallest root that an edge leads to, until no edge joins two trees."""
    ids, u, w, _ = _read(batches)
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[w]
        apart = a != b
        if not apart.any():
            break
        u, w, a, b = u[apart], w[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield from _give(vid=ids, component=ids[root])


def bfs(batches: Batches, source: int | None) -> Batches:
    """vid, level of what ``source``, or the smallest id, reaches."""
    ids, u, w, _ = _read(batches)
    at = np.flatnonzero(ids == (ids[0] if source is None else source)) if len(ids) else []
    level = _Out(u, w, len(ids)).levels(at[0]) if len(at) else np.full(len(ids), -1, np.int32)
    yield from _give(vid=ids[level >= 0], level=level[level >= 0])


def scc(batches: Batches) -> Batches:
    """vid, component: the component of the vertex with most edges, by searches both ways, then Tarjan's on what it leaves.

    A path between two vertices of another component never enters that one.
    """
    ids, u, w, _ = _read(batches)
    n = len(ids)
    component = np.arange(n)
    if n and len(u):
        hub = int(np.argmax(np.minimum(np.bincount(u, minlength=n), np.bincount(w, minlength=n))))
        giant = (_Out(u, w, n).levels(hub) >= 0) & (_Out(w, u, n).levels(hub) >= 0)
        component[giant] = np.flatnonzero(giant).max()
        rest = ~giant[u] & ~giant[w] & (u != w)
        u, w = u[rest], w[rest]
        some, ends = np.unique(np.concatenate([u, w]), return_inverse=True)
        found = _tarjan(_Out(ends[: len(u)], ends[len(u) :], len(some)), len(some))
        component[some] = some[found]
    yield from _give(vid=ids, component=ids[component])


def _tarjan(out: _Out, n: int) -> np.ndarray:
    """The greatest number in each vertex's component."""
    start, w = out.start.tolist(), out.w.tolist()
    index, low, on, component = [-1] * n, [0] * n, bytearray(n), np.arange(n)
    stack, count = [], 0
    at = start[:-1]
    for first in range(n):
        if index[first] >= 0:
            continue
        path = [first]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = 1
            if at[v] < start[v + 1]:
                x = w[at[v]]
                at[v] += 1
                if index[x] < 0:
                    path.append(x)
                elif on[x]:
                    low[v] = min(low[v], index[x])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    x = stack.pop()
                    on[x] = 0
                    members.append(x)
                    if x == v:
                        break
                component[members] = max(members)
    return component
