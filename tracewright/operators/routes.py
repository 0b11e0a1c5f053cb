"""Wires of one sheet laid one after the other, in numpy; wiring.routed() takes it for sheets that fit a task.

The same choices as the column expressions in functions.routing and the joins in operators.wiring, on the same numbers.
"""

from __future__ import annotations

import numpy as np

from tracewright.functions.routing import ALONG, BEND, EPSILON, ESCAPES, NARROW, TRUNKS, WIDE

#: Candidates that are tried at once, from the cheapest.
TRIED = 16


def grid(v: np.ndarray) -> np.ndarray:
    """v on the grid of 5, halves away from zero."""
    size = np.abs(v / 5)
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), v) * 5 + 0.0


def turns(a: float, b: float, reach: tuple[float, float, float]) -> np.ndarray:
    """See functions.routing.channels."""
    inside, step, outside = reach
    low, high, middle = min(a, b), max(a, b), float(grid(np.float64((a + b) / 2)))
    k = np.arange(int(inside // step) + 1) * step
    near = np.stack([middle - k, middle + k], 1).ravel()
    near = near[(near > low + EPSILON) & (near < high - EPSILON)]
    k = np.arange(1, int(outside // step) + 1) * step
    beyond = np.stack([low - k, high + k], 1).ravel()
    return np.array(list(dict.fromkeys(grid(np.concatenate([near, beyond])).tolist())), np.float64)


def tidied(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths (a row each) without points at the same place as the one before, and how many points each has left."""
    x, y, n = x.copy(), y.copy(), np.ones(len(x), np.int64)
    every = np.arange(len(x))
    for j in range(1, x.shape[1]):
        moved = (np.abs(x[every, n - 1] - x[:, j]) >= EPSILON) | (np.abs(y[every, n - 1] - y[:, j]) >= EPSILON)
        at = every[moved]
        x[at, n[at]], y[at, n[at]] = x[at, j], y[at, j]
        n += moved
    return x, y, n


def on(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether points lie on segments, see functions.routing.on_segment."""
    upright = np.abs(x1 - x2) < EPSILON
    low, high = np.where(upright, np.minimum(y1, y2), np.minimum(x1, x2)) - EPSILON, np.where(upright, np.maximum(y1, y2), np.maximum(x1, x2)) + EPSILON
    along = np.where(upright, py, px)
    return (np.abs(np.where(upright, px, py) - np.where(upright, x1, y1)) < EPSILON) & (along > low) & (along < high)


def together(x1, y1, x2, y2, u1, v1, u2, v2) -> np.ndarray:
    """Whether segments run together with others, see functions.routing.run_together."""
    upright, other = np.abs(x1 - x2) < EPSILON, np.abs(u1 - u2) < EPSILON
    common = lambda a, b, c, d: np.minimum(np.maximum(a, b), np.maximum(c, d)) - np.maximum(np.minimum(a, b), np.minimum(c, d)) > EPSILON
    return (upright == other) & np.where(upright, (np.abs(x1 - u1) < EPSILON) & common(y1, y2, v1, v2), (np.abs(y1 - v1) < EPSILON) & common(x1, x2, u1, u2))


class _Choice:
    """What an edge from a to b sees: foreign points but those at its ends, foreign lines, lines of its own net."""

    def __init__(self, a, b, points, foreign, own):
        self.a, self.b, self.own, self.lines = a, b, own, foreign
        self.points = points[:, ~(self._at_end(points[0], points[1]))]

    def _at_end(self, x, y):
        return ((np.abs(x - self.a[0]) < EPSILON) & (np.abs(y - self.a[1]) < EPSILON)) | ((np.abs(x - self.b[0]) < EPSILON) & (np.abs(y - self.b[1]) < EPSILON))

    def clear(self, x, y, n):
        """Whether paths touch nothing foreign but at the ends."""
        free, place = np.ones(len(x), bool), np.arange(x.shape[1])
        of, j = np.nonzero(place[:-1] + 1 < n[:, None])
        s = (v[of, i][:, None] for i in (j, j + 1) for v in (x, y))
        free[of[on(self.points[0], self.points[1], *s).any(1)]] = False
        of, j = np.nonzero((place < n[:, None]) & ~self._at_end(x, y))
        free[of[on(x[of, j][:, None], y[of, j][:, None], *self.lines).any(1)]] = False
        return free

    def direct(self, reach):
        """The cheapest clear path with two bends at most."""
        (ax, ay), (bx, by) = self.a, self.b
        straight = [([ax, bx, bx, bx], [ay, by, by, by])] if abs(ax - bx) < EPSILON or abs(ay - by) < EPSILON else []
        bent = [([ax, bx, bx, bx], [ay, ay, by, by]), ([ax, ax, bx, bx], [ay, by, by, by])]
        xs, ys = turns(ax, bx, reach), turns(ay, by, reach)
        one, two = np.ones(len(xs)), np.ones(len(ys))
        x = np.concatenate([[p[0] for p in straight + bent], np.stack([ax * one, xs, xs, bx * one], 1), np.stack([ax * two, ax * two, bx * two, bx * two], 1)])
        y = np.concatenate([[p[1] for p in straight + bent], np.stack([ay * one, ay * one, by * one, by * one], 1), np.stack([ay * two, ys, ys, by * two], 1)])
        x, y, n = tidied(x, y)
        x, y, n = x[n > 1], y[n > 1], n[n > 1]
        leg = np.arange(3) + 1 < n[:, None]
        each = np.where(leg, np.abs(x[:, 1:] - x[:, :-1]) + np.abs(y[:, 1:] - y[:, :-1]), 0.0)
        doubled = np.zeros(len(x), np.int64)
        if self.own.shape[1]:
            doubled = (leg & together(*(v[:, part, None] for part in (slice(0, 3), slice(1, 4)) for v in (x, y)), *self.own).any(2)).sum(1)
        price = each[:, 0] + each[:, 1] + each[:, 2] + BEND * (n - 2) + ALONG * doubled
        order = price.argsort(kind="stable")
        for first in range(0, len(order), TRIED):
            part = order[first : first + TRIED]
            free = self.clear(x[part], y[part], n[part])
            if free.any():
                best = part[free.argmax()]
                return x[best, : n[best]], y[best, : n[best]]
        return None

    def escaping(self, out_a, out_b):
        """The first clear path that leaves both pins sideways and joins them by a level trunk."""
        side = np.array(ESCAPES, np.float64)
        right, left = np.concatenate([side, -side]), np.concatenate([-side, side])
        for level in turns(self.a[1], self.b[1], TRUNKS):
            halves = []
            for at, out in ((self.a, out_a), (self.b, out_b)):
                away = grid(at[0] + (right if out else left))
                x, y, n = tidied(np.stack([np.full(len(away), at[0]), away, away], 1), np.tile([at[1], at[1], level], (len(away), 1)))
                last = np.minimum(np.arange(3), n[:, None] - 1)
                free = self.clear(x, y, n)
                halves.append((np.take_along_axis(x, last, 1)[free], np.take_along_axis(y, last, 1)[free]))
            (ax, ay), (bx, by) = halves
            i, j = np.divmod(np.arange(len(ax) * len(bx)), max(len(bx), 1))
            x, y, n = tidied(np.concatenate([ax[i], bx[j, ::-1]], 1), np.concatenate([ay[i], by[j, ::-1]], 1))
            free = self.clear(x, y, n)
            if free.any():
                best = free.argmax()
                return x[best, : n[best]], y[best, : n[best]]
        return None

    def plain(self, middle):
        """See functions.routing.manhattan."""
        (ax, ay), (bx, by) = self.a, self.b
        if abs(ax - bx) < 1 or abs(ay - by) < 1:
            return np.array([ax, bx]), np.array([ay, by])
        if middle:
            m = float(grid(np.float64((ax + bx) / 2)))
            return np.array([ax, m, m, bx]), np.array([ay, ay, by, by])
        return np.array([ax, bx, bx]), np.array([ay, ay, by])


def laid(edges: dict, points: tuple, lines: tuple) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The paths (x, y, clear) of a sheet's edges, one after the other.

    edges: arrays net, x1, y1, x2, y2, out_a, out_b and in_b (whether an end is an output, or the second an input); points
    (net, array of x and y) and lines (net, array of x1, y1, x2, y2) stand before. Net 0 is foreign to all.
    """
    n, (tip_net, tips), (line_net, ends) = len(edges["net"]), points, lines
    p, s = len(tip_net), len(line_net)
    tip_net, line_net = (np.concatenate([v, np.zeros(6 * n, np.int64)]) for v in (tip_net, line_net))
    tips, ends = (np.concatenate([v, np.zeros((len(v), 6 * n))], 1) for v in (tips, ends))
    out = []
    for net, ax, ay, bx, by, out_a, out_b, in_b in zip(*(edges[c].tolist() for c in ("net", "x1", "y1", "x2", "y2", "out_a", "out_b", "in_b"))):
        own = line_net[:s] == net
        sees = _Choice((ax, ay), (bx, by), tips[:, :p][:, tip_net[:p] != net], ends[:, :s][:, ~own], ends[:, :s][:, own])
        found = sees.direct(NARROW) or sees.direct(WIDE) or sees.escaping(out_a, out_b)
        x, y = found or sees.plain(out_a or in_b)
        out.append((x, y, found is not None))
        k = len(x)
        tips[:, p : p + k], tip_net[p : p + k] = (x, y), net
        ends[:, s : s + k - 1], line_net[s : s + k - 1] = (x[:-1], y[:-1], x[1:], y[1:]), net
        p, s = p + k, s + k - 1
    return out
