"""Areas of many regions at once: the arrangement of ``overlay`` for all rows of a column, laid side by side."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from massif.functions import overlay

#: Edges that are arranged at once, rows that are at most, and the width of a row's place.
_EDGES, _TOGETHER, _SPAN = 1 << 14, 1 << 11, 1 << 30


class Regions:
    """Regions in flat arrays: for each ring its row, its place in its polygon (0: the shell) and its number of points; all points."""

    def __init__(self, n: int, polygons: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, xy: np.ndarray):
        self.n, self.polygons, self.row, self.place, self.size, self.xy = n, polygons, row, place, size, xy
        self.start = np.cumsum(size) - size
        self.ring = np.repeat(np.arange(len(size)), size)
        after = np.arange(len(xy)) + 1
        after[(self.start + size - 1)[size > 0]] = self.start[size > 0]
        self.after = xy[after]
        p, q = xy - xy[self.start[self.ring]], self.after - xy[self.start[self.ring]]
        self.signed = np.where(size > 2, self._sum(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2, 0.0)

    @classmethod
    def of_column(cls, column: pa.Array) -> "Regions":
        """Multipolygon coordinates, whose rings repeat their first point; null: no polygon."""

        def opened(lists):
            return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()

        polygons, lists = opened(column)
        rings, lists = opened(lists)
        size, lists = opened(lists)
        values, flat = opened(lists)
        at = np.cumsum(values) - values
        flat = flat.to_numpy(zero_copy_only=False).astype(float)
        last = np.zeros(len(values), bool)
        last[(np.cumsum(size) - 1)[size > 0]] = True
        xy = np.stack([flat[at[~last]], flat[at[~last] + 1]], axis=1)
        place = np.arange(rings.sum()) - np.repeat(np.cumsum(rings) - rings, rings)
        return cls(len(column), polygons, np.repeat(np.repeat(np.arange(len(column)), polygons), rings), place, np.maximum(size - 1, 0), xy)

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.ring, values, len(self.size))

    def region(self, row: int) -> list[list[np.ndarray]]:
        """One row as a region."""
        out = []
        for k in np.flatnonzero(self.row == row):
            ring = self.xy[self.start[k] : self.start[k] + self.size[k]]
            if self.place[k] == 0:
                out.append([])
            out[-1].append(ring)
        return out

    def united(self) -> "Regions":
        """The same with rows of several polygons as the disjoint polygons of their repair, so that a point's rings are counted for a row as for a polygon."""
        several = np.flatnonzero(self.polygons > 1)
        if not len(several):
            return self
        made = [(i, k, r) for i in several for p in overlay.repaired(self.region(i)) for k, r in enumerate(p)]
        keep = ~np.isin(self.row, several)
        row, place, size = (np.concatenate([old[keep], np.array([m[j] if j < 2 else len(m[2]) for m in made], np.int64)]) for j, old in enumerate((self.row, self.place, self.size)))
        return Regions(self.n, self.polygons, row, place, size, np.concatenate([self.xy[keep[self.ring]], *(m[2] for m in made)]))

    def area(self) -> np.ndarray:
        return np.bincount(self.row, np.abs(self.signed) * np.where(self.place == 0, 1, -1), self.n)

    def length(self) -> np.ndarray:
        return np.bincount(self.row, self._sum(np.hypot(*(self.after - self.xy).T)), self.n)

    def bare(self) -> np.ndarray:
        """Rows with a ring of fewer than three points."""
        return np.bincount(self.row, self.size < 3, self.n) > 0

    def bounds(self) -> np.ndarray:
        """The smallest and largest x and y of each row; of empty ones none is smaller or larger."""
        out = np.tile([np.inf, np.inf, -np.inf, -np.inf], (self.n, 1))
        where = self.row[self.ring]
        np.minimum.at(out[:, :2], where, self.xy)
        np.maximum.at(out[:, 2:], where, self.xy)
        return out

    def edges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges of some rows (a mask), their rows, and 1 or, where shells would run clockwise or holes counter-clockwise, -1."""
        use = (rows[self.row] & (self.size > 2))[self.ring]
        forth = np.where((self.signed > 0) == (self.place == 0), 1, -1)
        return np.concatenate([self.xy, self.after], axis=1)[use], self.row[self.ring][use], forth[self.ring][use]


def apart(a: Regions, b: Regions) -> np.ndarray:
    """Rows whose boxes share no area."""
    p, q = a.bounds(), b.bounds()
    return (p[:, 0] >= q[:, 2]) | (q[:, 0] >= p[:, 2]) | (p[:, 1] >= q[:, 3]) | (q[:, 1] >= p[:, 3])


def areas(rows: np.ndarray, sides: list[Regions], insides: list) -> np.ndarray:
    """For the rows of a mask (others: 0) the area where each of ``insides`` holds: functions of how often each side's directed rings wind around points."""
    out = np.zeros((len(rows), len(insides)))
    found = [x.edges(rows) for x in sides]
    side = np.repeat(np.arange(len(sides)), [len(f[0]) for f in found])
    s, row, weight = (np.concatenate([f[k] for f in found]) for k in range(3))
    if not np.isfinite(s).all():
        raise ValueError("a coordinate isn't finite")
    order = np.argsort(row, kind="stable")
    s, row, weight, side = s[order], row[order], weight[order], side[order]
    own, first, many = np.unique(row, return_index=True, return_counts=True)
    at = 0
    while at < len(own):
        to = at + max(1, min(_TOGETHER, int(np.searchsorted(first[at:] + many[at:], first[at] + _EDGES, "right"))))
        part = slice(first[at], first[to - 1] + many[to - 1])
        out[own[at:to]] = _areas(s[part], np.repeat(np.arange(to - at), many[at:to]), weight[part], side[part], len(sides), insides)
        at = to
    return out


def _areas(s: np.ndarray, job: np.ndarray, weight: np.ndarray, side: np.ndarray, sides: int, insides: list) -> np.ndarray:
    """The areas of a few jobs (in order from 0); each has its own decimal grid, and they lie side by side along x."""
    first = np.flatnonzero(np.concatenate([[True], job[1:] != job[:-1]]))
    zero, far = np.minimum.reduceat(s[:, :2], first), np.maximum.reduceat(s[:, :2], first)  # rings are closed: all points start an edge
    scale = 10.0 ** np.floor(np.log10(overlay._LIMIT / np.maximum((far - zero).max(axis=1), 1e-9)))
    base = np.rint(zero * scale[:, None])
    grid = (np.rint(s * scale[job, None]) - np.tile(base[job], 2)).astype(np.int64)
    grid[:, [0, 2]] += (job * _SPAN)[:, None]
    real = np.flatnonzero((grid[:, :2] != grid[:, 2:]).any(axis=1))
    if not len(real):
        return np.zeros((len(first), len(insides)))
    t, source = overlay._split(grid[real], real)
    back = (t[:, 0] > t[:, 2]) | ((t[:, 0] == t[:, 2]) & (t[:, 1] > t[:, 3]))
    t[back] = t[back][:, [2, 3, 0, 1]]
    order = np.lexsort(t.T[::-1])  # by place, so job by job
    t, source, back = t[order], source[order], back[order]
    fresh = np.concatenate([[True], (t[1:] != t[:-1]).any(axis=1)])
    at = np.cumsum(fresh) - 1
    edges, owner = t[fresh], job[source[fresh]]
    turns = np.where(back, -1, 1) * weight[source]
    net = np.stack([np.bincount(at, turns * (side[source] == k), len(edges)) for k in range(sides)], axis=1).astype(np.int64)
    some = (net != 0).any(axis=1)
    edges, owner, net = edges[some], owner[some], net[some]
    edges[:, [0, 2]] -= (owner * _SPAN)[:, None]
    left, right = _winding(edges, owner, net)
    x0, y0, x1, y1 = edges.astype(float).T
    cross = (x0 * y1 - x1 * y0) / 2
    sums = [np.bincount(owner, cross * (inside(left).astype(int) - inside(right).astype(int)), len(first)) for inside in insides]
    return np.stack(sums, axis=1) / (scale**2)[:, None]


def _winding(edges: np.ndarray, owner: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``overlay._winding`` with each edge among those of its own job only."""
    n = len(edges)
    left, right = np.zeros_like(net), np.zeros_like(net)
    low, many = np.searchsorted(owner, owner, "left"), np.bincount(owner)[owner] if n else np.zeros(0, np.int64)
    mid = edges[:, :2] + edges[:, 2:]  # twice the middle
    ends = np.cumsum(many)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at] - many[at]) + overlay._ROWS // 4, "right")))
        own = np.arange(at, to)
        i = np.repeat(own, many[at:to])
        j = np.arange(len(i)) - np.repeat(ends[at:to] - many[at:to] - (ends[at] - many[at]), many[at:to]) + low[i]
        for axis, upright in ((0, False), (1, True)):
            mine = (edges[i, 0] == edges[i, 2]) == upright
            a, b = i[mine], j[mine]
            lo, hi = np.minimum(edges[b, axis], edges[b, 2 + axis]), np.maximum(edges[b, axis], edges[b, 2 + axis])
            within = (2 * lo <= mid[a, axis]) & (mid[a, axis] < 2 * hi)
            a, b = a[within], b[within]
            rising = edges[b, 2 + axis] > edges[b, axis]
            f = np.where(rising[:, None], edges[b], edges[b][:, [2, 3, 0, 1]])
            turn = (f[:, 2] - f[:, 0]) * (mid[a, 1] - 2 * f[:, 1]) - (f[:, 3] - f[:, 1]) * (mid[a, 0] - 2 * f[:, 0])
            counts = turn < 0 if axis == 0 else turn > 0
            a, w = a[counts], (net[b] * np.where(rising, 1, -1)[:, None])[counts]
            far = np.stack([np.bincount(a - at, w[:, k], to - at) for k in range(net.shape[1])], axis=1).astype(np.int64)
            these = own[(edges[own, 0] == edges[own, 2]) == upright]
            if axis == 0:  # those above count, against their direction
                left[these], right[these] = -far[these - at], -far[these - at] - net[these]
            else:  # those to the right count
                right[these], left[these] = far[these - at], far[these - at] + net[these]
        at = to
    return left, right
