"""Vector geometry of rings: hulls, rectangles, circles, simplification, regularisation, triangulation, prisms.

A ring is an (n, 2) array without a repeated last point; shells run counter-clockwise, holes clockwise.
The kernels see one shape at a time and are called from Arrow-batched maps; ring areas and lengths that
Spark can express are in ``scalar``.
"""

import math

import numpy as np

from massif.functions import overlay


def signed_area(ring) -> float:
    p = np.asarray(ring, float)
    x, y = (p - p[0]).T if len(p) else (np.zeros(0), np.zeros(0))
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def turned(ring, ccw: bool) -> np.ndarray:
    p = np.asarray(ring, float)
    return p if (signed_area(p) > 0) == ccw else p[::-1]


def perimeter(ring) -> float:
    p = np.asarray(ring, float)
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def contains(ring, x: float, y: float) -> bool:
    """Whether a point is inside, by the parity of the edges to its right."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    cross = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return bool((cross & (x < at)).sum() % 2)


def hull(points) -> np.ndarray:
    """The convex hull, counter-clockwise, without collinear points."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(points):
        out: list[tuple[float, float]] = []
        for c in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def rectangle(points) -> np.ndarray | None:
    """The smallest rotated rectangle (4 corners, counter-clockwise); None for points on a line."""
    h = hull(points)
    if len(h) < 3:
        return None
    edges = np.roll(h, -1, axis=0) - h
    u = edges / np.hypot(*edges.T)[:, None]
    v = np.stack([-u[:, 1], u[:, 0]], axis=1)
    a, b = h @ u.T, h @ v.T
    best = int(np.argmin((a.max(axis=0) - a.min(axis=0)) * (b.max(axis=0) - b.min(axis=0))))
    low, high = (a[:, best].min(), b[:, best].min()), (a[:, best].max(), b[:, best].max())
    corners = np.array([low, (high[0], low[1]), high, (low[0], high[1])])
    return corners @ np.stack([u[best], v[best]])


def metrics(ring) -> tuple[float, float, float]:
    """Length, width and azimuth of the longest side of the smallest rectangle; degrees clockwise from north, below 180."""
    r = rectangle(ring)
    if r is None:
        return 0.0, 0.0, 0.0
    sides = [r[1] - r[0], r[2] - r[1]]
    long = max((0, 1), key=lambda i: (round(float(np.hypot(*sides[i])), 9), -i))
    azimuth = math.degrees(math.atan2(sides[long][0], sides[long][1])) % 180
    return float(np.hypot(*sides[long])), float(np.hypot(*sides[1 - long])), azimuth


def circle(points) -> tuple[float, float, float]:
    """The smallest enclosing circle (x, y, radius): points are added in order, each outside one lies on the circle."""

    def of(boundary):
        if not boundary:
            return 0.0, 0.0, -1.0
        if len(boundary) == 1:
            return *boundary[0], 0.0
        if len(boundary) == 2:
            (ax, ay), (bx, by) = boundary
            return (ax + bx) / 2, (ay + by) / 2, math.hypot(ax - bx, ay - by) / 2
        (ax, ay), (bx, by), (cx, cy) = boundary
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            return max((of([p, q]) for p in boundary for q in boundary if p != q), key=lambda c: c[2])
        x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + x, ay + y, math.hypot(x, y)

    def grow(pts, boundary):
        c = of(boundary)
        for i, p in enumerate(pts):
            if math.hypot(p[0] - c[0], p[1] - c[1]) > c[2] * (1 + 1e-12) + 1e-12:
                c = of([*boundary, p]) if len(boundary) == 2 else grow(pts[:i], [*boundary, p])
        return c

    return grow([tuple(p) for p in hull(points).tolist()], [])


def _thinned(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker from the ring's first point around to itself; at least a triangle stays on one side of the point that is farthest from it."""
    closed = np.vstack([p, p[:1]])

    def split(a: int, b: int) -> tuple[int, float]:
        d = closed[b] - closed[a]
        rel, n = closed[a + 1 : b] - closed[a], np.hypot(*d)
        away = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / n if n else np.hypot(*rel.T)
        k = int(np.argmax(away))
        return a + 1 + k, float(away[k])

    def points(a: int, b: int, forced: bool) -> list[int]:
        """The points kept between a and b."""
        out, todo = [], [(a, b, forced)]
        while todo:
            i, j, must = todo.pop()
            if j - i < 2:
                continue
            k, away = split(i, j)
            if away > tolerance or must:
                out.append(k)
                todo += [(i, k, False), (k, j, False)]
        return sorted(out)

    far, _ = split(0, len(p))
    left = points(0, far, True)
    right = points(far, len(p), len(left) < 2)
    keep = [0, *left, far, *right]
    if len(keep) > 3:  # the first point is no corner by itself
        before, after = closed[keep[-1]], closed[keep[1]]
        d = after - before
        t = float(np.clip((p[0] - before) @ d / max(d @ d, 1e-300), 0, 1))
        if np.hypot(*(p[0] - before - t * d)) <= tolerance:
            keep = keep[1:]
    return p[keep]


def simplify(ring, tolerance: float) -> np.ndarray:
    """The ring without points that lie within the tolerance of their neighbours' line.

    A result that crosses or touches itself, or has no area, is made again at half the tolerance, a few times; then the ring stays.
    """
    p = np.asarray(ring, float)
    for _ in range(6):
        if len(p) < 4 or tolerance <= 0:
            break
        out = _thinned(p, tolerance)
        if len(out) > 2 and overlay.valid([[out]]):
            return out
        tolerance /= 2
    return p


def orthogonal(ring) -> np.ndarray:
    """The ring with right angles only, along its rectangle's longest side.

    Neighbouring edges of one direction are a run, that lies at the mean of their middles; the run through the
    ring's first point, at the mean of its two parts' means.  With too few runs it is that rectangle; a result
    without area is the ring itself.
    """
    p, box = np.asarray(ring, float), rectangle(ring)
    if box is None:
        return p
    sides = np.roll(box, -1, axis=0) - box
    u = max(sides, key=lambda s: round(float(np.hypot(*s)), 9))
    u = u / np.hypot(*u)
    turn = np.stack([u, [-u[1], u[0]]], axis=1)
    q = p @ turn
    step = np.roll(q, -1, axis=0) - q
    flat = np.abs(step[:, 0]) >= np.abs(step[:, 1])
    mid = np.where(flat, (q[:, 1] + np.roll(q[:, 1], -1)) / 2, (q[:, 0] + np.roll(q[:, 0], -1)) / 2)
    runs = [(bool(flat[r[0]]), float(mid[r].mean())) for r in np.split(np.arange(len(q)), np.flatnonzero(np.diff(flat.astype(int))) + 1)]
    if len(runs) > 1 and runs[0][0] == runs[-1][0]:
        runs[0] = runs[0][0], (runs[0][1] + runs.pop()[1]) / 2
    if len(runs) < 4 or len(runs) % 2:
        return box
    out = np.array([(after, at) if level else (at, after) for (level, at), (_, after) in zip(runs, runs[1:] + runs[:1], strict=True)]) @ turn.T
    if overlay.valid([[out]]):
        return out
    whole = overlay.repair([out])
    return max((own[0] for own in whole), key=signed_area) if whole else p


def regularize(shell, holes=(), *, regular: bool = True, circularity: float = 0.8, rectangular: float = 0.4, tolerance: float = 0.9, min_hole: float = 4.0, segments: int = 32) -> tuple[list, str]:
    """A region made of a shell without its larger holes, and how: the simplified shell, or (``regular``) a circle, rectangle or right-angled ring for it.

    Which of these is decided by the simplified shell.  Holes of up to ``min_hole`` are dropped by their own
    area, the others are simplified and cut out.
    """
    simple, method = simplify(shell, tolerance), "simplified"
    out = simple
    if regular:
        size, around, box = abs(signed_area(simple)), perimeter(simple), rectangle(simple)
        if around > 0 and 4 * math.pi * size / around**2 >= circularity:
            x, y, r = circle(simple)
            t = np.arange(segments) * (2 * math.pi / segments)
            out, method = np.stack([x + r * np.cos(t), y + r * np.sin(t)], axis=1), "minimum_bounding_circle"
        elif box is not None and size >= rectangular * abs(signed_area(box)):
            out, method = box, "minimum_rotated_rectangle"
        else:
            out, method = orthogonal(simple), "orthogonalized"
    cuts = [[[simplify(h, tolerance)]] for h in holes if abs(signed_area(h)) > min_hole]
    region = [[turned(out, True)]]
    return (overlay.difference(region, overlay.union(*cuts)) if cuts else region), method


def _cross(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _blocks(a, b, c, d) -> bool:
    """Whether the segment c-d crosses or touches a-b anywhere but at a shared end."""
    if {tuple(a), tuple(b)} & {tuple(c), tuple(d)}:
        other = [p for p in (c, d) if tuple(p) not in {tuple(a), tuple(b)}]
        return any(_cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) for p in other)
    s = [np.sign(x) for x in (_cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b))]
    if s[0] == s[1] == 0:
        return max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))
    return s[0] * s[1] <= 0 and s[2] * s[3] <= 0


def _within(before, corner, after, q) -> bool:
    """Whether the way from a ring's corner to q starts strictly left of both its edges' bend."""
    left, right = _cross(before, corner, q) > 0, _cross(corner, after, q) > 0
    return (left and right) if _cross(before, corner, after) > 0 else (left or right)


def _enters(corner, q, a, b, c) -> bool:
    """Whether the way from a corner of the triangle to q starts strictly inside it."""
    ab, bc, ca = _cross(a, b, q) > 0, _cross(b, c, q) > 0, _cross(c, a, q) > 0
    return {a: ab and ca, b: ab and bc, c: bc and ca}[corner]


def triangulate(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles (indices into the concatenated rings) of a shell and its holes, by ear clipping.

    Raises if the areas differ, and for some polygons whose holes touch other rings in a point.
    """
    pts, loops, at = [tuple(p) for r in rings for p in np.asarray(r, float).tolist()], [], 0
    for r in rings:
        loops.append(list(range(at, at + len(r))))
        at += len(r)
    outer, holes = loops[0], sorted(loops[1:], key=lambda h: -max(pts[i][0] for i in h))
    edges = [(pts[a], pts[b]) for r in loops for a, b in zip(r, r[1:] + r[:1], strict=True)]
    for h in holes:
        pairs = sorted((math.dist(pts[i], pts[j]), a, b) for a, i in enumerate(h) for b, j in enumerate(outer) if pts[i] != pts[j])
        for _, a, b in pairs:
            m, p = pts[h[a]], pts[outer[b]]
            inside = _within(pts[outer[b - 1]], p, pts[outer[(b + 1) % len(outer)]], m) and _within(pts[h[a - 1]], m, pts[h[(a + 1) % len(h)]], p)
            if inside and not any(_blocks(m, p, *e) for e in edges):
                outer = outer[: b + 1] + h[a:] + h[: a + 1] + outer[b:]
                edges.append((m, p))
                break
        else:
            raise ValueError("a hole can't be joined to its shell")
    out, loop = [], outer
    while len(loop) > 3:
        n = len(loop)
        for flat in (False, True):  # a straight corner goes only where there is no other: its triangle keeps the edges matched
            ear = None
            for i in range(n):
                a, b, c = (pts[loop[k % n]] for k in (i - 1, i, i + 1))
                turn = _cross(a, b, c)
                if turn < 0 or (turn == 0) != flat:
                    continue
                sides = [(_cross(a, b, p), _cross(b, c, p), _cross(c, a, p)) for p in (pts[k] for k in loop) if p not in (a, b, c)]
                if not flat and any(min(s) >= 0 for s in sides):
                    continue
                # where another part of the boundary touches a corner, it may not enter the triangle there
                touching = [(pts[k], pts[loop[q % n]]) for j, k in enumerate(loop) if j not in ((i - 1) % n, i, (i + 1) % n) and pts[k] in (a, b, c) for q in (j - 1, j + 1)]
                if flat or not any(_enters(p, q, a, b, c) for p, q in touching):
                    ear = i
                    break
            if ear is not None:
                break
        if ear is None:
            raise ValueError(f"no ear among {[pts[k] for k in loop]}")
        if loop[ear - 1] == loop[(ear + 1) % n]:  # there and back along a bridge
            loop = [k for j, k in enumerate(loop) if j not in (ear, (ear + 1) % n)]
            continue
        out.append((loop[ear - 1], loop[ear], loop[(ear + 1) % n]))
        loop = loop[:ear] + loop[ear + 1 :]
    if len(loop) == 3:
        out.append(tuple(loop))
    area = sum(signed_area(r) for r in rings)
    found = sum(_cross(*(pts[i] for i in t)) / 2 for t in out)
    if abs(found - area) > 1e-6 * max(1.0, abs(area)):
        raise ValueError(f"the triangles cover {found}, the polygon {area}")
    return np.array(out, np.int64).reshape(-1, 3)


def polygons(rings) -> list[list[np.ndarray]]:
    """Rings as polygons: each shell (counter-clockwise) followed by the holes inside it."""
    shells = [[np.asarray(r, float)] for r in rings if signed_area(r) > 0]
    for h in (np.asarray(r, float) for r in rings if signed_area(r) < 0):
        mid = (h[0] + h[1]) / 2 + 1e-6 * np.array([h[1][1] - h[0][1], h[0][0] - h[1][0]]) * -1
        own = [s for s in shells if contains(s[0], *mid)]
        if own:
            min(own, key=lambda s: signed_area(s[0])).append(h)
    return shells


def prism(rings: list[np.ndarray], base: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and outward triangles of a polygon raised from base to top; raises unless it is a closed shell of the right volume."""
    flat = np.concatenate(rings)
    n, caps = len(flat), triangulate(rings)
    points = np.vstack([np.column_stack([flat, np.full(n, base)]), np.column_stack([flat, np.full(n, top)])])
    faces, at = [caps + n, caps[:, ::-1]], 0
    for r in rings:
        a = np.arange(at, at + len(r))
        b = np.roll(a, -1)
        faces += [np.column_stack([a, b, b + n]), np.column_stack([a, b + n, a + n])]
        at += len(r)
    faces = np.concatenate(faces)
    if not closed(faces):
        raise ValueError("the shell isn't closed")
    if abs(volume(points, faces) - sum(map(signed_area, rings)) * (top - base)) > 1e-6 * max(1.0, abs(volume(points, faces))):
        raise ValueError("the shell's volume differs from area times height")
    return points, faces


def closed(faces: np.ndarray) -> bool:
    """Whether each edge occurs exactly twice, once each way."""
    edges = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    forth, back = (np.unique(e, axis=0, return_counts=True) for e in (edges, edges[:, ::-1]))
    return bool((forth[1] == 1).all() and np.array_equal(forth[0], back[0]))


def volume(points: np.ndarray, faces: np.ndarray) -> float:
    a, b, c = (points[faces[:, i]] - points[0] for i in range(3))
    return float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)
