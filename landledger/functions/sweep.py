"""Overlap areas of general polygons, the one step no column expression covers.

The plane is cut into horizontal slabs at every vertex and every crossing, so
inside a slab no two edges change order. The covered length is then linear in y
and the length at the slab's middle times its height is the exact covered area.
Spark partitions and shuffles the pairs; a call sees the pieces of one field.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

ARC_STEPS = 32
CROSSING_BLOCK = 1024
#: Pairs of edges that are crossed at once. A row with more edges than the root of this is swept alone.
PAIR_BLOCK = 1 << 20
#: Pairs of shapes that are tested for touching at once, each of at most PAIR_BLOCK / TOUCH_ROWS pairs of edges.
TOUCH_ROWS = 1024


def _as_edges(flat) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, 4)


def _meets(box: tuple, piece: np.ndarray) -> bool:
    xs, ys = piece[:, [0, 2]], piece[:, [1, 3]]
    return xs.min() <= box[2] and xs.max() >= box[0] and ys.min() <= box[3] and ys.max() >= box[1]


def _closed(points: np.ndarray) -> np.ndarray:
    return np.hstack([points, np.roll(points, -1, axis=0)])


def cushion(piece: np.ndarray, gap: float) -> list[np.ndarray]:
    """The piece widened by ``gap``: itself, a strip along each edge, a disc at each vertex."""
    if gap <= 0:
        return [piece]
    turn = 2 * np.pi * np.arange(ARC_STEPS) / ARC_STEPS
    circle = gap * np.column_stack([np.cos(turn), np.sin(turn)])
    out = [piece]
    for x1, y1, x2, y2 in piece:
        out.append(_closed(np.array([x1, y1]) + circle))
        length = np.hypot(x2 - x1, y2 - y1)
        if length > 0:
            nx, ny = gap * (y1 - y2) / length, gap * (x2 - x1) / length
            out.append(_closed(np.array(
                [[x1 + nx, y1 + ny], [x2 + nx, y2 + ny], [x2 - nx, y2 - ny], [x1 - nx, y1 - ny]])))
    return out


def _crossing_heights(e: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = e.T
    dx, dy = x2 - x1, y2 - y1
    found = []
    for start in range(0, len(e), CROSSING_BLOCK):
        s = slice(start, start + CROSSING_BLOCK)
        det = dx[s, None] * dy[None, :] - dy[s, None] * dx[None, :]
        ox, oy = x1[None, :] - x1[s, None], y1[None, :] - y1[s, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ox * dy[None, :] - oy * dx[None, :]) / det
            u = (ox * dy[s, None] - oy * dx[s, None]) / det
            hit = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            found.append((y1[s, None] + t * dy[s, None])[hit])
    return np.concatenate(found) if found else np.empty(0)


def cover(field: np.ndarray, pieces: list[np.ndarray], as_region: bool = False):
    """Area of field ∩ (union of pieces), or that region as the edges of disjoint trapezoids."""
    origin = field[0, :2].copy()
    shift = np.tile(origin, 2)
    field = field - shift
    box = (field[:, [0, 2]].min(), field[:, [1, 3]].min(), field[:, [0, 2]].max(), field[:, [1, 3]].max())
    near = [p - shift for p in pieces if len(p)]
    near = [p for p in near if _meets(box, p)]
    empty = np.empty((0, 4))
    if not near:
        return empty if as_region else 0.0
    e = np.vstack([field, *near])
    owner = np.repeat(np.arange(len(near) + 1), [len(field), *map(len, near)])
    rising = (e[:, 1] != e[:, 3]) & (np.minimum(e[:, 1], e[:, 3]) < box[3]) & (np.maximum(e[:, 1], e[:, 3]) > box[1])
    e, owner = e[rising], owner[rising]
    heights = np.concatenate([e[:, 1], e[:, 3], _crossing_heights(e), [box[1], box[3]]])
    ys = np.unique(heights[(heights >= box[1]) & (heights <= box[3])])
    if len(ys) < 2:
        return empty if as_region else 0.0

    first = np.searchsorted(ys, np.maximum(np.minimum(e[:, 1], e[:, 3]), box[1]))
    last = np.searchsorted(ys, np.minimum(np.maximum(e[:, 1], e[:, 3]), box[3]))
    spans = last - first
    idx = np.repeat(np.arange(len(e)), spans)
    slab = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + first[idx]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    middle = (ys[slab] + ys[slab + 1]) / 2
    x = e[idx, 0] + (middle - e[idx, 1]) * slope[idx]
    own = owner[idx]

    # Each owner's crossings alternate in and out from left to right.
    order = np.lexsort((x, own, slab))
    group = np.r_[True, (np.diff(slab[order]) != 0) | (np.diff(own[order]) != 0)]
    position = np.arange(len(order)) - np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
    sign = np.empty(len(order), dtype=int)
    sign[order] = np.where(position % 2 == 0, 1, -1)

    order = np.lexsort((x, slab))
    idx, slab, x, own, sign = idx[order], slab[order], x[order], own[order], sign[order]
    in_field = np.cumsum(np.where(own == 0, sign, 0)) > 0
    in_piece = np.cumsum(np.where(own > 0, sign, 0)) > 0
    both = in_field & in_piece
    if not as_region:
        keep = both[:-1] & (slab[1:] == slab[:-1])
        return float(((x[1:] - x[:-1]) * (ys[slab[:-1] + 1] - ys[slab[:-1]]))[keep].sum())

    opens = both & ~np.r_[False, both[:-1]]
    closes = ~both & np.r_[False, both[:-1]]
    left, right = idx[opens], idx[closes]
    low, high = ys[slab[opens]], ys[slab[opens] + 1]

    def at(edge, y):
        return e[edge, 0] + (y - e[edge, 1]) * slope[edge]

    a, b, c, d = at(left, low), at(right, low), at(right, high), at(left, high)
    sides = [np.column_stack(s) for s in ((a, low, b, low), (b, low, c, high), (c, high, d, high), (d, high, a, low))]
    return np.stack(sides, axis=1).reshape(-1, 4) + shift


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _crossings_within(e: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights at which two edges of one group cross, and the group of each. Edges lie by group."""
    sizes = np.bincount(group, minlength=n_groups)
    later = sizes[group] - _ramp(sizes) - 1
    i = np.repeat(np.arange(len(e)), later)
    j = i + 1 + _ramp(later)
    x1, y1 = e[:, 0], e[:, 1]
    dx, dy = e[:, 2] - x1, e[:, 3] - y1
    apart = (np.minimum(e[i, 1], e[i, 3]) >= np.maximum(e[j, 1], e[j, 3])) | (np.minimum(e[j, 1], e[j, 3]) >= np.maximum(e[i, 1], e[i, 3]))
    i, j = i[~apart], j[~apart]
    det = dx[i] * dy[j] - dy[i] * dx[j]
    crossed = det != 0
    i, j, det = i[crossed], j[crossed], det[crossed]
    ox, oy = x1[j] - x1[i], y1[j] - y1[i]
    t, u = (ox * dy[j] - oy * dx[j]) / det, (ox * dy[i] - oy * dx[i]) / det
    hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return (y1[i] + t * dy[i])[hit], group[i[hit]]


def _areas(e: np.ndarray, owner: np.ndarray, group: np.ndarray, box: np.ndarray) -> np.ndarray:
    """For each group the area of its owner 0 inside the union of its other owners: the sweep of ``cover``, all groups at
    once. Edges lie by group; ``box`` holds the bounds of each group's owner 0."""
    groups = np.arange(len(box))
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    rising = (low < high) & (low < box[group, 3]) & (high > box[group, 1])
    e, owner, group = e[rising], owner[rising], group[rising]
    low, high = np.maximum(low[rising], box[group, 1]), np.minimum(high[rising], box[group, 3])
    crossing, crossing_of = _crossings_within(e, group, len(box))
    y = np.concatenate([low, high, crossing, box[:, 1], box[:, 3]])
    of = np.concatenate([group, group, crossing_of, groups, groups])
    inside = (y >= box[of, 1]) & (y <= box[of, 3])
    y, of = y[inside], of[inside]
    # one number for each (group, height), in their order
    distinct, rank = np.unique(y, return_inverse=True)
    keys, place = np.unique(of * len(distinct) + rank, return_inverse=True)
    ys, group_of = distinct[keys % len(distinct)], keys // len(distinct)
    first, last = place[: len(e)], place[len(e) : 2 * len(e)]  # the ends of edges come first and are all inside

    spans = last - first
    idx = np.repeat(np.arange(len(e)), spans)
    slab = _ramp(spans) + first[idx]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    x = e[idx, 0] + ((ys[slab] + ys[slab + 1]) / 2 - e[idx, 1]) * slope[idx]
    own = owner[idx]

    order = np.lexsort((x, own, slab))
    begins = np.r_[True, (np.diff(slab[order]) != 0) | (np.diff(own[order]) != 0)][: len(order)]
    position = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    sign = np.empty(len(order), dtype=int)
    sign[order] = np.where(position % 2 == 0, 1, -1)

    order = np.lexsort((x, slab))
    slab, x, own, sign = slab[order], x[order], own[order], sign[order]
    sizes = np.bincount(group_of[slab], minlength=len(box))
    start = (np.cumsum(sizes) - sizes)[sizes > 0]

    def depth(steps: np.ndarray) -> np.ndarray:
        """Running sum of each group's own steps."""
        total = np.cumsum(steps)
        return total - np.repeat(total[start] - steps[start], sizes[sizes > 0])

    both = (depth(np.where(own == 0, sign, 0)) > 0) & (depth(np.where(own > 0, sign, 0)) > 0)
    keep = np.flatnonzero(both[:-1] & (slab[1:] == slab[:-1]))
    at = slab[keep]
    return np.bincount(group_of[at], (x[keep + 1] - x[keep]) * (ys[at + 1] - ys[at]), len(box))


def _slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The edges of the named slices end to end; starts and sizes count edges."""
    return values.reshape(-1, 4)[np.repeat(starts, sizes) + _ramp(sizes)]


def cover_many(field: tuple, piece: tuple, pieces_from: np.ndarray, pieces_to: np.ndarray) -> np.ndarray:
    """Area of each field inside the union of its pieces.

    ``field`` and ``piece`` are (flat edge lists end to end, where each begins, how many edges it has), counted in edges; the
    pieces of a field are those from ``pieces_from`` to ``pieces_to``. Fields are swept together as long as their pairs of
    edges are at most PAIR_BLOCK.
    """
    f_values, f_starts, f_sizes = field
    p_values, p_starts, p_sizes = piece
    before = np.concatenate([[0], np.cumsum(p_sizes)])
    edges = f_sizes + before[pieces_to] - before[pieces_from]
    cost = np.cumsum(edges.astype(np.int64) ** 2)
    out = np.zeros(len(f_sizes))
    begin = 0
    while begin < len(out):
        done = cost[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(cost, done + PAIR_BLOCK, "right")))
        rows = np.arange(begin, end)
        begin = end
        if len(rows) == 1 and edges[rows[0]] ** 2 > PAIR_BLOCK:
            k = rows[0]
            near = [_slices(p_values, p_starts[j : j + 1], p_sizes[j : j + 1]) for j in range(pieces_from[k], pieces_to[k])]
            out[k] = cover(_slices(f_values, f_starts[rows], f_sizes[rows]), near)
            continue
        rows = rows[f_sizes[rows] > 0]
        if not len(rows):
            continue
        own = _slices(f_values, f_starts[rows], f_sizes[rows])
        at = np.cumsum(f_sizes[rows]) - f_sizes[rows]
        origin = np.tile(own[at, :2], 2)
        own_group = np.repeat(np.arange(len(rows)), f_sizes[rows])
        own = own - origin[own_group]
        box = np.column_stack([*(np.minimum.reduceat(own[:, [c, c + 2]].min(axis=1), at) for c in (0, 1)),
                               *(np.maximum.reduceat(own[:, [c, c + 2]].max(axis=1), at) for c in (0, 1))])
        many = pieces_to[rows] - pieces_from[rows]
        which, of = np.repeat(pieces_from[rows], many) + _ramp(many), np.repeat(np.arange(len(rows)), many)
        which, of = which[p_sizes[which] > 0], of[p_sizes[which] > 0]
        if not len(which):
            continue
        other = _slices(p_values, p_starts[which], p_sizes[which]) - origin[np.repeat(of, p_sizes[which])]
        at = np.cumsum(p_sizes[which]) - p_sizes[which]
        xs, ys = other[:, [0, 2]], other[:, [1, 3]]
        meets = (
            (np.minimum.reduceat(xs.min(axis=1), at) <= box[of, 2]) & (np.maximum.reduceat(xs.max(axis=1), at) >= box[of, 0])
            & (np.minimum.reduceat(ys.min(axis=1), at) <= box[of, 3]) & (np.maximum.reduceat(ys.max(axis=1), at) >= box[of, 1])
        )
        near = np.repeat(meets, p_sizes[which])
        owner = np.repeat(np.arange(1, len(which) + 1), p_sizes[which])[near]  # distinct among all groups
        group = np.concatenate([own_group, np.repeat(of, p_sizes[which])[near]])
        order = np.argsort(group, kind="stable")
        e, owner = np.vstack([own, other[near]])[order], np.concatenate([np.zeros(len(own), int), owner])[order]
        out[rows] = _areas(e, owner, group[order], box)
    return out


def _within(e: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Edges whose box meets the given one."""
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    return e[((lo <= box[2:]) & (hi >= box[:2])).all(axis=1)]


def touches(a: np.ndarray, b: np.ndarray) -> bool:
    """Closed shapes share at least a point. Edges outside the common box cannot; the rest meet a block at a time."""
    shift = np.tile(a[0, :2], 2)
    a, b = a - shift, b - shift
    corners = [(np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)) for e in (a, b)]
    common = np.concatenate([np.maximum(corners[0][0], corners[1][0]), np.minimum(corners[0][1], corners[1][1])])
    if (common[:2] > common[2:]).any():
        return False
    near_a, near_b = _within(a, common), _within(b, common)
    for start in range(0, len(near_a), CROSSING_BLOCK):
        if _cross(near_a[start : start + CROSSING_BLOCK], near_b):
            return True
    return _holds(b, a[0, 0], a[0, 1]) or _holds(a, b[0, 0], b[0, 1])


def _edges_cross(a: tuple, b: tuple) -> np.ndarray:
    """Whether edges share a point, by their x1, y1, x2 and y2."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    d1, d2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    d3, d4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    overlap = (
        (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx))
        & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
    )
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & overlap


def _cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Some edge of a shares a point with some edge of b."""
    return bool(_edges_cross(tuple(v[:, None] for v in a.T), tuple(v[None, :] for v in b.T)).any())


def _rays(e: np.ndarray, x, y) -> np.ndarray:
    """Edges that a ray from the point to the right meets."""
    x1, y1, x2, y2 = e.T
    turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    return ((y1 > y) != (y2 > y)) & ((turn > 0) == (y2 > y1))


def _holds(e: np.ndarray, x: float, y: float) -> bool:
    return bool(_rays(e, x, y).sum() % 2)


def touches_many(left: tuple, right: tuple, rows: np.ndarray) -> np.ndarray:
    """``touches`` of the named rows of two columns, each given as in ``cover_many``, all at once; shapes are not empty."""
    n = len(rows)
    sides = [(_slices(v, starts[rows], sizes[rows]), np.repeat(np.arange(n), sizes[rows]), sizes[rows]) for v, starts, sizes in (left, right)]
    begins = [np.cumsum(sizes) - sizes for _, _, sizes in sides]
    origin = np.tile(sides[0][0][begins[0], :2], 2)
    edges = [e - origin[of] for e, of, _ in sides]
    low = [np.minimum.reduceat(np.minimum(e[:, :2], e[:, 2:]), at, axis=0) for e, at in zip(edges, begins)]
    high = [np.maximum.reduceat(np.maximum(e[:, :2], e[:, 2:]), at, axis=0) for e, at in zip(edges, begins)]
    common = np.hstack([np.maximum(*low), np.minimum(*high)])
    met = (common[:, :2] <= common[:, 2:]).all(axis=1)

    near = []
    for e, (_, of, _) in zip(edges, sides):
        box = common[of]
        meets = (np.minimum(e[:, :2], e[:, 2:]) <= box[:, 2:]) & (np.maximum(e[:, :2], e[:, 2:]) >= box[:, :2])
        keep = met[of] & meets.all(axis=1)
        near.append((e[keep], of[keep], np.bincount(of[keep], minlength=n)))
    (a, a_of, _), (b, _, b_sizes) = near
    partners = b_sizes[a_of]
    i = np.repeat(np.arange(len(a)), partners)
    j = np.repeat((np.cumsum(b_sizes) - b_sizes)[a_of], partners) + _ramp(partners)
    out = np.zeros(n, dtype=bool)
    out[a_of[i[_edges_cross(a[i].T, b[j].T)]]] = True
    for own, other in ((1, 0), (0, 1)):  # the first point of one lies inside the other
        e, of, at = edges[own], sides[own][1], begins[other]
        x, y = edges[other][at, 0][of], edges[other][at, 1][of]
        out |= met & (np.bincount(of[_rays(e, x, y)], minlength=n) % 2 == 1)
    return out


def _rows(column: pa.Array):
    """Numpy views of the rows of a list<double> column, None where null."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list<double> column of edges, where each row begins and how many edges it has, none where null."""
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1] // 4, np.where(valid, np.diff(offsets) // 4, 0)


@F.arrow_udf(DoubleType())
def overlap_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Area shared by two polygons, 0 where they only touch, null where they are apart."""
    a, b = _lists(left), _lists(right)
    rows = np.arange(len(left))
    size = cover_many(a, b, rows, rows + 1)
    there = (a[2] > 0) & (b[2] > 0)
    left_out = np.flatnonzero(there & ~(size > 0))
    cost = a[2][left_out].astype(np.int64) * b[2][left_out]
    small = left_out[cost <= PAIR_BLOCK // TOUCH_ROWS]
    for at in range(0, len(small), TOUCH_ROWS):
        rows = small[at : at + TOUCH_ROWS]
        there[rows] = touches_many(a, b, rows)
    for k in left_out[cost > PAIR_BLOCK // TOUCH_ROWS]:
        there[k] = touches(*(_slices(values, starts[k : k + 1], sizes[k : k + 1]) for values, starts, sizes in (a, b)))
    return pa.array(size, type=pa.float64(), mask=~there)


# Keeps the optimizer from running the kernel once for a filter and again for the column.
overlap_area = overlap_area.asNondeterministic()


def union_area(gap: float):
    """Arrow UDF: area of a field inside the union of its (widened) pieces."""

    @F.arrow_udf(DoubleType())
    def covered(field: pa.Array, pieces: pa.Array) -> pa.Array:
        if gap <= 0:
            bounds = pieces.offsets.to_numpy()
            return pa.array(cover_many(_lists(field), _lists(pieces.values), bounds[:-1], bounds[1:]), type=pa.float64())
        out = []
        for f, many in zip(_rows(field), pieces):
            parts = [q for p in _rows(many.values) for q in cushion(_as_edges(p), gap)]
            out.append(cover(_as_edges(f), parts))
        return pa.array(out, type=pa.float64())

    return covered.asNondeterministic()


def union_region(gap: float):
    """Arrow UDF: the same region as one edge list, so chunks of pieces can be merged again."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def region(field: pa.Array, pieces: pa.Array) -> pa.Array:
        out = []
        for f, many in zip(_rows(field), pieces):
            parts = [q for p in _rows(many.values) for q in cushion(_as_edges(p), gap)]
            out.append(cover(_as_edges(f), parts, as_region=True).ravel())
        return pa.array(out, type=pa.list_(pa.float64()))

    return region.asNondeterministic()
