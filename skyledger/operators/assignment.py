"""One-to-one assignment and pairwise costs of boxes, as NumPy helpers for operators that run once per group."""

from __future__ import annotations

from math import sqrt

import numpy as np

#: Columns up to which an assignment is made in plain numbers, and pairs of boxes up to which costs are.
FEW, FEW_PAIRS = 48, 1000


def assign(cost: np.ndarray | list[list[float]], most: float = 0.8) -> list[tuple[int, int, float]]:
    """(row, column, cost) of the assignment with the least total cost, cheapest first; pairs above `most` are left out after the fact. By shortest augmenting paths with potentials, a column scan per step."""
    if not isinstance(cost, list):
        cost = np.asarray(cost, float).tolist()
    if not cost or not cost[0]:
        return []
    turned = len(cost) > len(cost[0])
    c = list(zip(*cost)) if turned else cost
    holders = _holders(np.array(c)).tolist() if len(c[0]) > FEW else _few_holders(c)
    pairs = [(k, r) if turned else (r, k) for k, r in enumerate(holders) if r >= 0]
    found = sorted([(cost[r][k], r, k) for r, k in pairs if cost[r][k] <= most])
    return [(r, k, x) for x, r, k in found]


def _holders(c: np.ndarray) -> np.ndarray:
    """The row that each column goes to, or -1."""
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for row in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, here, reach = -1, row, 0.0
        while True:
            step = c[here] - row_price[here] - column_price + reach
            closer = ~done & (step < least)
            least[closer], via[closer] = step[closer], at
            at = int(np.where(done, np.inf, least).argmin())
            reach = least[at]
            if holder[at] < 0:
                break
            done[at], here = True, holder[at]
        # prices change by how much earlier than the end each column was reached
        row_price[row] += reach
        row_price[holder[done]] += reach - least[done]
        column_price[done] -= reach - least[done]
        while at >= 0:
            before = via[at]
            holder[at] = row if before < 0 else holder[before]
            at = before
    return holder


def _few_holders(c: list[list[float]]) -> list[int]:
    """_holders in plain numbers, for a frame's few boxes, where an array's call costs more than its work. While no column has a price, a row goes to its cheapest column if that is free, without a scan."""
    n, m = len(c), len(c[0])
    row_price, column_price, holder, inf, priced = [0.0] * n, [0.0] * m, [-1] * m, float("inf"), False
    for row in range(n):
        if not priced and (cheapest := min(c[row])) == cheapest and holder[at := c[row].index(cheapest)] < 0:
            holder[at], row_price[row] = row, cheapest
            continue
        least, via, done = [inf] * m, [-1] * m, []
        open_, at, here, reach = list(range(m)), -1, row, 0.0
        while True:
            line, price, nearest, best = c[here], row_price[here], open_[0], inf
            for k in open_:
                step = line[k] - price - column_price[k] + reach
                if step < least[k]:
                    least[k], via[k] = step, at
                if least[k] < best:
                    nearest, best = k, least[k]
            at, reach = nearest, least[nearest]
            if holder[at] < 0:
                break
            open_.remove(at)
            done.append(at)
            here = holder[at]
        row_price[row] += reach
        priced = priced or bool(done)
        for k in done:
            row_price[holder[k]] += reach - least[k]
            column_price[k] -= reach - least[k]
        while at >= 0:
            before = via[at]
            holder[at] = row if before < 0 else holder[before]
            at = before
    return holder


def assign_batch(n: np.ndarray, left: np.ndarray, m: np.ndarray, right: np.ndarray, most: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Assignments of many frames at once, of boxes by overlap: n and m are the frames' numbers of boxes, left and right their boxes end to end. Gives positions in left and right, and costs of 1 - overlap up to `most`.

    What doesn't overlap costs 1 however it is paired, so only overlapping pairs can lower a total, and
    a pair that overlaps nothing else is taken as it stands. Only boxes that compete with others are
    assigned frame by frame.
    """
    frame_l, frame_r = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    first = np.cumsum(m) - m
    wide = m[frame_l]
    i = np.repeat(np.arange(len(left)), wide)
    j = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first[frame_l], wide)
    side = np.clip(np.minimum(left[i, 2:], right[j, 2:]) - np.maximum(left[i, :2], right[j, :2]), 0, None)
    both = side[:, 0] * side[:, 1]
    hit = both > 0
    i, j, both = i[hit], j[hit], both[hit]
    area = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    union = area(left)[i] + area(right)[j] - both
    cost = 1 - np.where(union > 1e-9, both / np.maximum(union, 1e-9), 0.0)
    alone = (np.bincount(i, minlength=len(left))[i] == 1) & (np.bincount(j, minlength=len(right))[j] == 1)
    keep = [np.flatnonzero(alone)]
    rest = np.flatnonzero(~alone)
    frames = frame_l[i[rest]]
    for f in np.unique(frames):
        at = rest[frames == f]
        rows, columns = np.unique(i[at]), np.unique(j[at])
        grid, place = np.ones((len(rows), len(columns))), {}
        for k, r, c in zip(at, np.searchsorted(rows, i[at]), np.searchsorted(columns, j[at]), strict=True):
            grid[r, c] = cost[k]
            place[r, c] = k
        keep.append(np.array([place[r, c] for r, c, _ in assign(grid, most) if (r, c) in place], np.int64))
    found = np.concatenate(keep)
    found = found[cost[found] <= most]
    return i[found], j[found], cost[found]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x1, y1, x2, y2), one row per box of a; 0 where the union is empty."""
    a, b = np.asarray(a, float).reshape(-1, 1, 4), np.asarray(b, float).reshape(1, -1, 4)
    side = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0)
    both = side[..., 0] * side[..., 1]
    own, other = np.maximum(a[..., 2:] - a[..., :2], 0), np.maximum(b[..., 2:] - b[..., :2], 0)
    union = own[..., 0] * own[..., 1] + other[..., 0] * other[..., 1] - both
    return np.where(union > 1e-9, both / np.maximum(union, 1e-9), 0.0)


def costs(a: list, b: list) -> list[list[float]]:
    """1 - overlaps() as lists, in plain numbers where boxes are few."""
    if len(a) * len(b) > FEW_PAIRS:
        return (1 - overlaps(a, b)).tolist()
    out = []
    for x1, y1, x2, y2 in a:
        line = [1.0] * len(b)
        for k, (a1, b1, a2, b2) in enumerate(b):
            # most pairs are told apart here
            if a1 < x2 and x1 < a2 and b1 < y2 and y1 < b2:
                w, h = (x2 if x2 < a2 else a2) - (x1 if x1 > a1 else a1), (y2 if y2 < b2 else b2) - (y1 if y1 > b1 else b1)
                if w > 0 and h > 0:
                    both = w * h
                    union = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - both
                    if union > 1e-9:
                        line[k] = 1 - both / union
        out.append(line)
    return out


def unit(v) -> np.ndarray | None:
    """A vector of length 1 in its direction; none of none."""
    if v is None:
        return None
    v = np.asarray(v, float)
    return v / max(sqrt(v.dot(v)), 1e-6)


def cosines(a: list, b: list) -> np.ndarray:
    """Cosine of each two vectors; 1 where either is missing, as nothing then speaks against them."""
    return unit_cosines([unit(v) for v in a], [unit(v) for v in b])


def unit_cosines(a: list, b: list) -> np.ndarray:
    """cosines() of vectors of length 1."""
    out = np.ones((len(a), len(b)))
    left, right = [(i, v) for i, v in enumerate(a) if v is not None], [(j, v) for j, v in enumerate(b) if v is not None]
    if left and right:
        grid = np.array([v for _, v in left]) @ np.array([v for _, v in right]).T
        if grid.shape == out.shape:
            return grid
        out[np.ix_([i for i, _ in left], [j for j, _ in right])] = grid
    return out


def fused(motion: np.ndarray, appearance: np.ndarray | None, share: float = 0.25) -> np.ndarray:
    """Motion cost with a share of appearance cost; motion alone without appearance."""
    if appearance is None:
        return motion
    share = min(1.0, max(0.0, share))
    return (1 - share) * motion + share * appearance


def carried(boxes: np.ndarray, transform: np.ndarray | None) -> np.ndarray:
    """Boxes under a 3 x 3 homography, by their first and third corner; what falls on the horizon is 0."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    if transform is None or not len(boxes):
        return boxes
    points = np.concatenate([boxes.reshape(-1, 2), np.ones((2 * len(boxes), 1))], axis=1) @ np.asarray(transform, float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = points[:, :2] / points[:, 2:]
    return np.where(np.isfinite(flat), flat, 0.0).reshape(-1, 4)
