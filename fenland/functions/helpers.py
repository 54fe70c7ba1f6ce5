"""The numpy helpers that run on one tile or one grid row at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

TILE = 256


def tile_components(r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """For each cell of a tile the position of its component's first cell; the cells are distinct."""
    height, width = int(r.max() - r.min()) + 3, int(c.max() - c.min()) + 3
    y, x = r - r.min() + 1, c - c.min() + 1
    label = np.full((height, width), -1, np.int64)
    order = np.lexsort((c, r))
    rank = np.empty(len(r), np.int64)
    rank[order] = np.arange(len(r))
    label[y, x] = rank
    steps = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1)] if eight else [])
    while True:
        # The least label of a cell and its neighbours, then a jump to that label's own label.
        now = label[y, x]
        best = now.copy()
        for dy, dx in steps + [(-a, -b) for a, b in steps]:
            near = label[y + dy, x + dx]
            best = np.where(near >= 0, np.minimum(best, near), best)
        by_rank = np.empty_like(best)
        by_rank[rank] = best
        best = by_rank[by_rank[best]]
        if (best == now).all():
            return order[best]
        label[y, x] = best


def row_envelope(c: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """min over j of g2[j] + (c - c[j])**2 for each cell of a grid row; g2 is inf where the column has no feature."""
    known = np.flatnonzero(np.isfinite(g2))
    if not len(known):
        return np.full(len(c), np.inf)
    base, pos = g2[known], c[known].astype(float)
    hull, bound = [0], [-np.inf]
    for q in range(1, len(known)):
        while True:
            p = hull[-1]
            cross = ((base[q] + pos[q] ** 2) - (base[p] + pos[p] ** 2)) / (2 * (pos[q] - pos[p]))
            if cross > bound[-1]:
                break
            hull.pop()
            bound.pop()
            if not hull:
                cross = -np.inf
                break
        hull.append(q)
        bound.append(cross)
    at = np.asarray(hull)[np.searchsorted(np.asarray(bound), c.astype(float), "right") - 1]
    return base[at] + (c - pos[at]) ** 2


def thin_block(block: np.ndarray, passes: int) -> np.ndarray:
    """passes sub-iterations (two make one iteration) of the parallel thinning of Zhang and Suen; the frame counts as empty."""
    img = np.pad(block.astype(bool), 1)
    for i in range(passes):
        n = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
        count = sum(x.astype(np.int8) for x in n)
        turns = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
        north, east, south, west = n[0], n[2], n[4], n[6]
        if i % 2:
            first, second = north & east & west, north & south & west
        else:
            first, second = north & east & south, east & south & west
        gone = img[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & ~first & ~second
        img[1:-1, 1:-1] &= ~gone
    return img[1:-1, 1:-1]


def thin_tile(frame: pd.DataFrame, tile: int, halo: int, passes: int) -> pd.DataFrame:
    """Cells (r, c) of a tile and its halo -> the cells of the tile that passes sub-iterations leave, and a row without a cell if
    the tile has changed."""
    tr, tc = int(frame["tr"].iloc[0]), int(frame["tc"].iloc[0])
    top, left = tr * tile - halo, tc * tile - halo
    block = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
    block[frame["r"] - top, frame["c"] - left] = True
    core = slice(halo, halo + tile)
    before, after = block[core, core], thin_block(block, passes)[core, core]
    y, x = np.nonzero(after)
    r, c = [*(y + top + halo).tolist()], [*(x + left + halo).tolist()]
    if before.sum() != len(y):
        r, c = [None, *r], [None, *c]
    return pd.DataFrame({"site_id": frame["site_id"].iloc[0], "r": pd.array(r, "Int64"), "c": pd.array(c, "Int64"), "tr": tr, "tc": tc})


def relax_tile(frame: pd.DataFrame, tile: int, hops: bool) -> pd.DataFrame:
    """Cells (r, c, d) of a tile and its one-cell frame -> the tile's cells with their least distances over paths inside
    both, and whether they have changed."""
    tr, tc = int(frame["tr"].iloc[0]), int(frame["tc"].iloc[0])
    top, left = tr * tile - 1, tc * tile - 1
    d, on = np.full((tile + 2, tile + 2), np.inf), np.zeros((tile + 2, tile + 2), bool)
    y, x = frame["r"].to_numpy() - top, frame["c"].to_numpy() - left
    d[y, x], on[y, x] = frame["d"].fillna(np.inf), True
    steps = [(dy, dx, 1.0 if hops or not (dy and dx) else 2**0.5) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    inner = on[1:-1, 1:-1]
    before = d[1:-1, 1:-1].copy()
    while True:
        best = d[1:-1, 1:-1].copy()
        for dy, dx, w in steps:
            np.minimum(best, d[1 + dy : tile + 1 + dy, 1 + dx : tile + 1 + dx] + w, out=best)
        best[~inner] = np.inf
        if (best == d[1:-1, 1:-1]).all():
            break
        d[1:-1, 1:-1] = best
    y, x = np.nonzero(inner)
    v = pd.Series(best[y, x])
    return pd.DataFrame({"site_id": frame["site_id"].iloc[0], "r": y + top + 1, "c": x + left + 1, "d": v.where(np.isfinite(v), None).astype("float64"), "changed": (best != before)[y, x]})


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of integer points (n x 2), around it; of points in a line the two ends."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def side(of: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for x, y in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    return np.array(side(p.tolist()) + side(p[::-1].tolist()), np.int64)


def widest(corners: np.ndarray) -> int:
    """The largest squared distance of two corners of a hull, by calipers turned around it."""
    n, k, most = len(corners), 1, 0
    c = corners.tolist()
    far = lambda i, j: (c[i][0] - c[j][0]) ** 2 + (c[i][1] - c[j][1]) ** 2
    if n < 3:
        return far(0, n - 1)
    turn = lambda i, j, m: (c[j][0] - c[i][0]) * (c[m][1] - c[i][1]) - (c[j][1] - c[i][1]) * (c[m][0] - c[i][0])
    for i in range(n):
        j = (i + 1) % n
        while turn(i, j, (k + 1) % n) > turn(i, j, k):
            k = (k + 1) % n
            most = max(most, far(i, k))
        most = max(most, far(i, k), far(j, k), far(i, (k + 1) % n), far(j, (k + 1) % n))
    return most
