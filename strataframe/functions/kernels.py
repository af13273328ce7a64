"""NumPy kernels over one panel's arrays, for neighbourhood algorithms that aren't relational."""

from __future__ import annotations

import functools
import heapq

import numpy as np


def joined(n: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, int]:
    """The group of each of ``n`` nodes under links, numbered from 0 by its first node, and how many there are.

    The smallest index spreads over links until nothing changes, with pointer jumping between.
    """
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[two], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    heads, which = np.unique(root, return_inverse=True)
    return which, len(heads)


def components(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Connected components of a mask, numbered from 1 in raster order of their first pixel: runs of rows, linked to those below."""
    first = mask.copy()
    first[:, 1:] &= ~mask[:, :-1]
    run = np.cumsum(first).reshape(mask.shape) - 1
    one, two = [], []
    for dx in (-1, 0, 1) if eight else (0,):
        a, b = (slice(0, -1), slice(max(0, -dx), mask.shape[1] - max(0, dx))), (slice(1, None), slice(max(0, dx), mask.shape[1] + min(0, dx)))
        both = mask[a] & mask[b]
        both[:, 1:] &= ~both[:, :-1]  # two runs that meet in several pixels are linked once
        one.append(run[a][both])
        two.append(run[b][both])
    which, n = joined(int(first.sum()), np.concatenate(one), np.concatenate(two))
    out = np.zeros(mask.shape, np.int64)
    out[mask] = which[run[mask]] + 1
    return out, n


def regions(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, pixels) of the connected regions of equal labels: all labels at once, sides connect."""
    first = np.ones(grid.shape, bool)
    first[:, 1:] = grid[:, 1:] != grid[:, :-1]
    run = np.cumsum(first).reshape(grid.shape) - 1
    both = grid[:-1] == grid[1:]
    both[:, 1:] &= first[:-1, 1:] | first[1:, 1:]
    start = np.flatnonzero(first)
    which, n = joined(len(start), run[:-1][both], run[1:][both])
    label = np.empty(n, grid.dtype)
    label[which] = grid.ravel()[start]
    return label, np.bincount(which, np.diff(np.r_[start, grid.size]), n).astype(int)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with the parts of its background that don't reach the border."""
    back, _ = components(~mask)
    rim = np.unique(np.concatenate([back[0], back[-1], back[:, 0], back[:, -1]]))
    return mask | ((back > 0) & ~np.isin(back, rim))


def dilate(mask: np.ndarray, rounds: int = 1, square: bool = False) -> np.ndarray:
    out = mask.copy()
    for _ in range(rounds):
        p = np.pad(out, 1)
        cross = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        out = cross | p[:-2, :-2] | p[:-2, 2:] | p[2:, :-2] | p[2:, 2:] if square else cross
    return out


def erode(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    out = mask.copy()
    for _ in range(rounds):
        p = np.pad(out, 1, constant_values=False)
        out = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return out


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="symmetric"), (size, size))


def median_filter(a: np.ndarray, size: int = 5) -> np.ndarray:
    """The median of a square around each pixel, borders mirrored."""
    return np.median(_windows(a, size), axis=(2, 3)).astype(a.dtype)


def gaussian(a: np.ndarray, sigma: float, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Separable, cut at four sigmas, borders mirrored."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in axes if axes is not None else range(a.ndim):
        pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
        out = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(out, pad, mode="symmetric"))
    return out


def sobel(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(float), 1, mode="edge")
    dy = p[:-2] - p[2:]
    dx = p[:, :-2] - p[:, 2:]
    v = (dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]) / 4
    u = (dx[:-2] + 2 * dx[1:-1] + dx[2:]) / 4
    return np.sqrt((u * u + v * v) / 2)


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.05, high: float = 0.15) -> np.ndarray:
    """Edges: thinned gradient maxima above ``low`` that are joined to one above ``high``."""
    s = gaussian(a, sigma)
    gy, gx = np.gradient(s)
    m = np.hypot(gy, gx)
    angle = (np.round(np.arctan2(gy, gx) / (np.pi / 4)) % 4).astype(int)
    p = np.pad(m, 1)
    h, w = m.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ahead = np.choose(angle, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(angle, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    thin = (m >= ahead) & (m >= behind) & (m > low)
    comp, n = components(thin, eight=True)
    strong = np.bincount(comp[thin & (m > high)], minlength=n + 1) > 0
    return thin & strong[comp]


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one of the mask: exact, column then row."""
    h, w = mask.shape
    far = h + w
    col = np.where(mask, 0, far)
    for y in range(1, h):
        col[y] = np.minimum(col[y], col[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        col[y] = np.minimum(col[y], col[y + 1] + 1)
    x = np.arange(w)
    gap = (x[:, None] - x[None, :]) ** 2
    return np.sqrt(np.min(gap[None] + (col.astype(float) ** 2)[:, None, :], axis=2))


def grow(cost: np.ndarray, seeds: list[tuple[int, int]], penalty: np.ndarray) -> np.ndarray:
    """Cheapest paths from several seeds: a step costs its pixel's distance to the seed's colour and its penalty.

    ``cost`` is (seed, row, column).
    """
    _, h, w = cost.shape
    best = np.full((h, w), np.inf)
    out = np.full((h, w), -1)
    heap = []
    for k, (y, x) in enumerate(seeds):
        best[y, x] = 0
        out[y, x] = k
        heap.append((0.0, k, y, x))
    heapq.heapify(heap)
    while heap:
        d, k, y, x = heapq.heappop(heap)
        if d > best[y, x] or out[y, x] != k:
            continue
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < h and 0 <= nx < w:
                nd = d + cost[k, ny, nx] + penalty[ny, nx] + 1e-6
                if nd < best[ny, nx]:
                    best[ny, nx], out[ny, nx] = nd, k
                    heapq.heappush(heap, (nd, k, ny, nx))
    return out


def watershed(elevation: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Flooding from markers in order of height, then of arrival."""
    h, w = elevation.shape
    out = markers.copy()
    heap = [(float(elevation[y, x]), i, int(y), int(x)) for i, (y, x) in enumerate(zip(*np.nonzero(markers), strict=True))]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < h and 0 <= nx < w and not out[ny, nx]:
                out[ny, nx] = out[y, x]
                heapq.heappush(heap, (float(elevation[ny, nx]), count, ny, nx))
                count += 1
    return out


def superpixels(rgb: np.ndarray, area: int = 100, compactness: float = 5.0, rounds: int = 5) -> np.ndarray:
    """Clusters of colour and place around a regular grid of centres; each pixel looks at near centres alone."""
    h, w, _ = rgb.shape
    step = max(2, int(area**0.5))
    cy, cx = (g.ravel().astype(float) for g in np.meshgrid(np.arange(step // 2, h, step), np.arange(step // 2, w, step), indexing="ij"))
    cc = rgb[cy.astype(int), cx.astype(int)].astype(float)
    yy, xx = np.mgrid[:h, :w]
    out = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k in range(len(cy)):
            y0, y1, x0, x1 = max(0, int(cy[k]) - step), min(h, int(cy[k]) + step + 1), max(0, int(cx[k]) - step), min(w, int(cx[k]) + step + 1)
            box = (slice(y0, y1), slice(x0, x1))
            d = ((rgb[box] - cc[k]) ** 2).sum(2) + (compactness / step) ** 2 * ((yy[box] - cy[k]) ** 2 + (xx[box] - cx[k]) ** 2)
            near = d < best[box]
            best[box][near] = d[near]
            out[box][near] = k
        n = np.maximum(1, np.bincount(out.ravel(), minlength=len(cy)))
        cy, cx = np.bincount(out.ravel(), yy.ravel(), len(cy)) / n, np.bincount(out.ravel(), xx.ravel(), len(cx)) / n
        cc = np.stack([np.bincount(out.ravel(), rgb[..., c].ravel(), len(cy)) / n for c in range(3)], 1)
    return out


def relax(data: np.ndarray, pairs: np.ndarray, means: np.ndarray, sigma: float = 25.0, weight: float = 5.0, sweeps: int = 50) -> np.ndarray:
    """Iterated conditional modes over a region graph: regions in order take their cheapest label until none changes."""
    label = data.argmin(1)
    near: list[list[tuple[int, float]]] = [[] for _ in range(len(data))]
    for a, b in pairs:
        cost = weight * float(np.exp(-((means[a] - means[b]) ** 2).sum() / (2 * sigma**2)))
        near[a].append((b, cost))
        near[b].append((a, cost))
    for _ in range(sweeps):
        changed = False
        for i in range(len(data)):
            total = data[i].astype(float).copy()
            for j, cost in near[i]:
                total += cost
                total[label[j]] -= cost
            k = int(total.argmin())
            changed |= k != label[i]
            label[i] = k
        if not changed:
            break
    return label


def perimeter(mask: np.ndarray) -> float:
    """The length of a mask's border, by how each border pixel goes on: straight sides 1, diagonal ones the root of 2."""
    core = erode(mask)
    # Outside of the array is no part of the mask.
    core[[0, -1], :] = core[:, [0, -1]] = False
    rim = np.pad((mask & ~core).astype(int), 1)
    sides = rim[:-2, 1:-1] + rim[2:, 1:-1] + rim[1:-1, :-2] + rim[1:-1, 2:]
    corners = rim[:-2, :-2] + rim[:-2, 2:] + rim[2:, :-2] + rim[2:, 2:]
    code = (rim[1:-1, 1:-1] + 2 * sides + 10 * corners)[mask & ~core]
    # What a border pixel with a neighbourhood of each code adds.
    root = float(np.sqrt(2))
    weights = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: root, 33: root, 13: (1 + root) / 2, 23: (1 + root) / 2}
    return float(sum(weights.get(int(c), 0.0) * n for c, n in zip(*np.unique(code, return_counts=True), strict=True)))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: points farther than ``tolerance`` from the line between kept ones stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*line)
        d = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / size if size else np.hypot(rest[:, 0], rest[:, 1])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def outline(mask: np.ndarray) -> list[np.ndarray]:
    """Closed rings of pixel edges around each part and hole of a mask, as (x, y) corners."""
    p = np.pad(mask, 1)
    nexts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(p), strict=True):
        for inside, a, b in ((p[y - 1, x], (x, y), (x + 1, y)), (p[y, x + 1], (x + 1, y), (x + 1, y + 1)), (p[y + 1, x], (x + 1, y + 1), (x, y + 1)), (p[y, x - 1], (x, y + 1), (x, y))):
            if not inside:
                nexts.setdefault((int(a[0]), int(a[1])), []).append((int(b[0]), int(b[1])))
    rings = []
    while nexts:
        start = min(nexts)
        ring, at = [start], start
        while True:
            after = nexts[at].pop()
            if not nexts[at]:
                del nexts[at]
            ring.append(after)
            at = after
            if at == start:
                break
        rings.append(np.array(ring) - 1)
    return rings


@functools.lru_cache(64)
def savgol_row(half: int, degree: int) -> np.ndarray:
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0]


def savgol(y: np.ndarray, window: int, degree: int = 3) -> np.ndarray:
    """Local polynomial smoothing, borders mirrored."""
    half = window // 2
    row = savgol_row(half, degree)
    padded = np.concatenate([y[1 : half + 1][::-1], y, y[-half - 1 : -1][::-1]])
    return np.convolve(padded, row[::-1], "valid")


def peaks(y: np.ndarray, distance: int = 1, least: float = -np.inf) -> np.ndarray:
    """Local maxima of at least a height, the higher first where two are too near."""
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] >= least)) + 1
    kept: list[int] = []
    for i in at[np.argsort(-y[at], kind="stable")]:
        if all(abs(i - j) >= distance for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)
