"""Seed colours and points of a panel: order-dependent searches over one panel's pixels."""

from __future__ import annotations

import math

import numpy as np

from strataframe.functions import kernels


def color_groups(rgb: np.ndarray, tolerance: float = 60.0, most: int = 15, samples: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Running means of like colours, largest first: a pixel joins the first group within the tolerance.

    Pixels are taken in raster order at an even step, so that the groups are the same everywhere.
    """
    flat = rgb.reshape(-1, 3).astype(float)
    flat = flat[:: max(1, -(-len(flat) // samples))]
    # A few groups of three channels: plain numbers are several times as fast as arrays here.
    means: list[tuple[float, float, float]] = []
    counts: list[int] = []
    for r, g, b in flat.tolist():
        for k, (mr, mg, mb) in enumerate(means):
            dr, dg, db = r - mr, g - mg, b - mb
            if math.sqrt(dr * dr + dg * dg + db * db) < tolerance:
                counts[k] += 1
                n = counts[k]
                means[k] = mr + dr / n, mg + dg / n, mb + db / n
                break
        else:
            means.append((r, g, b))
            counts.append(1)
            if len(means) > 2 * most:
                keep = sorted(np.argsort(-np.array(counts), kind="stable")[:most].tolist())
                means, counts = [means[k] for k in keep], [counts[k] for k in keep]
    order = np.argsort(-np.array(counts), kind="stable")[:most]
    return [(np.array(means[k]), counts[k]) for k in order]


def quantization(rgb: np.ndarray) -> float:
    """The share of pixels in the five largest colour groups."""
    groups = [n for _, n in color_groups(rgb)]
    return sum(groups[:5]) / max(1, sum(groups))


def find_pixel(rgb: np.ndarray, target: np.ndarray, background: np.ndarray, near: float = 35.0, far: float = 40.0) -> tuple[int, int] | None:
    """(x, y) of the middle of the largest part of the target's colour that isn't the background's."""
    d = np.sqrt(((rgb - target) ** 2).sum(2))
    b = np.sqrt(((rgb - background) ** 2).sum(2))
    comp, n = kernels.components((d < near) & (b > far), eight=True)
    if not n:
        return None
    y, x = np.nonzero(comp == np.bincount(comp.ravel())[1:].argmax() + 1)
    return int(x.mean()), int(y.mean())


def spiral(x: int, y: int, radius: int):
    """Places around a start on a square spiral: right, down, left, up, a step longer at every other turn."""
    yield x, y
    step, dx, dy = 1, 1, 0
    while step <= 2 * radius:
        for _ in range(2):
            for _ in range(step):
                x, y = x + dx, y + dy
                yield x, y
            dx, dy = -dy, dx
        step += 1


def disk(r: int) -> np.ndarray:
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return y * y + x * x <= r * r


def erode_disk(mask: np.ndarray, r: int) -> np.ndarray:
    """Pixels whose whole disk is in the mask; outside of the array counts as in it."""
    padded = np.pad(mask, r, constant_values=True)
    win = np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))
    return win[..., disk(r)].all(-1)


def shrunk(mask: np.ndarray) -> np.ndarray:
    """The mask eroded by the largest of the disks 5, 3 and 1 that leaves something, else as it is."""
    return next((e for r in (5, 3, 1) if (e := erode_disk(mask, r)).any()), mask)


def inner_point(mask: np.ndarray) -> tuple[int, int] | None:
    """(x, y) well inside of a mask: its shrunk form's mean, or median where the mean is outside."""
    m = shrunk(mask)
    if not m.any():
        return None
    y, x = np.nonzero(m)
    at = int(x.mean()), int(y.mean())
    return at if m[at[1], at[0]] else (int(np.median(x)), int(np.median(y)))


def refine(rgb: np.ndarray, points: list[tuple[int, int]], back: np.ndarray, rough: np.ndarray, spare: list[np.ndarray]) -> list[tuple[np.ndarray, int, int, str]]:
    """(colour, x, y, source) for each representative point, moved to where it surely stands for its layer.

    ``rough`` labels each pixel by the nearest of the points' colours. A point on the background goes to the first
    other pixel around it, within a third of the figure, or takes the spare colour farthest from the
    background, each once. Any other goes to the middle of its shrunk layer nearby, if that is within
    20 pixels. The distances are fixed values.
    """
    h, w, _ = rgb.shape
    on_back = lambda c: np.sqrt(((c - back) ** 2).sum()) < 60
    left, out = dict(enumerate(spare)), []
    for k, (x, y) in enumerate(points):
        x, y = max(0, min(w - 1, x)), max(0, min(h - 1, y))
        at, source, own = (x, y), "point", None
        if on_back(rgb[y, x]):
            if found := first_foreground(rgb, x, y, back, radius=min(h, w) // 3):
                at, source = found, "spiral"
            elif left:
                best = max(left, key=lambda i: float(((left[i] - back) ** 2).sum()))
                own, source = left.pop(best), "spare"
                if seen := find_pixel(rgb, own, back):
                    at, own = seen, None
            else:
                source = "failed"
        else:
            y0, x0 = max(0, y - 30), max(0, x - 30)
            near = rough[y0 : y + 31, x0 : x + 31] == k
            if near.any():
                py, px = np.nonzero(shrunk(near))
                mid = int(np.median(px)) + x0, int(np.median(py)) + y0
                if max(abs(mid[0] - x), abs(mid[1] - y)) <= 20:
                    at, source = mid, "inner"
            if on_back(rgb[at[1], at[0]]):
                if found := first_foreground(rgb, x, y, back, radius=20):
                    at, source = found, "spiral"
                elif whole := inner_point(rough == k):
                    at, source = whole, "layer"
        out.append((rgb[at[1], at[0]] if own is None else own, *at, source))
    return out


def first_foreground(rgb: np.ndarray, x: int, y: int, background: np.ndarray, threshold: float = 60.0, radius: int = 100) -> tuple[int, int] | None:
    h, w, _ = rgb.shape
    for px, py in spiral(x, y, radius):
        if 0 <= px < w and 0 <= py < h and max(abs(px - x), abs(py - y)) <= radius and np.sqrt(((rgb[py, px] - background) ** 2).sum()) >= threshold:
            return px, py
    return None
