"""Smooth curves through the boundary of two layers: small numeric kernels over one series each."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from strataframe.functions import kernels

#: Fixed value: how far a residual may be from its target, relative to it.
TOLERANCE = 1e-3


def hampel(y: np.ndarray, window: int = 21, sigmas: float = 3.0) -> np.ndarray:
    """Values far from their window's median become it; a series shorter than a window stays as it is."""
    n, half = len(y), window // 2
    if n < window:
        return y.astype(float)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(y.astype(float), half, constant_values=np.nan), 2 * half + 1)
    median = np.nanmedian(near, axis=1)
    spread = np.nanmedian(np.abs(near - median[:, None]), axis=1)
    return np.where(np.abs(y - median) > sigmas * 1.4826 * spread, median, y)


def savgol(y: np.ndarray, smoothness: float) -> np.ndarray:
    """Local cubic smoothing: a window of that share of the series, made odd, borders mirrored."""
    n = len(y)
    window = min(max(5, int(smoothness * n)) | 1, n - 1 if n % 2 == 0 else n - 2)
    return kernels.savgol(y.astype(float), window, min(3, window - 2)) if window >= 5 else y.astype(float)


def filled(y: np.ndarray) -> np.ndarray:
    """Gaps (NaN) on straight lines between their ends."""
    known = ~np.isnan(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(known), y[known]) if known.any() and not known.all() else y.astype(float)


def multiscale_savgol(y: np.ndarray, smoothness: float = 0.15) -> np.ndarray:
    """A fine and a coarse smoothing, the finer where they differ most: edges stay, flats are smooth."""
    if len(y) < 5:
        return y.astype(float)
    whole = filled(y)
    fine, coarse = savgol(whole, smoothness * 0.5), savgol(whole, smoothness * 1.5)
    apart = np.abs(fine - coarse)
    weight = np.clip(apart / (apart.max() + 1e-6), 0.0, 1.0)
    return weight * fine + (1.0 - weight) * coarse


# ---- peaks


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Places above both sides; of a flat top its middle, the left one of two. Ends are none."""
    edge = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    last = np.r_[edge[1:], len(y)] - 1
    level = y[edge]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (edge[top] + last[top]) // 2


def spaced(places: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Of the places those that stay when, from the highest, each removes what is nearer than ``distance``."""
    keep = np.ones(len(places), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(places - places[k]) < distance
            near[k] = False
            keep[near] = False
    return places[keep]


def prominences(y: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How far each place stands above the higher of the lowest points on its way to higher ground, or to the end, either side.

    One pass each way with a stack of falling values: what a value takes off the stack is its
    own ground, whose lowest point is carried along.
    """

    def lowest(v: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(v)), []
        for k, x in enumerate(v.tolist()):
            low = x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            out[k] = low
            stack.append((x, low))
        return out

    left, right = lowest(y), lowest(y[::-1])[::-1]
    return (y - np.maximum(left, right))[places]


def knots(y: np.ndarray, prominence: float = 5.0, distance: int = 30) -> np.ndarray:
    """The series' ends and its highs and lows of that prominence, ``distance`` apart among highs and among lows."""
    y = np.where(np.isnan(y), np.nanmedian(y), y)
    found = {0, len(y) - 1}
    for v in (y, -y):
        at = local_maxima(v)
        at = spaced(at, v[at], distance)
        found.update(at[prominences(v, at) >= prominence].tolist())
    return np.array(sorted(found))


# ---- splines


def basis(x: np.ndarray, segments: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(first coefficient, values): the degree + 1 B-splines of even knots over [x0, xn] that aren't zero at each x."""
    at = (x - x[0]) / (x[-1] - x[0]) * segments
    cell = np.minimum(np.floor(at).astype(int), segments - 1)
    t = at - cell
    out = np.ones((len(x), 1))
    for d in range(1, degree + 1):
        # Each spline is two of one degree less, weighted by where x lies between their knots.
        k = np.arange(d)
        up = (t[:, None] + (d - 1 - k)) / d
        wider = np.zeros((len(x), d + 1))
        wider[:, 1:] += out * up
        wider[:, :-1] += out * (1 - up)
        out = wider
    return cell, out


def banded_solve(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems: band[d, i] is the matrix's (i, i + d), with last axes of independent systems, as those of ``right``."""
    q, n = band.shape[0] - 1, band.shape[1]
    kind = np.broadcast_shapes(band.shape[2:], right.shape[1:])
    # Both sides of the diagonal, q lines below it and q lines after the last, so that what an elimination
    # changes is one block of views: element (r, c) is whole[q + c - r, r].
    whole = np.zeros((2 * q + 1, n + q, *kind))
    whole[q:, :n] = band
    x = np.zeros((n + q, *kind))
    x[:n] = right
    line, step = whole.strides[:2]
    for i in range(n):
        ahead = whole[q + 1 :, i]
        down = ahead / whole[q, i]
        block = np.lib.stride_tricks.as_strided(whole[q:, i + 1], (q, q, *kind), (step - line, line, *whole.strides[2:]))
        block -= down[:, None] * ahead
        x[i + 1 : i + 1 + q] -= down * x[i]
    for i in range(n - 1, -1, -1):
        m = min(q, n - 1 - i)
        x[i] = (x[i] - (whole[q + 1 : q + 1 + m, i] * x[i + 1 : i + 1 + m]).sum(0)) / whole[q, i]
    return x[:n]


class PenalisedSpline:
    """B-splines with a knot a point, penalised by the differences of order (degree + 1) / 2 of their coefficients."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, degree: int):
        self.y, self.w2, self.degree = y, weight**2, degree
        segments = len(x) - 1
        self.cell, self.values = basis(x, segments, degree)
        n = segments + degree
        self.fit_band = np.zeros((degree + 1, n))
        self.right = np.zeros(n)
        for a in range(degree + 1):
            np.add.at(self.right, self.cell + a, self.w2 * self.values[:, a] * y)
            for b in range(a, degree + 1):
                np.add.at(self.fit_band[b - a], self.cell + a, self.w2 * self.values[:, a] * self.values[:, b])
        order = (degree + 1) // 2
        step = np.diff(np.eye(order + 1), order, axis=0)[0]
        self.smooth_band = np.zeros_like(self.fit_band)
        for a in range(order + 1):
            for b in range(a, order + 1):
                self.smooth_band[b - a, a : a + n - order] += step[a] * step[b]

    def fits(self, strength: np.ndarray) -> np.ndarray:
        """Fitted values, a column for each strength of the penalty."""
        return fits([self], strength[None])[0]

    def residual(self, fit: np.ndarray) -> np.ndarray:
        return (self.w2[:, None] * (self.y[:, None] - fit) ** 2).sum(0)


def fits(splines: list[PenalisedSpline], strength: np.ndarray) -> list[np.ndarray]:
    """Each spline's fitted values, a column for each of its row of strengths; solved together, so they have as many points and one degree."""
    fit_band = np.stack([s.fit_band for s in splines], -1)
    band = fit_band[..., None] + splines[0].smooth_band[..., None, None] * strength
    band[0] += 1e-12 * fit_band[0].max(0)[:, None]
    c = banded_solve(band, np.stack([s.right for s in splines], -1)[..., None])
    return [sum(c[s.cell + a, k] * s.values[:, a, None] for a in range(s.degree + 1)) for k, s in enumerate(splines)]


class Problem(NamedTuple):
    """Points (x rising, no two equal) to smooth, their weights, the residual's target, and each place of the series among them."""

    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    target: float
    degree: int = 3
    at: np.ndarray | slice = slice(None)


def smoothing_splines(problems: list[Problem]) -> list[np.ndarray]:
    """Of each problem the smoothest spline whose weighted squared residuals sum to its target, at its x.

    Where a polynomial of that degree stays below the target, it is the answer. Else the penalty's
    strength is found on a logarithmic grid that closes in, all of a round solved at once, also for all problems of
    as many points, in time and memory that grow with the points.
    """
    out: list[np.ndarray] = []
    todo: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(problems):
        t = 2 * (p.x - p.x[0]) / (p.x[-1] - p.x[0]) - 1
        out.append(np.polynomial.chebyshev.Chebyshev.fit(t, p.y, min(p.degree, len(p.x) - 1), w=p.weight)(t))
        if (p.weight**2 * (p.y - out[k]) ** 2).sum() > p.target and len(p.x) > p.degree + 1:
            todo.setdefault((len(p.x), p.degree), []).append(k)
    for own in todo.values():
        splines = {k: PenalisedSpline(*problems[k][:3], problems[k].degree) for k in own}
        ends = {k: (-6.0, 14.0) for k in own}
        for _ in range(7):
            grid = np.array([np.linspace(*ends[k], 9) for k in ends])
            for k, at, fit in zip(list(ends), grid, fits([splines[k] for k in ends], 10.0**grid), strict=True):
                off, target = splines[k].residual(fit), problems[k].target
                best = np.abs(off - target).argmin()
                out[k] = fit[:, best]
                if abs(off[best] - target) <= TOLERANCE * target:
                    del ends[k]
                    continue
                cell = int(np.clip(np.searchsorted(off, target), 1, 8))
                ends[k] = at[cell - 1], at[cell]
            if not ends:
                break
    return out


def smoothing_spline(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, target: float = 0.0, degree: int = 3) -> np.ndarray:
    """One series' smoothing spline, see ``smoothing_splines``."""
    return smoothing_splines([Problem(x.astype(float), y.astype(float), np.ones(len(x)) if weight is None else weight.astype(float), target, degree)])[0]


def quintic(y: np.ndarray, smoothness: float = 0.5) -> np.ndarray | Problem:
    """Fifth-degree spline, smooth in its curvature's change; gaps are filled first. Fewer than ten values stay."""
    if (~np.isnan(y)).sum() < 10:
        return y.astype(float)
    return Problem(np.arange(len(y), dtype=float), hampel(filled(y)), np.ones(len(y)), smoothness * 1e6, 5)


def bspline(x: np.ndarray, y: np.ndarray, smoothness: float) -> np.ndarray | Problem:
    """Cubic smoothing spline; of equal x the first counts."""
    target = max(smoothness * len(y) * float(np.var(y)) * 0.01, len(y) * 0.1)
    ux, first = np.unique(x, return_index=True)
    if len(ux) < 4:
        return y.astype(float)
    return Problem(ux.astype(float), y[first].astype(float), np.ones(len(ux)), target, at=np.searchsorted(ux, x))


def knot_constrained(x: np.ndarray, y: np.ndarray, prominence: float = 5.0, distance: int = 30, smoothness: float = 0.15) -> np.ndarray | Problem:
    """Cubic smoothing spline held near the series' knots: what is a fold stays, saw-teeth between go.

    Weights, fixed values: 8 at a knot, 3 within 15 places of one, 0.3 elsewhere, then mean 1.
    """
    if len(x) < 10:
        return y.astype(float)
    at = knots(y, prominence, distance)
    near = np.abs(np.arange(len(x))[:, None] - at).min(1)
    weight = np.where(near == 0, 8.0, np.where(near <= 15, 3.0, 0.3))
    clean = hampel(y)
    return Problem(x.astype(float), clean.astype(float), weight / weight.mean(), smoothness * len(x) * float(np.var(clean)) * 0.5)


# ---- local regression


def tricube(u: np.ndarray) -> np.ndarray:
    return np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0)


def loess(x: np.ndarray, y: np.ndarray, smoothness: float, rounds: int = 3) -> np.ndarray:
    """Local straight lines through the nearest points, weighted by distance; then by how far off each point was.

    The share of points is a tenth of the smoothness, between 2 and 50 %. The robust weights of a round are
    bisquares of residuals over six times their median.
    """
    n = len(x)
    share = max(0.02, min(0.5, smoothness * 0.1))
    return local_lines(x.astype(float), y.astype(float), min(n, max(2, int(share * n + 1e-10))), rounds)


def local_lines(x: np.ndarray, y: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """x rises. Of two points as far, the left one is nearer."""
    n = len(x)
    left = np.zeros(n, int)
    at = 0
    for i in range(n):
        while at + k < n and x[i] > (x[at] + x[at + k]) / 2:
            at += 1
        left[i] = at
    near = left[:, None] + np.arange(k)
    dx = x[near] - x[:, None]
    radius = np.abs(dx).max(1, keepdims=True)
    shape = tricube(np.abs(dx) / np.where(radius > 0, radius, 1))
    trust = np.ones(n)
    for r in range(rounds + 1):
        w = shape * trust[near]
        total = w.sum(1)
        safe = np.where(total > 0, total, 1)
        mx, my = (w * dx).sum(1) / safe, (w * y[near]).sum(1) / safe
        sxx = (w * (dx - mx[:, None]) ** 2).sum(1)
        sxy = (w * (dx - mx[:, None]) * (y[near] - my[:, None])).sum(1)
        flat = sxx <= 1e-12 * np.maximum(radius[:, 0] ** 2, 1e-300)
        fit = np.where(total > 0, my - np.where(flat, 0.0, sxy / np.where(flat, 1, sxx)) * mx, y)
        if r == rounds:
            break
        off = np.abs(y - fit)
        scale = 6 * np.median(off)
        if scale <= 1e-12:
            break
        trust = np.where(off < scale, (1 - np.minimum(off / scale, 1) ** 2) ** 2, 0.0)
    return fit


METHODS = ("savgol", "bspline", "loess", "quintic", "knot_constrained")


def fit(x: np.ndarray, y: np.ndarray, method: str = "savgol", smoothness: float = 1.0) -> np.ndarray:
    """A smooth curve through a boundary's points by one of METHODS; outliers go first, and fewer than five points stay."""
    return fit_all([(x, y)], method, smoothness)[0]


def fit_all(series: list[tuple[np.ndarray, np.ndarray]], method: str = "savgol", smoothness: float = 1.0) -> list[np.ndarray]:
    """``fit`` of several boundaries, whose splines are solved together."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    made = [curve_or_problem(x, y, method, smoothness) for x, y in series]
    solved = iter(smoothing_splines([p for p in made if isinstance(p, Problem)]))
    return [next(solved)[m.at] if isinstance(m, Problem) else m for m in made]


def curve_or_problem(x: np.ndarray, y: np.ndarray, method: str, smoothness: float) -> np.ndarray | Problem:
    if method == "quintic":
        return quintic(y, smoothness)
    if len(x) < 5:
        return y.astype(float)
    clean = hampel(y)
    if method == "savgol":
        return savgol(clean, smoothness)
    if method == "knot_constrained":
        return knot_constrained(x, clean, smoothness=smoothness)
    return (bspline if method == "bspline" else loess)(x, clean, smoothness)
