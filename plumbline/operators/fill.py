"""Click to fill: the white area around a click in a grey drawing, as a polygon (NumPy only)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.geodesy import RING
from .outline import without_spikes

INK, MOST, NUDGE = 150, 0.6, 15


def _disk(size: int) -> np.ndarray:
    r = (size - 1) / 2
    y, x = np.ogrid[:size, :size]
    return ((x - r) ** 2 + (y - r) ** 2) <= (r + 0.25) ** 2


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    if size <= 1:
        return mask
    out, k, pad = np.zeros_like(mask), _disk(size), size // 2
    wide = np.pad(mask, pad)
    for dy, dx in zip(*np.nonzero(k)):
        out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def flood(free: np.ndarray, x: int, y: int) -> np.ndarray:
    """4-connected area, run by run."""
    h, w = free.shape
    seen, todo = np.zeros_like(free), deque([(y, x)])
    while todo:
        y, x = todo.popleft()
        if seen[y, x] or not free[y, x]:
            continue
        row = free[y] & ~seen[y]
        left = x - int(np.argmin(row[x::-1])) + 1 if not row[: x + 1].all() else 0
        right = x + int(np.argmin(row[x:])) if not row[x:].all() else w
        seen[y, left:right] = True
        for ny in (y - 1, y + 1):
            if 0 <= ny < h:
                ok = free[ny, left:right] & ~seen[ny, left:right]
                for s in np.flatnonzero(ok & ~np.r_[False, ok[:-1]]):
                    todo.append((ny, left + int(s)))
    return seen


def outline(mask: np.ndarray) -> np.ndarray:
    """Outer boundary of the largest 4-connected part, corner by corner along pixel edges."""
    left, best = mask.copy(), None
    while left.any():
        y, x = (int(v[0]) for v in np.nonzero(left))
        part = flood(left, x, y)
        left &= ~part
        if best is None or part.sum() > best.sum():
            best = part
    wide = np.pad(best, 1)
    y, x = (int(v[0]) for v in np.nonzero(wide))
    at, step, out, start = (x, y), (1, 0), [], (x, y)
    # walk with the filled side on the right
    while True:
        out.append((at[0] - 1, at[1] - 1))
        dx, dy = step
        ahead = {(1, 0): ((0, -1), (0, 0)), (0, 1): ((0, 0), (-1, 0)), (-1, 0): ((-1, 0), (-1, -1)), (0, -1): ((-1, -1), (0, -1))}[step]
        (lx, ly), (rx, ry) = ahead
        l, r = wide[at[1] + ly, at[0] + lx], wide[at[1] + ry, at[0] + rx]
        if l:
            step = (dy, -dx)
        elif not r:
            step = (-dy, dx)
        at = (at[0] + step[0], at[1] + step[1])
        if at == start:
            return np.array(out, float)


def reduce_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed outline, cut at its two farthest points."""
    far = int(np.hypot(*(p - p[0]).T).argmax())
    closed = np.vstack([p, p[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, far, len(p)]] = True
    todo = [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = closed[b] - closed[a]
        n = np.hypot(*d) or 1.0
        off = np.abs(d[0] * (closed[a + 1 : b, 1] - closed[a, 1]) - d[1] * (closed[a + 1 : b, 0] - closed[a, 0])) / n
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[:-1][keep[:-1]]


def _seed(free: np.ndarray, x: int, y: int) -> tuple[int, int] | None:
    """The free pixel nearest to a click, at most ``NUDGE`` away on either axis."""
    rows, columns = np.ogrid[: free.shape[0], : free.shape[1]]
    apart = np.where(free & (np.abs(rows - y) <= NUDGE) & (np.abs(columns - x) <= NUDGE), (rows - y) ** 2 + (columns - x) ** 2, np.inf)
    at = np.unravel_index(int(apart.argmin()), free.shape)
    return (int(at[1]), int(at[0])) if np.isfinite(apart[at]) else None


def fill_region(grey: np.ndarray, x: float, y: float, gap: int = 5) -> tuple[np.ndarray | None, float, str | None]:
    """(vertices, fraction, error) of the area around a click; small breaks in lines up to ``gap`` are bridged.

    Spikes go from the simplified outline; one of under three corners is an error.
    """
    click = round(x), round(y)
    if not (0 <= click[0] < grey.shape[1] and 0 <= click[1] < grey.shape[0]):
        return None, 0.0, "outside"
    bridge = int(np.clip(gap, 0, 25))
    free = ~dilate(grey < INK, bridge)
    if (seed := _seed(free, *click)) is None:
        return None, 0.0, "on a line"
    grown = dilate(flood(free, *seed), bridge)
    opened = dilate(~dilate(~grown, 9), 9)  # what is narrower than 9 px is no part of a parcel
    area = dilate(opened, 5)
    fraction = float(area.mean())
    if fraction > MOST:
        return None, round(fraction, 4), "leaked"
    if not area.any():
        return None, 0.0, "nothing"
    edge = outline(area)
    p = reduce_points(edge, 0.006 * float(np.hypot(*(np.roll(edge, -1, axis=0) - edge).T).sum()))
    p = without_spikes(p, SPIKE_DEG)
    return (p, round(fraction, 4), None) if len(p) >= 3 else (None, round(fraction, 4), "fewer than three corners")


SPIKE_DEG = 25.0


@F.pandas_udf(StructType([StructField("vertices", RING), StructField("fraction", DoubleType()), StructField("error", StringType())]))
def fill_clicks(pixels: pd.Series, width: pd.Series, x: pd.Series, y: pd.Series, gap: pd.Series) -> pd.DataFrame:
    """fill_region for rows of 8-bit grey pixels (binary, row by row), click and gap."""
    rows = []
    for data, w, a, b, g in zip(pixels, width, x, y, gap):
        v, fraction, error = fill_region(np.frombuffer(data, np.uint8).reshape(-1, int(w)), a, b, g)
        rows.append((None if v is None else [{"x": float(p[0]), "y": float(p[1])} for p in v], fraction, error))
    return pd.DataFrame(rows, columns=["vertices", "fraction", "error"])
