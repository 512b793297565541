"""Shape of masks of any size, from their runs alone: components, outer border, edges, moments.

A batch of masks is one set of arrays: runs sorted by (mask, row, x), so that a search in sorted places
finds the runs of the next row that touch. Work and memory follow the number of runs; no raster is made.

The border of a component goes from pixel centre to pixel centre. It is a sum over the corners
where four pixels meet, so nothing is traced: where two fours agree beside each other it moves one along an axis, and at each
pixel outside that has both its neighbours inside it moves along the diagonal. Moves that border the
outside make the outer border; those around holes don't count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most fragments that still score.
MAX_FRAGMENTS = 5
_COLUMNS = {"perimeter": "double", "compactness": "double", "n_components": "integer", "fragmentation": "double", "edge": "double"}


class _Rows:
    """Disjoint runs [start, end) on one line: place = (row + 1 + mask * height) * span + x + 2, with rows and masks apart from each other."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end

    def at(self, place: np.ndarray) -> np.ndarray:
        """Number of the run at each place; -1 where none is."""
        if not len(self.start):
            return np.full(len(place), -1)
        k = np.searchsorted(self.start, place, "right") - 1
        return np.where((k >= 0) & (place < self.end[k]), k, -1)

    def components(self, span: int, reach: int) -> np.ndarray:
        """Least number of each run's component; runs of neighbouring rows touch if less than ``reach`` apart."""
        first = np.searchsorted(self.end, self.start + span - reach, "right")
        last = np.searchsorted(self.start, self.end + span + reach, "left")
        n = np.maximum(last - first, 0)
        a = np.repeat(np.arange(len(n)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        root = np.arange(len(n))
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root under a smaller one
            while (up := root[root]) is not None and (up != root).any():
                root = up
        return root


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs without empty ones, joined where they meet."""
    keep = end > start
    order = np.argsort(start[keep], kind="stable")
    start, end = start[keep][order], end[keep][order]
    if not len(start):
        return start, end
    end = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def measure(heights: np.ndarray, widths: np.ndarray, mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> dict[str, np.ndarray]:
    """Shape of each mask of a batch: runs (mask, y, x0, x1) by number of the mask. Runs may come in any order, touch or overlap; what is outside the frame is cut."""
    n = len(heights)
    tall, span = int(heights.max(initial=0)) + 3, int(widths.max(initial=0)) + 4
    inside = (y >= 0) & (y < heights[mask])
    mask, y, x0, x1 = mask[inside], y[inside], np.maximum(x0[inside], 0), np.minimum(x1[inside], widths[mask[inside]])
    row = (mask * tall + y + 1) * span + 2
    own = _Rows(*_merged(row + x0, row + x1))
    of = own.start // span // tall  # the mask of each run
    area = np.bincount(of, own.end - own.start, n)

    root = own.components(span, 1)
    heads = root == np.arange(len(root))
    pieces = np.bincount(of[heads], minlength=n)

    every = np.repeat(np.arange(n), heights + 2)
    lines = np.arange(len(every)) - np.repeat(np.cumsum(heights + 2) - (heights + 2), heights + 2) + every * tall
    gaps = _Rows(np.sort(np.concatenate([lines * span + 1, own.end])), np.sort(np.concatenate([lines * span + widths[every] + 3, own.start])))
    region = gaps.components(span, 0)
    outside = region[gaps.at(np.arange(n) * tall * span + 1)] if n else region[:0]

    corners = np.unique(np.concatenate([own.start, own.end, own.start + span, own.end + span]))
    below, above = corners, corners - span  # the pixels right of the corner in the lower and the upper row
    x, line = corners % span - 2, corners // span % tall - 1
    moves: list[tuple[np.ndarray, ...]] = []  # (run inside, gap outside, axial, diagonal, cross product)

    def move(fore, back, where, length, diagonal, cross):
        k = np.flatnonzero(where)
        moves.append((fore[k], back[k], np.broadcast_to(length, where.shape)[k], np.broadcast_to(diagonal, where.shape)[k], cross[k]))

    places = {"a": above - 1, "b": above, "c": below - 1, "d": below}
    run = {k: own.at(v) for k, v in places.items()}
    gap = {k: gaps.at(v) for k, v in places.items()}
    at = {"a": (x - 1, line - 1), "b": (x, line - 1), "c": (x - 1, line), "d": (x, line)}
    cross = lambda p, q: at[p][0] * at[q][1] - at[q][0] * at[p][1]
    for p, q, out, other in (("a", "c", "b", "d"), ("d", "b", "c", "a")):  # down the right side, up the left side
        move(run[p], gap[out], (run[p] >= 0) & (run[q] >= 0) & (gap[out] >= 0) & (gap[other] >= 0), 1, 0, cross(p, q))
    for p, q, out in (("a", "d", "b"), ("c", "b", "a"), ("d", "a", "c"), ("b", "c", "d")):  # past a pixel outside between two inside
        move(run[p], gap[out], (run[p] >= 0) & (run[q] >= 0) & (gap[out] >= 0), 0, 1, cross(p, q))
    if len(corners):  # along the rows, from one corner to the next
        length = np.concatenate([np.where(corners[1:] // span == corners[:-1] // span, corners[1:] - corners[:-1] - 1, 0), [0]])
        move(run["d"], gap["b"], (run["d"] >= 0) & (gap["b"] >= 0) & (length > 0), length, 0, -line * length)
        move(run["b"], gap["d"], (run["b"] >= 0) & (gap["d"] >= 0) & (length > 0), length, 0, (line - 1) * length)
    fore, back, axial, diagonal, turned = (np.concatenate(c) for c in zip(*moves, strict=True)) if moves else ([],) * 5
    outer = region[back] == outside[of[fore]] if len(fore) else np.zeros(0, bool)
    key = root[fore[outer]] if len(fore) else np.zeros(0, int)
    sums = [np.bincount(key, v[outer], len(root)) for v in (axial, diagonal, turned)]
    length, enclosed = sums[0] + math.sqrt(2) * sums[1], np.abs(sums[2]) / 2
    perimeter = np.zeros(n)
    found = np.flatnonzero(heads)
    order = found[np.lexsort((length[found], enclosed[found], of[found]))]
    perimeter[of[order]] = length[order]  # of each mask the last: the greatest area, of equal ones the longest
    with np.errstate(divide="ignore", invalid="ignore"):
        compact = np.where(perimeter > 0, np.minimum(1.0, 4 * np.pi * area / perimeter**2), 0.0)
    return {
        "perimeter": perimeter, "compactness": compact, "n_components": pieces.astype(np.int32),
        "fragmentation": np.where(pieces > MAX_FRAGMENTS, 0.0, 1.0 / np.maximum(1, pieces)), "edge": _edges(own, of, heights, widths, tall, span, n),
    }


def _edges(own: _Rows, of: np.ndarray, heights: np.ndarray, widths: np.ndarray, tall: int, span: int, n: int) -> np.ndarray:
    """1 where any 3 x 3 Sobel response of a mask isn't zero, with the border mirrored; else 0. A response that isn't zero has one beside the end of a run."""
    sharp = np.zeros(n)

    def respond(k):
        ends = np.concatenate([own.start[k], own.end[k]])
        m = np.concatenate([of[k], of[k]])
        x, y = ends % span - 2, ends // span % tall - 1
        for dx in (-1, 0):
            for dy in (-1, 0, 1):
                px, py = x + dx, y + dy
                ok = (px >= 0) & (px < widths[m]) & (py >= 0) & (py < heights[m])
                value = {}
                for j in (-1, 0, 1):
                    for i in (-1, 0, 1):
                        qx, qy = np.abs(px[ok] + i), np.abs(py[ok] + j)
                        qx, qy = np.minimum(qx, np.maximum(2 * (widths[m[ok]] - 1) - qx, 0)), np.minimum(qy, np.maximum(2 * (heights[m[ok]] - 1) - qy, 0))
                        value[i, j] = (own.at((m[ok] * tall + qy + 1) * span + qx + 2) >= 0).astype(int)
                across = sum((1, 2, 1)[j + 1] * (value[1, j] - value[-1, j]) for j in (-1, 0, 1))
                down = sum((1, 2, 1)[i + 1] * (value[i, 1] - value[i, -1]) for i in (-1, 0, 1))
                sharp[m[ok][(across != 0) | (down != 0)]] = 1.0

    respond(np.unique(of, return_index=True)[1])  # the first run of each mask mostly tells
    respond(np.flatnonzero(sharp[of] == 0))
    return sharp


def mask_shape(masks: DataFrame) -> DataFrame:
    """``masks`` (height, width, runs, ...) with perimeter, compactness, n_components, fragmentation and edge of each.

    The perimeter is that of the outer border that encloses most; compactness takes all pixels of the mask. Empty
    masks, and null ones, have 0, 0, 0, 1, 0.
    """
    schema = StructType([*masks.schema.fields])
    for name, kind in _COLUMNS.items():
        schema = schema.add(name, kind)
    names = masks.columns

    def run(batches):
        for batch in batches:
            height, width = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width"))
            runs = batch.column(names.index("runs"))
            spans = runs.flatten()
            mask = np.repeat(np.arange(batch.num_rows), np.nan_to_num(runs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            found = measure(height, width, mask, *(spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in _COLUMNS)], [*names, *_COLUMNS])

    return masks.mapInArrow(run, schema)


def aspect(runs: Column) -> Column:
    """Score of a mask's elongation: 1 if round, by the spread along its main axes; 0 under two pixels or on a line."""
    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def add(t, s):
        a, b, y = s["x0"].cast("long"), s["x1"].cast("long"), s["y"].cast("long")
        n, x = b - a, (a + b - 1) * (b - a) / 2
        squares = lambda e: (e - 1) * e * (2 * e - 1) / 6
        long = lambda c: c.cast("long")
        return F.struct((t["n"] + n).alias("n"), (t["x"] + long(x)).alias("x"), (t["y"] + y * n).alias("y"), (t["xx"] + long(squares(b) - squares(a))).alias("xx"), (t["yy"] + y * y * n).alias("yy"), (t["xy"] + y * long(x)).alias("xy"))

    def score(t):
        n = t["n"]
        spread = lambda p, q, pq: (pq - t[p] * t[q] / n) / F.greatest(n - 1, F.lit(1))
        vx, vy, vxy = spread("x", "x", t["xx"]), spread("y", "y", t["yy"]), spread("x", "y", t["xy"])
        root = F.sqrt((vy - vx) * (vy - vx) + 4 * vxy * vxy)
        high, low = (vy + vx + root) / 2, (vy + vx - root) / 2
        return F.when(n < 2, 0.0).when(high <= 1e-6, 1.0).when(low <= high * 1e-12, 0.0).otherwise(F.exp(-0.5 * F.pow(F.log(F.sqrt(high / F.when(low > 0, low))), 2)))

    return F.aggregate(runs, start, add, score)
