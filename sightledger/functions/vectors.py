"""Vector expressions (JVM side) and the numpy helpers the Arrow operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

FLOAT32_EPS = float(np.finfo(np.float32).eps)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))


def l2_normalize(v) -> Column:
    """v / max(|v|, eps): a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    length = F.greatest(norm(v), F.lit(FLOAT32_EPS))
    return F.transform(v, lambda x: x.cast("double") / length)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def cosine(a, b) -> Column:
    """Cosine of two unit vectors, clipped to [-1, 1]."""
    return clip(dot(a, b), -1.0, 1.0)


def weighted_score(global_sim: Column, local_ratio: Column, wg=0.5, wl=0.5) -> Column:
    return clip(global_sim * wg + local_ratio * wl, -1.0, 1.0)


def slices(v, parts: int, width: int) -> Column:
    """Cut one vector into ``parts`` normalised slices of ``width``."""
    v = F.col(v) if isinstance(v, str) else v
    return F.array(*[
        l2_normalize(F.slice(v, i * width + 1, width)) for i in range(parts)
    ])


def select_patches(runs: Column, width, height, grid: int, min_coverage: float) -> Column:
    """(row, col) of the cells whose mean mask coverage reaches the minimum, as array<struct<r, c>>.

    Each run is intersected with the columns of the grid for a whole Arrow batch at a time, so
    the cost follows the number of runs, not the number of pixels.
    """
    def pick(runs: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        return _picked_cells(runs, width, height, grid, min_coverage)

    numbers = [(x if isinstance(x, Column) else F.lit(x)).cast("long") for x in (width, height)]
    return F.arrow_udf(pick, "array<struct<r:int,c:int>>")(runs, *numbers)


# --- numpy, inside Arrow tasks --------------------------------------------

# Counts (rows x cells) of an Arrow batch that are held at a time.
_CELLS = 4_000_000


def _picked_cells(runs: pa.Array, width: pa.Array, height: pa.Array, grid: int, least: float) -> pa.Array:
    parts = []
    step = max(1, _CELLS // (grid * grid))
    for lo in range(0, len(runs), step):
        parts.append(_picked_part(runs.slice(lo, step), width.slice(lo, step), height.slice(lo, step), grid, least))
    cells = pa.struct([("r", pa.int32()), ("c", pa.int32())])
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(cells))


def _picked_part(runs: pa.Array, width: pa.Array, height: pa.Array, grid: int, least: float) -> pa.Array:
    n, flat = len(runs), runs.flatten()
    size = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), size)
    start, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "len"))
    # An image of unknown size, or with cells of no pixels, has no cells.
    wide, high = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (width, height))
    cell_w, cell_h = wide // grid, high // grid
    y, x0 = np.divmod(start, np.maximum(wide, 1)[owner])
    x1, w = x0 + length, cell_w[owner]
    row = y // np.maximum(cell_h, 1)[owner]
    inside = row < grid
    counts = np.zeros((n, grid, grid))
    for c in range(grid):
        shared = np.minimum(x1, (c + 1) * w) - np.maximum(x0, c * w)
        use = inside & (shared > 0)
        counts[:, :, c] = np.bincount(owner[use] * grid + row[use], weights=shared[use], minlength=n * grid).reshape(n, grid)
    area = (cell_w * cell_h)[:, None, None]
    i, r, c = np.nonzero((area > 0) & (counts / np.maximum(area, 1) >= least))
    ends = np.searchsorted(i, np.arange(n + 1))
    cells = pa.StructArray.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))], ["r", "c"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)


def unit_rows(column) -> np.ndarray:
    """Stack a pandas column of vectors and normalise each row."""
    m = np.array(column.tolist(), dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOAT32_EPS)


# Rows of a product computed at a time, so a tile's memory is rows x strip, not rows^2.
STRIP = 1024


def strips(n: int, step: int = STRIP):
    """(low, high) bounds cutting n rows into strips."""
    return ((lo, min(n, lo + step)) for lo in range(0, n, step))


def unit_matrix(rows) -> np.ndarray:
    """One local matrix (patches x width), rows normalised; empty when no patch."""
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64)
    if m.size == 0:
        return np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOAT32_EPS)


def local_match_ratio(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Symmetric share of patches having a strong counterpart in the other view."""
    if not len(a) or not len(b):
        return 0.0
    if a.shape[1] != b.shape[1]:
        raise ValueError("local matrices must share one width")
    strong = a @ b.T >= threshold
    return float(strong.any(axis=1).mean() + strong.any(axis=0).mean()) / 2.0
