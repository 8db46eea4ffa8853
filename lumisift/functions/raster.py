"""Features of frames: Column expressions over an 8x8 grid of grey levels, and NumPy kernels for decoded rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from lumisift.shipping import ship

ship(__name__)

SIDE = 8
CELLS = SIDE * SIDE
#: The sharpness that counts as full, and the shares of sharpness and exposure in a score.
SHARPNESS_CAP = 1000.0
SHARPNESS_SHARE, EXPOSURE_SHARE = 0.7, 0.3


def grid_sum(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0).cast("long"), lambda a, x: a + x)


def exposure(grid: Column) -> Column:
    """1 at mid grey, 0 at black or white."""
    return F.lit(1.0) - F.lit(2.0) * F.abs(grid_sum(grid) / F.lit(float(CELLS)) / F.lit(255.0) - F.lit(0.5))


def laplacian(grid: Column) -> Column:
    """Four neighbours less four times the cell; at an edge the inner neighbour counts twice (reflection without the edge)."""

    def at(i: Column) -> Column:
        row, col = F.floor(i / SIDE).cast("int"), i % SIDE
        up = F.when(row == 0, i + SIDE).otherwise(i - SIDE)
        down = F.when(row == SIDE - 1, i - SIDE).otherwise(i + SIDE)
        left = F.when(col == 0, i + 1).otherwise(i - 1)
        right = F.when(col == SIDE - 1, i - 1).otherwise(i + 1)
        return F.get(grid, up) + F.get(grid, down) + F.get(grid, left) + F.get(grid, right) - 4 * F.get(grid, i)

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), at)


def variance(values: Column, n: int = CELLS) -> Column:
    """Population variance of integers: whole numbers up to one division, so any engine gives the same double."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(values, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")))
    return F.aggregate(F.array(sums), F.lit(0.0), lambda _, t: (t["q"] * n - t["s"] * t["s"]) / F.lit(float(n * n)))


def sharpness(grid: Column) -> Column:
    return variance(laplacian(grid))


def composite(sharp: Column, exposed: Column) -> Column:
    return F.lit(SHARPNESS_SHARE) * F.least(sharp / F.lit(SHARPNESS_CAP), F.lit(1.0)) + F.lit(EXPOSURE_SHARE) * exposed


def average_hash(grid: Column) -> Column:
    """64 bits as a long: bit i is set where cell i is above (not at) the mean.

    The sum is an element of its own array, so that it is taken once a grid and not anew in each cell's lambda.
    """

    def bits(whole: Column) -> Column:
        return F.transform(grid, lambda x, i: F.when(x * CELLS > whole, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.array(grid_sum(grid)), F.lit(0).cast("long"), lambda _, whole: F.aggregate(bits(whole), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def eye_aspect_ratio(p: list[tuple[Column, Column]]) -> Column:
    """Of six landmarks of an eye: (|p1p5| + |p2p4|) / (2 |p0p3|), 0 where the eye has no width."""
    away = lambda a, b: F.sqrt(F.pow(a[0] - b[0], F.lit(2.0)) + F.pow(a[1] - b[1], F.lit(2.0)))
    wide = away(p[0], p[3])
    return F.when(wide == 0, F.lit(0.0)).otherwise((away(p[1], p[5]) + away(p[2], p[4])) / (F.lit(2.0) * wide))


#: An eye's ratio below which it is closed, and what that leaves of a score.
CLOSED_BELOW, CLOSED_PENALTY = 0.2, 0.4


def face_multiplier(least_ratio: Column) -> Column:
    """The penalty where the worst eye of any face is closed; 1 where there is no face."""
    return F.when(least_ratio < CLOSED_BELOW, F.lit(CLOSED_PENALTY)).otherwise(F.lit(1.0))


# --- decoded rasters ---------------------------------------------------------------------------------------------


def luma_level(red: Column, green: Column, blue: Column) -> Column:
    """The grey level of a pixel, as `luma` has it for rasters."""
    return F.shiftright(red * 19595 + green * 38470 + blue * 7471 + 0x8000, 16).cast("int")


def luma(image: np.ndarray) -> np.ndarray:
    """uint8 grey levels of an HxWxC raster in blue-green-red(-alpha) order, or HxW: 0.299 R + 0.587 G + 0.114 B in 16-bit fixed point."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    b, g, r = (image[:, :, k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def shrunk(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of the target's cells, as floats."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        size = x.shape[0]
        edges = np.linspace(0, size, n + 1)
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        low = np.floor(edges).astype(int).clip(0, size)
        part = edges - low
        at = total[low] + part.reshape(-1, *[1] * (x.ndim - 1)) * (total[np.minimum(low + 1, size)] - total[low])
        return np.diff(at, axis=0) / (size / n)

    return along(along(gray.astype(np.float64), height).T, width).T


def raster_features(gray: np.ndarray, longest: int = 1024) -> tuple[float, float, list[int]]:
    """(sharpness, exposure, 8x8 grid) of a grey raster; larger ones are shrunk to `longest` first, for the first two."""
    grid = np.rint(shrunk(gray, SIDE, SIDE)).clip(0, 255).astype(int)
    h, w = gray.shape
    scale = min(1.0, longest / max(h, w))
    small = gray.astype(np.float64) if scale == 1 else np.rint(shrunk(gray, max(1, round(h * scale)), max(1, round(w * scale))))
    padded = np.pad(small, [(1, 1) if n > 1 else (0, 0) for n in small.shape], mode="reflect")
    if small.shape[0] == 1:
        padded = np.repeat(padded, 3, axis=0)
    if small.shape[1] == 1:
        padded = np.repeat(padded, 3, axis=1)
    edges = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * padded[1:-1, 1:-1]
    return float(edges.var()), float(1 - 2 * abs(small.mean() / 255 - 0.5)), [int(x) for x in grid.ravel()]
