"""Generated PNG folders for tests, demonstrations and timing; needs no image library."""

from __future__ import annotations

import os

import numpy as np

from lumisift.functions.png import png


def checker(side: int, cell: int = 16, low: int = 128, high: int = 255) -> np.ndarray:
    at = np.arange(side) // cell
    return np.where((at[:, None] + at[None, :]) % 2 == 0, low, high).astype(np.uint8)


def softened(gray: np.ndarray, radius: int) -> np.ndarray:
    """Box blur."""
    x = np.pad(gray.astype(float), radius, mode="edge")
    for axis in (0, 1):
        total = np.cumsum(np.insert(x, 0, 0, axis=axis), axis=axis)
        n = 2 * radius + 1
        x = (np.take(total, range(n, total.shape[axis]), axis=axis) - np.take(total, range(total.shape[axis] - n), axis=axis)) / n
    return np.rint(x).astype(np.uint8)


def scene(k: int, side: int = 900) -> np.ndarray:
    """A frame of its own for each k: blocks of light and dark by the bits of a number, over a fine checker."""
    bits = (k * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)
    bits = (bits ^ (bits >> 31)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    grid = np.array([(bits >> i) & 1 for i in range(64)], dtype=float).reshape(8, 8)
    light = np.kron(grid, np.ones((side // 8 + 1, side // 8 + 1)))[:side, :side]
    return (60 + 100 * light + (checker(side, 6, 0, 60))).astype(np.uint8)


def write_shoot(folder: str, scenes: int = 9, variants: int = 3, blurred: int = 2, side: int = 900) -> list[str]:
    """A folder of scenes, each with softer variants, and of flat blurred frames; returns the names."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for k in range(scenes):
        for v in range(variants):
            gray = scene(k, side)
            names.append(f"scene_{k:03d}_{v}.png")
            with open(f"{folder}/{names[-1]}", "wb") as f:
                f.write(png(gray if v == 0 else softened(gray, v)))
    for k in range(blurred):
        names.append(f"soft_{k:03d}.png")
        with open(f"{folder}/{names[-1]}", "wb") as f:
            f.write(png(softened(scene(1000 + k, side), 40)))
    return names
