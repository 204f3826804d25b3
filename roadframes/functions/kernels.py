"""Numpy kernels that run inside Arrow batches, on stacks of equal-shaped frames.

Every function takes ``(n, height, width[, channels])`` arrays, so the cost per
frame is a few vector operations and not a Python call.
"""

from __future__ import annotations

import numpy as np

# Frames handled together are limited by pixels, so temporaries stay small even
# when an Arrow batch holds large frames.
PIXELS_PER_STACK = 1 << 21

# 22.5 and 67.5 degree tangents, scaled by 100000, in integers.
TAN_LOW, TAN_HIGH, TAN_SCALE = 41421, 241421, 100000


def to_bytes(stack: np.ndarray, wrap: bool = False) -> np.ndarray:
    """8-bit values; frames whose maximum is at most 1 are stretched to 0..255."""
    unit = stack.max(axis=(1, 2, 3), keepdims=True) <= 1.0
    values = stack.astype(np.float64) * np.where(unit, 255.0, 1.0) if unit.any() else stack
    if wrap:
        return np.mod(np.trunc(values), 256.0).astype(np.int32)
    return np.clip(values, 0.0, 255.0).astype(np.int32)


def channel_sums(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares of R, G and B, as ``(n, 3)``; one channel stands for all."""
    # sums of whole numbers below 2**53 are exact in doubles, and einsum is quick on them
    flat = stack.reshape(len(stack), -1, stack.shape[3]).astype(np.float64)
    total = np.einsum("npc->nc", flat).astype(np.int64)
    squares = np.einsum("npc,npc->nc", flat, flat).astype(np.int64)
    if stack.shape[3] == 1:
        return np.repeat(total, 3, axis=1), np.repeat(squares, 3, axis=1)
    return total[:, :3], squares[:, :3]


def minmax(stack: np.ndarray) -> np.ndarray:
    """Each frame from its smallest value at 0 to its largest at 1; a constant one is 0."""
    values = stack.astype(np.float64)
    low = values.min(axis=(1, 2, 3), keepdims=True)
    width = values.max(axis=(1, 2, 3), keepdims=True) - low
    return np.where(width == 0, 0.0, (values - low) / np.where(width == 0, 1.0, width))


def rgb(stack: np.ndarray) -> np.ndarray:
    """Three channels: one is replicated, a fourth is dropped."""
    return np.repeat(stack, 3, axis=3) if stack.shape[3] == 1 else stack[..., :3]


def denormalised(stack: np.ndarray, mean: tuple, std: tuple) -> np.ndarray:
    """Normalised ``(n, height, width, channels)`` values back to 0..1."""
    return np.clip(stack.astype(np.float64) * np.asarray(std) + np.asarray(mean), 0.0, 1.0).astype(np.float32)


def normalised(stack: np.ndarray, mean: tuple, std: tuple) -> np.ndarray:
    """8-bit ``(n, height, width, channels)`` values, scaled to 0..1 and normalised."""
    return (stack.astype(np.float64) / 255.0 - np.asarray(mean)) / np.asarray(std)


def gray(rgb: np.ndarray) -> np.ndarray:
    """Integer luma of ``(n, height, width, channels)``; one channel passes through."""
    if rgb.shape[3] == 1:
        return rgb[..., 0]
    return (299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2] + 500) // 1000


def edge_map(img: np.ndarray, low: int, high: int) -> np.ndarray:
    """Canny edges of ``(n, height, width)`` values from 0 to 255, as booleans."""
    n, h, w = img.shape
    # gradients of 8-bit values stay below 1021 and magnitudes below 2041: 16 bits do
    p = np.pad(img.astype(np.int16), ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = p[:, :, 2:] - p[:, :, :-2]
    gx = rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]
    cols = p[:, 2:, :] - p[:, :-2, :]
    gy = cols[:, :, :-2] + 2 * cols[:, :, 1:-1] + cols[:, :, 2:]
    ax, ay = np.abs(gx), np.abs(gy)
    m = np.zeros((n, h + 2, w + 2), dtype=np.int16)
    mag = m[:, 1:-1, 1:-1]
    np.add(ax, ay, out=mag)

    def at(dr: int, dc: int) -> np.ndarray:
        return m[:, 1 + dr:1 + dr + h, 1 + dc:1 + dc + w]

    ax, rise = ax.astype(np.int32), ay.astype(np.int32) * TAN_SCALE
    flat = rise < ax * TAN_LOW
    steep = rise > ax * TAN_HIGH
    falling = ((gx >= 0) == (gy >= 0)) | (gx == 0) | (gy == 0)
    peak = np.where(
        flat, (mag > at(0, -1)) & (mag >= at(0, 1)),
        np.where(
            steep, (mag > at(-1, 0)) & (mag >= at(1, 0)),
            np.where(
                falling, (mag > at(-1, -1)) & (mag > at(1, 1)),
                (mag > at(-1, 1)) & (mag > at(1, -1)))))
    kept = np.zeros(m.shape, dtype=bool)
    kept[:, 1:-1, 1:-1] = peak & (mag > low)
    return _grow(kept, m > high)[:, 1:-1, 1:-1]


def _grow(kept: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Pixels of ``kept`` 8-connected to a strong one; each pixel is visited once.

    The stack has a one-pixel empty border, so flat offsets never reach the next
    row's or the next frame's pixels.
    """
    width = kept.shape[2]
    steps = np.array([-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1])
    open_ = kept.ravel().copy()
    frontier = np.flatnonzero(open_ & strong.ravel())
    edges = np.zeros(open_.shape, dtype=bool)
    edges[frontier] = True
    open_[frontier] = False
    last = np.empty(open_.shape, dtype=np.int32)
    while frontier.size:
        near = (frontier[:, None] + steps).ravel()
        near = near[open_[near]]
        # of equal positions the last one written is kept, so none is followed twice
        turn = np.arange(near.size, dtype=np.int32)
        last[near] = turn
        frontier = near[last[near] == turn]
        edges[frontier] = True
        open_[frontier] = False
    return edges.reshape(kept.shape)


def resize(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of ``(n, height, width, channels)`` with pixel centres at one half."""

    def taps(size: int, out: int):
        at = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
        lo = np.floor(at).astype(np.int64)
        return lo, np.minimum(lo + 1, size - 1), at - lo

    values = stack.astype(np.float64)
    lo, hi, part = taps(stack.shape[1], height)
    part = part[None, :, None, None]
    values = values[:, lo] * (1 - part) + values[:, hi] * part
    lo, hi, part = taps(stack.shape[2], width)
    part = part[None, None, :, None]
    return values[:, :, lo] * (1 - part) + values[:, :, hi] * part
