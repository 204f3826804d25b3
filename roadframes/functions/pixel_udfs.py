"""Arrow UDFs over whole batches of frames; only small structs or new pixels leave."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframes.functions import kernels

# Executors need no installed copy: the kernels travel inside the pickled UDF.
cloudpickle.register_pickle_by_value(sys.modules["roadframes"])

FAILED = "Failed to process image"
COUNT_NAMES = ["px", "edge_px", "px_sum", "px_sumsq"]
CHANNEL_NAMES = ["r_sum", "g_sum", "b_sum", "r_sumsq", "g_sumsq", "b_sumsq"]


def _stacks(pixels, height, width, channels, layout, scored: bool = False):
    """Yield ``(row numbers, (n, h, w, c) values)`` for the usable frames of a batch.

    Frames are grouped by shape, and groups are cut by pixel count. A frame is usable
    when its values fit its shape; to be ``scored`` they must also be finite, in one,
    three or four channels. A NULL layout is guessed: channels first when the first
    axis could be the three channels.
    """
    counts = np.asarray(pixels.value_lengths().fill_null(0), dtype=np.int64)
    starts = np.asarray(pixels.offsets, dtype=np.int64)[:-1]
    flat = pixels.values
    has_null = flat.null_count > 0
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan) if has_null else flat)
    h, w, c = (np.asarray(x.cast(pa.int64()).fill_null(0)) for x in (height, width, channels))
    first = np.array([_channels_first(x, c[i]) for i, x in enumerate(layout.to_pylist())], dtype=bool)
    usable = (h > 0) & (w > 0) & (c > 0) & (counts == h * w * c)
    if scored:
        usable &= np.isin(c, (1, 3, 4))
    shapes = np.stack([h, w, c, first], axis=1)
    for shape in np.unique(shapes[usable], axis=0):
        rows = np.flatnonzero(usable & (shapes == shape).all(axis=1))
        sh, sw, sc, chw = (int(v) for v in shape)
        size = sh * sw * sc
        step = max(1, kernels.PIXELS_PER_STACK // size)
        for part in range(0, len(rows), step):
            some = rows[part:part + step]
            at = starts[some]
            if (np.diff(at) == size).all():
                block = values[at[0]:at[0] + len(at) * size].reshape(-1, size)
            else:
                block = values[at[:, None] + np.arange(size)]
            if scored:
                good = np.isfinite(block).all(axis=1)
                some, block = some[good], block[good]
            if len(some):
                if chw:
                    block = block.reshape(-1, sc, sh, sw).transpose(0, 2, 3, 1)
                yield some, block.reshape(-1, sh, sw, sc)


def _lists(n: int, parts: list, kind: pa.DataType) -> pa.Array:
    """One list per row from ``(row numbers, (rows, values))`` parts; other rows are NULL."""
    lengths = np.zeros(n, dtype=np.int64)
    for rows, block in parts:
        lengths[rows] = block.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.empty(offsets[-1], dtype=kind.to_pandas_dtype())
    for rows, block in parts:
        if rows[-1] - rows[0] + 1 == len(rows):
            values[offsets[rows[0]]:offsets[rows[-1] + 1]] = block.ravel()
        else:
            values[offsets[rows][:, None] + np.arange(block.shape[1])] = block
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(values, kind), mask=pa.array(lengths == 0))


def _channels_first(layout, channels) -> bool:
    if layout is None:
        return bool(channels == 3)
    return layout == "CHW"


def pixel_udf(kernel: Callable[[np.ndarray], np.ndarray | None], layout: str | None = None, whole: bool = False):
    """New pixels of each frame from ``kernel`` on ``(n, h, w, c)`` stacks.

    The result is in ``layout`` order, or in each frame's own order for None. Where the
    kernel gives None the pixels are NULL. With ``whole`` the values are integers and
    frames that cannot be scored are NULL.
    """
    kind = pa.int32() if whole else pa.float32()

    @F.arrow_udf(T.ArrayType(T.IntegerType() if whole else T.FloatType()))
    def new_pixels(
        pixels: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, stated: pa.Array
    ) -> pa.Array:
        parts = []
        for rows, block in _stacks(pixels, height, width, channels, stated, scored=whole):
            first = int(rows[0])
            stays = _channels_first(stated[first].as_py(), channels[first].as_py())
            out = kernel(block)
            if out is None:
                continue
            if layout == "CHW" or (layout is None and stays):
                out = out.transpose(0, 3, 1, 2)
            parts.append((rows, np.ascontiguousarray(out).reshape(len(rows), -1)))
        return _lists(len(pixels), parts, kind)

    return new_pixels


def frame_counts_udf(
    edge_threshold: int = 50, overflow: str = "clamp", normal: tuple | None = None, by_channel: bool = False
):
    """Integer counts of one pass over the pixels: size, edges, gray sum and sum of squares.

    ``normal`` gives the (mean, std) of normalised frames, undone in the same pass.
    ``by_channel`` adds the sums of R, G and B.
    """
    wrap = overflow == "wrap"
    names = COUNT_NAMES + CHANNEL_NAMES if by_channel else COUNT_NAMES

    @F.arrow_udf("struct<valid:boolean,reason:string," + ",".join(f"{name}:bigint" for name in names) + ">")
    def frame_counts(
        pixels: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, layout: pa.Array
    ) -> pa.Array:
        n = len(pixels)
        valid = np.zeros(n, dtype=bool)
        out = np.zeros((len(names), n), dtype=np.int64)
        for rows, block in _stacks(pixels, height, width, channels, layout, scored=True):
            shape = block.shape
            if normal:
                block = kernels.denormalised(block, *normal)
            rgb = kernels.to_bytes(block, wrap)
            g = kernels.gray(rgb)
            edges = kernels.edge_map(g, edge_threshold, 2 * edge_threshold)
            valid[rows] = True
            out[0, rows] = shape[1] * shape[2]
            out[1, rows] = edges.sum(axis=(1, 2))
            out[2, rows] = g.sum(axis=(1, 2), dtype=np.int64)
            out[3, rows] = np.square(g).sum(axis=(1, 2), dtype=np.int64)
            if by_channel:
                total, squares = kernels.channel_sums(rgb)
                out[4:7, rows], out[7:10, rows] = total.T, squares.T
        reason = pa.array(np.where(valid, None, FAILED), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(valid), reason, *(pa.array(v) for v in out)], ["valid", "reason", *names])

    return frame_counts


@F.arrow_udf(T.ArrayType(T.FloatType()))
def image_pixels(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    """Image bytes (BGR order) to R, G, B values; gray is replicated, alpha dropped."""
    shapes = list(zip(height.to_pylist(), width.to_pylist(), channels.to_pylist()))
    sizes, usable = np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=bool)
    for i, (h, w, c) in enumerate(shapes):
        if data[i].is_valid and h and h >= 1 and c in (1, 3, 4) and len(data[i].as_buffer()) == h * w * c:
            sizes[i], usable[i] = 3 * h * w, True
    ends = np.cumsum(sizes)
    values = np.empty(int(sizes.sum()), dtype=np.float32)  # written in place: no second copy of a batch's pixels
    for i in np.flatnonzero(usable).tolist():
        px = np.frombuffer(data[i].as_buffer(), dtype=np.uint8).reshape(-1, shapes[i][2])
        values[ends[i] - sizes[i]:ends[i]].reshape(-1, 3)[:] = px if px.shape[1] == 1 else px[:, 2::-1]
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values), mask=pa.array(~usable))


def pixel_columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + name) for name in ("pixels", "height", "width", "channels", "layout")]
