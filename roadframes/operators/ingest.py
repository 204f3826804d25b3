"""Image bytes to tensors in one pass, with what fails beside them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.functions import kernels
from roadframes.functions.pixel_udfs import _lists
from roadframes.operators.frames import _check_region
from roadframes.schemas import IMAGENET_MEAN, IMAGENET_STD

#: Bytes of tensors in one output batch: small images grow much when they are resized.
BATCH_BYTES = 32 * 1024 * 1024
TENSORS = "origin string, height int, width int, channels int, layout string, pixels array<float>, reason string"


def _stacks(data: pa.Array, h: np.ndarray, w: np.ndarray, c: np.ndarray, size: int):
    """Yield ``(row numbers, (n, h, w, c) bytes)`` of whole images of one shape, a bounded number of pixels at a time."""
    wide = data.cast(pa.large_binary())
    _, places, content = wide.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
    values = np.frombuffer(content, dtype=np.uint8) if content else np.zeros(0, dtype=np.uint8)
    present = np.asarray(data.is_valid())
    whole = present & (h > 0) & (w > 0) & np.isin(c, (1, 3, 4)) & (np.diff(offsets) == h * w * c)
    shapes = np.stack([h, w, c], axis=1)
    for shape in np.unique(shapes[whole], axis=0):
        rows = np.flatnonzero(whole & (shapes == shape).all(axis=1))
        sh, sw, sc = (int(v) for v in shape)
        step = max(1, kernels.PIXELS_PER_STACK // max(sh * sw * sc, 3 * size * size))
        for part in range(0, len(rows), step):
            some = rows[part:part + step]
            block = np.stack([values[a:a + sh * sw * sc] for a in offsets[some]])
            yield some, block.reshape(-1, sh, sw, sc)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, in order."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def image_tensors(
    images: DataFrame, size: int = 224, region: Sequence[int] | None = None,
    mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD,
) -> DataFrame:
    """Decoded images (BGR) cut to ``region`` (x, y, width, height), resized, normalised, channels first.

    One row for each image: a tensor, or NULL pixels, the image's own dimensions and a ``reason``. One
    Arrow function goes from bytes to tensor. It gives as many batches as the tensors need, so a worker
    holds a bounded number of them however many images come in one batch.
    """
    if region:
        _check_region(*region)
    mean, std = tuple(mean), tuple(std)
    at_once = max(1, BATCH_BYTES // (12 * size * size))

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        h, w, c = (np.asarray(batch.column(k).cast(pa.int64()).fill_null(-1)) for k in (1, 2, 3))
        reason = np.full(n, "conversion failed", dtype=object)
        reason[h < 0] = "cannot decode image"
        if region:
            x, y, rw, rh = region
            reason[(h >= 0) & ((y + rh > h) | (x + rw > w))] = "region exceeds image"
        parts = []
        for rows, block in _stacks(batch.column(4), h, w, c, size):
            if region:
                if reason[rows[0]] == "region exceeds image":
                    continue
                block = block[:, y:y + rh, x:x + rw]
            rgb = kernels.rgb(block) if block.shape[3] == 1 else block[..., 2::-1]
            out = kernels.normalised(kernels.resize(rgb, size, size), mean, std).astype(np.float32)
            parts.append((rows, np.ascontiguousarray(out.transpose(0, 3, 1, 2)).reshape(len(rows), -1)))
            reason[rows] = None
        good = reason == None  # noqa: E711
        shape = [np.where(good, size, h), np.where(good, size, w), np.where(good, 3, c)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, pa.int32()) for v in shape),
             pa.array(np.where(good, "CHW", None), pa.string()), _lists(n, parts, pa.float32()), pa.array(reason, pa.string())],
            ["origin", "height", "width", "channels", "layout", "pixels", "reason"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(convert, pieces(batches, at_once))

    image = F.col("image")
    return images.select(*[image[k].alias(k) for k in ("origin", "height", "width", "nChannels", "data")]).mapInArrow(run, TENSORS)
