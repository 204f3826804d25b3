"""One file per row, written by the tasks that hold the rows."""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules["roadframes"])


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Write ``content`` (binary) of each row to ``folder/name`` on a shared file system.

    A file is written under a passing name and then moved, so a repeated or
    speculative task leaves the same whole file.
    """

    def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Buffer]]:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield file, data.as_buffer()

    _write(df.select(F.col(name).cast("string"), F.col(content).cast("binary")), folder, contents)


def write_png_files(df: DataFrame, folder: str, name: str = "name") -> None:
    """Write 8-bit channels-last frames as PNG files; those whose shape does not fit are left out.

    The function that writes a file also encodes it, one at a time: a task has no process beside it that
    holds a batch of encoded files.
    """

    def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        shapes = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)))
        for px, (file, h, w, c) in zip(batch.column(1), shapes):
            png = _png(px, h, w, c)
            if png is not None:
                yield file, png

    _write(df.select(F.col(name).cast("string"), "pixels", "height", "width", "channels"), folder, contents)


def _write(rows: DataFrame, folder: str, contents: Callable[[pa.RecordBatch], Iterator[tuple]]) -> None:
    """Write the files that ``contents`` gives for each batch; the first column names them."""
    root = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", folder.rstrip("/")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for file, data in contents(batch):
                target = f"{base}/{file}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                passing = f"{parent}/.{uuid.uuid4().hex}"
                with system.open_output_stream(passing) as out:
                    out.write(data)
                system.move(passing, target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])
        pa.default_memory_pool().release_unused()  # workers live on, and their memory counts

    rows.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def _png(px: pa.Scalar, h: int | None, w: int | None, c: int | None) -> bytes | None:
    kinds = {1: 0, 3: 2, 4: 6}
    if not px.is_valid or c not in kinds or len(px.values) != h * w * c:
        return None
    raw = px.values.cast(pa.uint8(), safe=False).to_numpy(zero_copy_only=False).tobytes()
    row = w * c
    lines = b"".join(b"\0" + raw[r * row:(r + 1) * row] for r in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, kinds[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + b"".join(
        struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
        for tag, body in ((b"IHDR", head), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")))


@F.arrow_udf(T.BinaryType())
def png_bytes(pixels: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    """8-bit channels-last pixels as a PNG file; NULL where the shape does not fit."""
    shapes = zip(height.to_pylist(), width.to_pylist(), channels.to_pylist())
    return pa.array([_png(px, *shape) for px, shape in zip(pixels, shapes)], pa.binary())
