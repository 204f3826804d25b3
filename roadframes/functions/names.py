"""Capture names: both conventions, with or without the crop suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: time first or camera first, optional "_cropped", jpg or png.
CAPTURE_NAME = r"^(?:(\d{8}_\d{6})_(.+?)|(.+)_(\d{8}_\d{6}))(?:_cropped)?[.](?:jpg|png)$"
TIME_FORMAT = "yyyyMMdd_HHmmss"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_capture_name(path: Column) -> Column:
    """``struct<camera, captured_at>``; both NULL when the name follows neither convention."""
    name = file_name(path)

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, CAPTURE_NAME, i), F.lit(""))

    stamp = F.coalesce(group(1), group(4))
    return F.struct(
        F.coalesce(group(2), group(3)).alias("camera"),
        F.try_to_timestamp(stamp, F.lit(TIME_FORMAT)).cast("timestamp_ntz").alias("captured_at"))


def capture_name(camera: Column, at: Column, time_first: bool = False, extension: str = ".jpg") -> Column:
    """File name of a capture by either convention."""
    stamp = F.date_format(at, TIME_FORMAT)
    parts = (stamp, camera) if time_first else (camera, stamp)
    return F.concat(F.concat_ws("_", *parts), F.lit(extension))


def cropped_name(path: Column) -> Column:
    """File name of the crop: the name without its extension, plus ``_cropped.jpg``."""
    return F.concat(F.regexp_replace(file_name(path), r"[.][^.]*$", ""), F.lit("_cropped.jpg"))
