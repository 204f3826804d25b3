"""Per-frame transforms and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframes.functions import kernels, pixel_udfs, pixels
from roadframes.schemas import IMAGENET_MEAN, IMAGENET_STD


def to_rgb(df: DataFrame) -> DataFrame:
    """Image rows to frames of R, G, B values; NULL pixels where the image is unusable."""
    image = F.col("image")
    rgb = pixel_udfs.image_pixels(image["data"], image["height"], image["width"], image["nChannels"])
    return df.select(
        *[c for c in df.columns if c != "image"],
        image["origin"].alias("origin"),
        image["height"].alias("height"),
        image["width"].alias("width"),
        F.lit(3).alias("channels"),
        F.lit("HWC").alias("layout"),
        rgb.alias("pixels"))


def _kernel(df: DataFrame, udf) -> DataFrame:
    return df.withColumn("pixels", udf(*pixel_udfs.pixel_columns()))


def gray_to_rgb(df: DataFrame) -> DataFrame:
    """Array form of ``to_rgb``: one channel is replicated, a fourth one dropped."""
    return _kernel(df, pixel_udfs.pixel_udf(kernels.rgb, "HWC")).withColumns(
        {"channels": F.lit(3), "layout": F.lit("HWC")})


def crop(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Cut one region out of every frame; where it does not fit, the pixels become NULL.

    ``crop_in_bounds`` finds those frames beforehand without touching pixels.
    """
    _check_region(x, y, w, h)

    def cut(stack):
        fits = y + h <= stack.shape[1] and x + w <= stack.shape[2]
        return stack[:, y:y + h, x:x + w] if fits else None

    return _kernel(df, pixel_udfs.pixel_udf(cut)).withColumns({"height": F.lit(h), "width": F.lit(w)})


def crop_in_bounds(df: DataFrame, x: int, y: int, w: int, h: int) -> tuple[DataFrame, DataFrame]:
    """Frames the region fits into, and the rest. Reads shape columns only."""
    _check_region(x, y, w, h)
    fits = F.coalesce((F.lit(x + w) <= F.col("width")) & (F.lit(y + h) <= F.col("height")), F.lit(False))
    return df.where(fits), df.where(~fits)


def _check_region(x: int, y: int, w: int, h: int) -> None:
    if w <= 0 or h <= 0:
        raise ValueError("the crop region is empty")
    if x < 0 or y < 0:
        raise ValueError("the crop region begins outside the frame")


def resize(df: DataFrame, size: int = 224) -> DataFrame:
    """Bilinear resize to ``size`` by ``size``."""
    udf = pixel_udfs.pixel_udf(lambda stack: kernels.resize(stack, size, size))
    return _kernel(df, udf).withColumns({"height": F.lit(size), "width": F.lit(size)})


def normalise(
    df: DataFrame, mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD
) -> DataFrame:
    return _kernel(df, pixel_udfs.pixel_udf(lambda stack: kernels.normalised(stack, tuple(mean), tuple(std))))


def to_tensor(
    df: DataFrame, size: int = 224, mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD
) -> DataFrame:
    """Resize, rescale, normalise, channels first: one pass over the pixels."""
    def tensor(stack):
        return kernels.normalised(kernels.resize(stack, size, size), tuple(mean), tuple(std))

    return _kernel(df, pixel_udfs.pixel_udf(tensor, "CHW")).withColumns(
        {"height": F.lit(size), "width": F.lit(size), "layout": F.lit("CHW")})


def denormalise(
    df: DataFrame, mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD
) -> DataFrame:
    return _kernel(df, pixel_udfs.pixel_udf(lambda stack: kernels.denormalised(stack, tuple(mean), tuple(std))))


def minmax_scale(df: DataFrame) -> DataFrame:
    return _kernel(df, pixel_udfs.pixel_udf(kernels.minmax))


def to_hwc(df: DataFrame) -> DataFrame:
    return _kernel(df, pixel_udfs.pixel_udf(lambda stack: stack, "HWC")).withColumn("layout", F.lit("HWC"))


def to_chw(df: DataFrame) -> DataFrame:
    return _kernel(df, pixel_udfs.pixel_udf(lambda stack: stack, "CHW")).withColumn("layout", F.lit("CHW"))


def unbatch(df: DataFrame, shape: str = "shape") -> DataFrame:
    """Values with more than three dimensions: keep the element at [0, 0].

    As in plain array indexing, two leading dimensions go; a three-dimensional
    value is left as it is.
    """
    dims = F.col(shape)
    deep = F.size(dims) > 3
    rest = F.when(deep, F.slice(dims, 3, F.size(dims) - 2)).otherwise(dims)
    elements = F.get(dims, F.lit(0)) * F.get(dims, F.lit(1))
    length = F.floor(F.try_divide(F.size("pixels"), elements)).cast("int")
    return df.withColumns({
        "pixels": F.when(deep, F.slice(F.col("pixels"), 1, length)).otherwise(F.col("pixels")), shape: rest})


def to_uint8(df: DataFrame, overflow: str = "clamp") -> DataFrame:
    if overflow not in ("clamp", "wrap"):
        raise ValueError("overflow is clamp or wrap")
    wrap = overflow == "wrap"
    return _kernel(df, pixel_udfs.pixel_udf(lambda stack: kernels.to_bytes(stack, wrap), whole=True))


def gray(df: DataFrame) -> DataFrame:
    """One gray value per pixel of 8-bit frames."""
    def luma(stack):
        return kernels.gray(stack.astype("int32"))[..., None]

    return _kernel(df, pixel_udfs.pixel_udf(luma, whole=True)).withColumn("channels", F.lit(1))


def constant_label(df: DataFrame, value: int = 0) -> DataFrame:
    return df.withColumn("label", F.lit(value))


def label_by_source(df: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """The source decides the label; a stored label is ignored."""
    label = F.lit(None).cast("int")
    for source, value in mapping.items():
        label = F.when(F.col("source") == source, F.lit(value)).otherwise(label)
    return df.withColumn("label", label)


def model_sample(df: DataFrame) -> DataFrame:
    """Training types: 32-bit metrics and pixels, 64-bit level."""
    return df.select(
        "frame_id",
        F.col("pixels").cast("array<float>").alias("image"),
        *[F.col(c).cast("float").alias(c) for c in ("density", "congestion", "flow_rate")],
        F.col("traffic_level").cast("bigint").alias("traffic_level"))


def value_range(df: DataFrame) -> DataFrame:
    return df.withColumns({"min_value": F.array_min("pixels"), "max_value": F.array_max("pixels")})


def frame_shape(df: DataFrame) -> DataFrame:
    """Dimensions in layout order, and whether the pixel count agrees with them."""
    h, w, c = F.col("height"), F.col("width"), F.col("channels")
    shape = F.when(pixels.layout_or_guess() == "CHW", F.array(c, h, w)).otherwise(F.array(h, w, c))
    return df.withColumns({"shape": shape, "consistent": F.size("pixels") == h * w * c})


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable frames, and the failed ones with a reason."""
    failed = reject_reason()
    return df.where(failed.isNull()), df.withColumn("reason", failed).where(F.col("reason").isNotNull())


def reject_reason() -> Column:
    px = F.col("pixels")
    return (
        F.when(px.isNull(), "no pixels")
        .when(~F.coalesce(F.size(px) == F.col("height") * F.col("width") * F.col("channels"), F.lit(False)), "impossible shape")
        .when(pixels.has_gaps(px), "value is not a number"))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Missing scores become zeros, level 0 and ``valid=false``; no row is dropped."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("density", "congestion", "flow_rate")}
    return df.withColumns({
        **zero,
        "traffic_level": F.coalesce(F.col("traffic_level"), F.lit(0)),
        "valid": F.coalesce(F.col("valid"), F.lit(False))})


def name_filter(df: DataFrame, prefix: str = "", suffix: str = "", name: str = "name") -> DataFrame:
    return df.where(F.startswith(F.col(name), F.lit(prefix)) & F.endswith(F.col(name), F.lit(suffix)))


def map_frames(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str
) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it may return fewer or more rows than it got."""

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def by_batch(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Apply a pandas function to each batch of ``batches``; a batch is small by its size."""
    return df.groupBy("batch_id").applyInPandas(fn, schema)
