"""Frames per second of scoring, on many small and on few large frames.

``python tools/throughput.py CORES SF_DIR SCRATCH``: frames are made from the
``embeddings`` table by repetition, stored once under SCRATCH, and scored.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(cores: str, sf: str, scratch: str) -> None:
    from pyspark.sql import functions as F

    from roadframes.operators import frames as fr
    from roadframes.operators.metrics import analyze
    from roadframes.plans.standins import gray_frames
    from roadframes.schemas import FRAMES, IMAGENET_MEAN, IMAGENET_STD
    from roadframes.session import build_session

    spark = build_session(
        "throughput", f"local[{cores}]", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    small, large = f"{scratch}/small", f"{scratch}/large"
    if not os.path.exists(small):
        one = gray_frames(spark, sf)
        one.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(100)))).repartition(32).select(
            *FRAMES.names).write.parquet(small)
        one.orderBy("frame_id").limit(800).repartition(32).withColumns({
            "pixels": F.flatten(F.array_repeat("pixels", 2352)), "height": F.lit(224), "width": F.lit(224),
            "channels": F.lit(3), "layout": F.lit("CHW")}).select(*FRAMES.names).write.parquet(large)

    def rate(name, df, n):
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        print(f"{cores} cores  {name:28s} {best:7.2f} s {n / best:10.0f} frames/s", flush=True)

    frames = spark.read.schema(FRAMES).parquet(small)
    rate("score 200,000 of 8x8", analyze(frames, 100), frames.count())
    frames = spark.read.schema(FRAMES).parquet(large)
    rate("read 800 of 3x224x224", frames, 800)
    rate("score 800 of 3x224x224", analyze(frames, 100), 800)
    rate("score tensors 3x224x224", analyze(frames, 100, normal=(IMAGENET_MEAN, IMAGENET_STD)), 800)
    rate("to_tensor 3x224x224", fr.to_tensor(frames, 112), 800)


if __name__ == "__main__":
    main(*sys.argv[1:])
