"""Segmentation of tiles as they arrive: an addition, as file by file work is all that block-wise reading can mean here.

Each micro-batch's pixels are segmented tile by tile and appended; a tile must arrive whole within one batch, as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators.segment import Segmenter, segment_tiles

PIXELS = "r int, c int, bands array<double>"


def segment_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, nrow: int, ncol: int, fun: Segmenter, args: dict | None = None, tile_size: int = 512, once: bool = True) -> StreamingQuery:
    """Reads Parquet pixel files from folder and writes labels below out/batch=N; a batch that is run again overwrites its own folder."""
    pixels = spark.readStream.schema(PIXELS).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            labels = segment_tiles(df, nrow, ncol, fun, args, tile_size, keep_buffer=False).drop("inner")
            labels.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
