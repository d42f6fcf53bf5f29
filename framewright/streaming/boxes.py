"""Boxes as a stream: section counts with and without event time, and the greedy choice as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators import boxes as B
from framewright.operators.tracking import choose


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, a file or a folder of files, as a stream of at most so many files a batch."""
    place = f"{sf_dir}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(place) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def section_counts(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, section_id, n_boxes) of all rows so far; for the complete or update mode."""
    placed = B.with_section(B.scan_boxes(boxes), videos)
    return placed.groupBy("video_id", "section_id").agg(F.count("*").alias("n_boxes"))


def timed_section_counts(boxes: DataFrame, videos: DataFrame, late: str = "10 seconds", seconds: int = B.SECTION_SECONDS) -> DataFrame:
    """(video_id, window, n_boxes) by event time, the recording's start plus frame / fps; for the append mode.

    A window is given out once the watermark has passed it; boxes later than ``late`` behind it are dropped, as
    a watermark does.
    """
    v = videos.select("video_id", "fps", "recorded_at")
    at = F.timestamp_micros(F.unix_micros("recorded_at") + (F.col("frame_id") * 1_000_000 / F.col("fps")).cast("long"))
    timed = B.scan_boxes(boxes).join(v, "video_id").withColumn("at", at).withWatermark("at", late)
    return timed.groupBy("video_id", F.window("at", f"{seconds} seconds")).agg(F.count("*").alias("n_boxes"))


def greedy_choices(boxes: DataFrame) -> DataFrame:
    """(video_id, frame_id, cx, cy) of the box chosen in each frame, the last choice kept as state between batches.

    A frame's boxes must arrive in one batch, and frames in order; within a batch they are sorted.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["frame_id", "det_ord"])
        last = state.get if state.exists else None
        out = []
        for frame, own in rows.groupby("frame_id"):
            last, _ = choose(own[["x1", "y1", "x2", "y2"]].to_numpy(), last)
            out.append((key[0], frame, *last))
        state.update(last)
        yield pd.DataFrame(out, columns=["video_id", "frame_id", "cx", "cy"])

    return B.scan_boxes(boxes).groupBy("video_id").applyInPandasWithState(advance, "video_id int, frame_id long, cx double, cy double", "cx double, cy double", "append", GroupStateTimeout.NoTimeout)


def run_complete(counts: DataFrame, place: str) -> DataFrame:
    """Runs a stream in complete mode over what is there and gives its last result, written to ``place``."""
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/result"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.parquet(f"{place}/result")
