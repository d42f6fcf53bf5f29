"""Files around the tables: saved detections, truth files, recorded responses, masks and frame arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.operators.labelling import parse_truth_cell

BOX_SCHEMA = "video_id int, frame_id long, det_ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, cluster_id int"


def save_detections(boxes: DataFrame, path: str, module: str = "detect", version: str = "base") -> None:
    """Overwrites the saved boxes of one module and version; reading them again prunes by both and by video."""
    boxes.write.mode("overwrite").partitionBy("video_id").parquet(f"{path}/module={module}/version={version}")


def load_detections(spark: SparkSession, path: str, module: str = "detect", version: str = "base") -> DataFrame:
    """The saved boxes of a module and version; none, with the schema, if they were never saved."""
    place = f"{path}/module={module}/version={version}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(place)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], BOX_SCHEMA)
    return spark.read.parquet(place)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(artifact_id, label, is_primary) of truth files, one per artifact, of lines ``label, truthy`` without a header."""
    rows = spark.read.csv(path, schema="label string, cell string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.csv$", "")
    return rows.where("label is not null").select(F.url_decode(stem).alias("artifact_id"), F.upper(F.trim("label")).alias("label"), parse_truth_cell(F.col("cell")).alias("is_primary"))


def read_responses(spark: SparkSession, path: str, vendor: str) -> DataFrame:
    """(artifact_id, vendor, body) of recorded responses, one JSON file per artifact; a stored null is no body."""
    files = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    return files.select(F.url_decode(stem).alias("artifact_id"), F.lit(vendor).alias("vendor"), F.nullif(F.trim("value"), F.lit("null")).alias("body"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(origin, x, y) of the fully transparent pixels of images with an alpha channel; others have none."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def pixels(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.nChannels == 4:
                    alpha = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4)[:, :, 3]
                    y, x = np.nonzero(alpha == 0)
                    out.append(pd.DataFrame({"origin": r.origin, "x": x, "y": y}))
            yield pd.concat(out) if out else pd.DataFrame({"origin": pd.Series(dtype=str), "x": pd.Series(dtype=int), "y": pd.Series(dtype=int)})

    return images.mapInPandas(pixels, "origin string, x int, y int")


def find_videos(spark: SparkSession, *places: str, extension: str = ".mp4") -> DataFrame:
    """(video_id, path) of the files with an extension among the given files and folders, numbered by path. Only names
    are listed; folders are not entered further, and what does not exist is passed over."""
    sc = spark.sparkContext
    paths = []
    for place in places:
        p = sc._jvm.org.apache.hadoop.fs.Path(place)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(p):
            paths += [s.getPath().toUri().getPath() for s in fs.listStatus(p) if s.isFile()]
    return spark.createDataFrame(list(enumerate(sorted(x for x in set(paths) if x.endswith(extension)))), "video_id int, path string")


PRESENTATION = "artifact_id string, img_idx int, image binary, text string"


def save_presentations(presentations: DataFrame, path: str) -> None:
    """Writes (artifact_id, img_idx, image, text): the pictures of sections in order with their metadata text. Those of
    an artifact that is there already are replaced at the next reading, which takes the last written."""
    presentations.select("artifact_id", "img_idx", "image", "text", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(path)


def load_presentations(artifacts: DataFrame, path: str) -> DataFrame:
    """(artifact_id, images, text) of the given artifacts, by their exact ids, the pictures in the order of ``img_idx``;
    artifacts without a picture or a text are missing, as are all where nothing was saved."""
    spark = artifacts.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "artifact_id string, images array<binary>, text string")
    rows = spark.read.parquet(path).join(artifacts.select("artifact_id").distinct(), "artifact_id")
    last = rows.join(rows.groupBy("artifact_id").agg(F.max("saved_at").alias("saved_at")), ["artifact_id", "saved_at"])
    shown = last.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("img_idx", "image")))).alias("i"), F.max("text").alias("text"))
    return shown.where("size(i) > 0 and text is not null").select("artifact_id", F.col("i.image").alias("images"), "text")


class FrameArrays(DataSource):
    """``npy_frames``: boxes from NumPy files of one structured array per frame.

    Such files are pickles, which run code when they are read: only for files that are trusted, hence the option
    ``trusted`` must be 'true'. Option ``paths`` lists files by commas; a file's place in it is its video_id. Files
    without a ``cluster`` field load with cluster -1, missing files as no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return BOX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("trusted") != "true":
            raise ValueError("npy_frames reads pickles; set the option trusted to 'true' for files you trust")
        return _FrameArrayReader(self.options["paths"].split(","))


class _FrameArrayReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition):
        import os

        video, path = partition.value
        if not os.path.exists(path):
            return
        for frame, rows in enumerate(np.load(path, allow_pickle=True)):
            for i, r in enumerate(np.atleast_1d(rows)):
                cluster = int(r["cluster"]) if "cluster" in r.dtype.names else -1
                yield (video, frame, i, *map(float, r["bbox"]), float(r["confidence"]), int(r["class"]), cluster)
