"""Covered periods and gaps of overlapping intervals by a sweep over their boundaries.

Every interval gives a plus event where it begins and a minus event behind its end. Events are added up by
position before they are shuffled for the sweep; the running sum is taken block by block of ``BLOCK``
positions, with the sum of the blocks before carried in, so a key with very many intervals is spread over as
many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536  #: positions that one task sweeps


def sweep(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, kind, first, last): ``period`` rows, maximal stretches covered by the intervals (both ends
    inclusive, neighbouring positions join), and a ``gap`` row between two successive periods of a key.

    Rows with a null in a key or an end, and rows whose end comes before their start, cover nothing.
    Repeated rows change nothing; an empty table gives an empty result.
    """
    ends = df.where(F.col(first) <= F.col(last))
    for k in keys:
        ends = ends.where(F.col(k).isNotNull())
    event = lambda at, change: F.struct(at.cast("long").alias("at"), F.lit(change).cast("long").alias("change"))
    events = (
        ends.select(*keys, F.explode(F.array(event(F.col(first), 1), event(F.col(last) + 1, -1))).alias("e"))
        .select(*keys, "e.*")
        .groupBy(*keys, "at")
        .agg(F.sum("change").alias("change"))
        .where("change <> 0")
        .withColumn("block", F.floor(F.col("at") / BLOCK))
    )
    blocks = events.groupBy(*keys, "block").agg(F.sum("change").alias("sum"))
    carried = blocks.withColumn("carry", F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    within = Window.partitionBy(*keys, "block").orderBy("at")
    edges = (
        events.join(carried, [*keys, "block"])
        .withColumn("active", F.col("carry") + F.sum("change").over(within))
        .where((F.col("active") == 0) | (F.col("active") == F.col("change")))
        .withColumn("next", F.lead("at").over(within))
    )
    heads = edges.groupBy(*keys, "block").agg(F.min("at").alias("head"))
    following = heads.withColumn("follows", F.lead("head").over(Window.partitionBy(*keys).orderBy("block"))).drop("head")
    return (
        edges.join(following, [*keys, "block"])
        .withColumn("next", F.coalesce("next", "follows"))
        .where(F.col("next").isNotNull())
        .select(*keys, F.when(F.col("active") == 0, "gap").otherwise("period").alias("kind"), F.col("at").alias("first"), (F.col("next") - 1).alias("last"))
    )


def restore_frames(frame: Column, ms: Column, fps: int = 30) -> Column:
    """The frame, or if it is null the one whose floor(frame * 1000 / fps) is the given millisecond."""
    return F.coalesce(frame, F.ceil(ms * fps / F.lit(1000.0)).cast("long"))


def label_intervals(cluster_metadata: DataFrame) -> DataFrame:
    """(video_id, box_label, a, b): the usable intervals, labels trimmed and in upper case, ends in order."""
    a = restore_frames(F.col("start_frame"), F.col("start_ms"))
    b = restore_frames(F.col("end_frame"), F.col("end_ms"))
    return (
        cluster_metadata.select("video_id", F.upper(F.trim("box_label")).alias("box_label"), a.alias("s"), b.alias("e"))
        .where("s is not null and e is not null")
        .select("video_id", "box_label", F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b"))
    )


def label_periods(cluster_metadata: DataFrame) -> DataFrame:
    """(video_id, box_label, kind, first_frame, last_frame) of every covered period and gap of a label.

    A null frame is restored from its milliseconds, exchanged ends are put right, an interval that lacks an
    end in both units is ignored, and so is one without video or label (a blank label is the label '').
    """
    return sweep(label_intervals(cluster_metadata), ["video_id", "box_label"], "a", "b").withColumnsRenamed({"first": "first_frame", "last": "last_frame"})
