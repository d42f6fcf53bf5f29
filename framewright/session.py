"""Session helpers: a local session for tests and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and ``bench.py`` use it; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):  # one machine, as in tests: its folder goes with the process
        place = tempfile.mkdtemp(prefix="framewright-ckpt-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        sc.setCheckpointDir(place)
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def shared_place(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut there.

    Used where several branches read one intermediate result or an iteration would grow the plan; the
    files survive the loss of any executor. They are removed when the result is no longer referred to, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` set, as ``local_session`` does and a cluster should.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
