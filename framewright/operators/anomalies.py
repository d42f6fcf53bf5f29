"""Implausible readings in per-source series: impossible, stuck and spiking values.

A source is one series of readings ordered by a frame number. Long sources are cut into blocks of
``BLOCK`` frames with a halo on both sides, so no task ever holds a whole source; what is normal for a
source is gathered from block summaries (histograms of steps and of run lengths).

Method: a robust seasonal-trend decomposition per block (running-median trend, median seasonal profile when
the autocorrelation shows a period) leaves residuals; those beyond the generalised extreme studentised
deviate limits are the candidates for spikes, which are then held against the source's largest usual step.
Constant runs and ranges are separate checks.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut

BLOCK = 4096  #: frames of a block
HALO = 96  #: frames a block sees beyond either edge
MIN_STUCK = 12  #: readings of the shortest stuck run
STUCK_FACTOR = 4  #: a stuck run against the longest normal hold
SPIKE_FACTOR = 7.0  #: a spike against the largest usual step
SPIKE_READINGS = 3  #: readings of the longest spike
GESD_ALPHA = 0.05
TREND_WINDOW = 9  #: readings of the running median; more than twice SPIKE_READINGS
STEP_GAP = 2.5  #: ratio between neighbouring step sizes that ends the usual ones
STEP_BINS = 16  #: bins of the step histogram to an octave


def student_quantile(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Quantiles of Student's t by the Cornish-Fisher expansion around the normal quantile."""
    z = np.array([NormalDist().inv_cdf(float(x)) for x in np.atleast_1d(p)])
    v = np.maximum(np.atleast_1d(dof).astype(float), 3.0)
    return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)


@lru_cache(maxsize=4096)
def _gesd_limits(n: int, alpha: float) -> np.ndarray:
    """The critical deviates of 1 to n // 2 outliers among n values; computed at 64 of them, straight lines between."""
    k = n // 2
    probe = np.unique(np.geomspace(1, k, 64).astype(int)) - 1
    left = n - probe
    t = student_quantile(1 - alpha / (2 * left), left - 2)
    return np.interp(np.arange(k), probe, (left - 1) * t / np.sqrt((left - 2 + t * t) * left))


def gesd(residual: np.ndarray, alpha: float = GESD_ALPHA) -> np.ndarray:
    """Mask of the outliers by the generalised extreme studentised deviate test.

    Deviates are taken from the median in falling order; the mean and deviation of what remains come from
    cumulative sums, so up to half of the values can be outliers at the cost of one sort.
    """
    n = len(residual)
    out = np.zeros(n, bool)
    if n < 8:
        return out
    centred = residual - np.median(residual)
    order = np.argsort(-np.abs(centred), kind="stable")
    x = centred[order]
    k = n // 2
    tail_n = n - np.arange(k)
    s1 = np.cumsum(x[::-1])[::-1][:k]
    s2 = np.cumsum((x * x)[::-1])[::-1][:k]
    mean = s1 / tail_n
    sd = np.sqrt(np.maximum((s2 - s1 * mean) / np.maximum(tail_n - 1, 1), 0))
    deviate = np.abs(x[:k] - mean) / np.maximum(sd, 1e-12)
    deviate[np.abs(x[:k]) < 1e-9] = 0
    limit = _gesd_limits(n, alpha)
    passed = np.flatnonzero(deviate > limit)
    if len(passed):
        out[order[: passed[-1] + 1]] = True
    return out


def running_median(x: np.ndarray, window: int = TREND_WINDOW) -> np.ndarray:
    half = window // 2
    padded = np.concatenate([x[1 : half + 1][::-1], x, x[-half - 1 : -1][::-1]]) if len(x) > half else np.pad(x, half, mode="edge")
    return np.partition(np.lib.stride_tricks.sliding_window_view(padded, window), half, axis=1)[:, half]


def decompose(x: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust trend, season and residual. The trend is a running median, which keeps level changes sharp;
    the season is the median residual by phase of the period with the clearest autocorrelation, if any."""
    trend = running_median(x)
    rest = x - trend
    season = np.zeros_like(x)
    n = len(x)
    if n >= 64:
        spread = np.median(np.abs(rest - np.median(rest)))
        if spread > 0:
            clipped = np.clip(rest, -3 * spread, 3 * spread)
            size = 1 << (2 * n - 1).bit_length()
            spectrum = np.fft.rfft(clipped - clipped.mean(), size)
            acf = np.fft.irfft(spectrum * np.conj(spectrum), size)[: n // 4]
            if len(acf) > 8 and acf[0] > 0:
                lag = 4 + int(np.argmax(acf[4:]))
                if acf[lag] / acf[0] > 0.5:
                    phase = frame % lag
                    by_phase = pd.Series(rest).groupby(phase).median()
                    season = by_phase.reindex(phase).to_numpy()
    return trend, season, x - trend - season


def runs_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal rows."""
    n = len(values)
    change = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    first = np.concatenate([[0], change]).astype(int)
    return first, np.diff(np.concatenate([first, [n]]))


def spacing(frame: np.ndarray) -> int:
    """The commonest distance in frames between successive readings, the smallest of equally common ones."""
    gap, count = np.unique(np.diff(frame), return_counts=True)
    return int(gap[count.argmax()]) if len(gap) else 1


def spike_candidates(values: np.ndarray, frame: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first index, readings, least deviation from the path, drift to a frame over it) of each short excursion.

    The path over an excursion is the straight line between the readings on both sides of it. Excursions that
    stay below SPIKE_FACTOR median steps are left out: the largest usual step is no smaller than the median.
    """
    n = len(values)
    if n < TREND_WINDOW:
        return []
    residual = np.sqrt(sum(decompose(values[:, c], frame)[2] ** 2 for c in range(values.shape[1])))
    mask = gesd(residual)
    step = np.sqrt((np.diff(values, axis=0) ** 2).sum(axis=1))[np.diff(frame) == spacing(frame)]
    step = step[step > 0]
    least = SPIKE_FACTOR * (np.median(step) if len(step) else 0.0)
    found = []
    for k in range(1, SPIKE_READINGS + 1):
        inside = np.lib.stride_tricks.sliding_window_view(mask, k).all(axis=1)
        a = np.flatnonzero(inside)
        a = a[(a > 0) & (a + k < n)]
        if not len(a):
            continue
        p, q = a - 1, a + k
        span = (frame[q] - frame[p]).astype(float)
        move = values[q] - values[p]
        off = np.full(len(a), np.inf)
        for j in range(k):
            share = ((frame[a + j] - frame[p]) / span)[:, None]
            off = np.minimum(off, np.sqrt(((values[a + j] - (values[p] + share * move)) ** 2).sum(axis=1)))
        drift = np.sqrt((move**2).sum(axis=1)) / span
        keep = (off > 0) & (off >= least) & (off >= SPIKE_FACTOR * drift)
        found += list(zip(a[keep].tolist(), [k] * int(keep.sum()), off[keep].tolist(), drift[keep].tolist()))
    return found


def usual_steps(values: np.ndarray, frame: np.ndarray, excursions: list[tuple[int, int, float, float]]) -> np.ndarray:
    """Steps from a reading to the next one at the block's usual spacing (of one frame, in a dense source), without
    those at excursions and at long constant runs."""
    n = len(values)
    odd = np.zeros(n, bool)
    for a, k, _, _ in excursions:
        odd[a : a + k] = True
    _, length = runs_of_equal(values)
    odd |= np.repeat(length >= MIN_STUCK, length)
    step = np.sqrt((np.diff(values, axis=0) ** 2).sum(axis=1))
    return np.where((np.diff(frame) == spacing(frame)) & ~odd[1:] & ~odd[:-1] & (step > 0), step, np.nan)


_SUMMARY = "metric string, block long, what string, first long, last long, n long, v1 double, v2 double, least double, edge int"


def _summarise(metric: str, block: int, frame: np.ndarray, values: np.ndarray, size: int) -> list[tuple]:
    """What one block of one source tells: step histogram, run lengths, long and edge runs, short excursions."""
    core = frame // size == block
    out: list[tuple] = []
    excursions = spike_candidates(values, frame)
    for a, k, off, drift in excursions:
        if core[a]:
            out.append((metric, block, "spike", frame[a], frame[a + k - 1], k, off, drift, None, 0))
    if len(values) > 1:
        step = usual_steps(values, frame, excursions)
        step = np.sort(step[core[1:] & ~np.isnan(step)])
        if len(step):
            place = np.floor(np.log2(step) * STEP_BINS).astype(int)
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.concatenate([edge[1:], [len(step)]]) - 1
            out += [(metric, block, "step", b, 0, c, t, None, lo, 0) for b, c, t, lo in zip(place[edge].tolist(), (last - edge + 1).tolist(), step[last].tolist(), step[edge].tolist())]
    own, own_frame = values[core], frame[core]
    if len(own):
        first, length = runs_of_equal(own)
        last = first + length - 1
        ends = {0, len(first) - 1}
        for i in sorted(ends | set(np.flatnonzero(length >= MIN_STUCK).tolist())):
            out.append((metric, block, "edge" if i in ends else "run", own_frame[first[i]], own_frame[last[i]], length[i], own[first[i], 0], own[first[i], -1], None, int(i > 0)))
        if len(first) > 2:
            count = np.bincount(length[1:-1])
            out += [(metric, block, "length", n, 0, count[n], None, None, None, 0) for n in np.flatnonzero(count).tolist()]
    return out


def _block_summaries(batches, size: int):
    """The summaries of blocks of rows sorted by source, block and frame; a block may lie over several batches."""
    held: list[pd.DataFrame] = []
    key = None
    names = ["video_id", *[x.split()[0] for x in _SUMMARY.split(", ")]]

    def close(out: list) -> None:
        rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        frame = rows["frame_id"].to_numpy()
        x, y, a, off = (rows[c].to_numpy(dtype=float) for c in ("x", "y", "a", "off"))
        off = off.astype(int)
        for metric, ok, values in (("poi", ~np.isnan(x) & ~np.isnan(y) & (off & 1 == 0), (x, y)), ("aoi", ~np.isnan(a) & (off & 2 == 0), (a,))):
            if ok.any():
                out += [(key[0], *r) for r in _summarise(metric, int(key[1]), frame[ok], np.column_stack([v[ok] for v in values]), size)]

    for batch in batches:
        out: list[tuple] = []
        if len(batch):
            video, block = batch["video_id"].to_numpy(), batch["block"].to_numpy()
            cuts = np.flatnonzero((video[1:] != video[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                this = (video[lo], block[lo])
                if this != key and held:
                    close(out)
                    held.clear()
                key = this
                held.append(batch.iloc[lo:hi])
        yield pd.DataFrame(out, columns=names).astype({"first": "Int64", "last": "Int64", "n": "Int64", "edge": "Int32", "block": "Int64"})
    if held:
        out = []
        close(out)
        yield pd.DataFrame(out, columns=names).astype({"first": "Int64", "last": "Int64", "n": "Int64", "edge": "Int32", "block": "Int64"})


def frame_readings(interests: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, frame_id, x, y, a, off): one row per source and frame; ``off`` has bit 1 if the point and bit 2 if the
    area is impossible. A point with a null coordinate is no reading, nor is a null area.

    Rows of the same source and frame are read once (the largest, should they differ). A source that
    ``videos`` lacks has no frame size; only NaN, negative coordinates and areas that are not positive are
    impossible there.
    """
    one = (
        interests.select("video_id", F.col("frame_id").cast("long").alias("frame_id"), "poi_x", "poi_y", "aoi")
        .where(F.col("video_id").isNotNull() & F.col("frame_id").isNotNull())
        .groupBy("video_id", "frame_id")
        .agg(F.max(F.struct("poi_x", "poi_y", "aoi")).alias("r"))
    )
    size = videos.groupBy("video_id").agg(F.max("width").cast("double").alias("w"), F.max("height").cast("double").alias("h"))
    x, y, a, w, h = F.col("r.poi_x"), F.col("r.poi_y"), F.col("r.aoi"), F.col("w"), F.col("h")
    beyond = lambda v, top: F.isnan(v) | (v < 0) | F.coalesce(v > top, F.lit(False))
    point = x.isNotNull() & y.isNotNull() & (beyond(x, w) | beyond(y, h))
    size_off = a.isNotNull() & (F.isnan(a) | (a <= 0) | F.coalesce(a > w * h, F.lit(False)))
    off = point.cast("int") + size_off.cast("int") * 2
    return one.join(size, "video_id", "left").select("video_id", "frame_id", x.alias("x"), y.alias("y"), a.alias("a"), off.alias("off"))


def _source_limits(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source the largest usual step; and every run of at least MIN_STUCK with the source's normal hold."""
    source = ["video_id", "metric"]
    bins = summary.where("what = 'step'").groupBy(*source, F.col("first").alias("bin")).agg(F.sum("n").alias("n"), F.max("v1").alias("top"), F.min("least").alias("low"))
    along = Window.partitionBy(*source).orderBy("bin")
    usual = (
        bins.withColumn("share", F.sum("n").over(along) / F.sum("n").over(Window.partitionBy(*source)))
        .withColumn("next", F.lead("low").over(along))
        .where((F.col("share") >= 0.9) & (F.col("next").isNull() | (F.col("next") >= STEP_GAP * F.col("top"))))
        .groupBy(*source)
        .agg(F.min("top").alias("usual_step"))
    )
    edges = summary.where("what = 'edge'")
    order = Window.partitionBy(*source).orderBy("block", "edge")
    before = lambda c: F.lag(c).over(order)
    stitched = (
        edges.withColumn("new", F.when((F.col("edge") == 0) & (before("v1") == F.col("v1")) & (before("v2") == F.col("v2")), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order))
        .groupBy(*source, "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .select(*source, "first", "last", "n")
    )
    runs = stitched.unionByName(summary.where("what = 'run'").select(*source, "first", "last", "n"))
    lengths = stitched.select(*source, F.col("n").alias("length")).unionByName(summary.where("what = 'length'").select(*source, F.col("first").alias("length"))).distinct()
    normal = (
        lengths.withColumn("next", F.lead("length").over(Window.partitionBy(*source).orderBy("length")))
        .where(F.col("next") >= F.greatest(F.lit(MIN_STUCK), STUCK_FACTOR * F.col("length")))
        .groupBy(*source)
        .agg(F.min("length").alias("hold"))
    )
    stuck = runs.join(normal, source).where((F.col("n") >= MIN_STUCK) & (F.col("n") >= STUCK_FACTOR * F.col("hold"))).select(*source, "first", "last")
    return usual, stuck


def _by_block(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, last div {BLOCK})")))


def implausible_readings(interests: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, frame_id, metric, kind) of every impossible, stuck or spiking reading.

    ``impossible`` goes before ``stuck`` and ``stuck`` before ``spike``. Null readings, null keys and repeated
    rows give nothing; an empty table gives an empty result; other columns of the inputs are ignored. A source
    with fewer than TREND_WINDOW readings in a block and its halo has no spikes there; a source whose readings never differ has no normal
    hold, hence no stuck run.
    """
    readings = cut(frame_readings(interests, videos))
    block = F.expr(f"frame_id div {BLOCK}")
    with_halo = readings.withColumn(
        "block",
        F.explode(F.array_distinct(F.expr(f"array(frame_id div {BLOCK}, greatest(frame_id - {HALO}, 0) div {BLOCK}, (frame_id + {HALO}) div {BLOCK})"))),
    )
    n = int(interests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_halo.repartition(n, "video_id", "block").sortWithinPartitions("video_id", "block", "frame_id")
    size = BLOCK
    summary = cut(ordered.mapInPandas(lambda batches: _block_summaries(batches, size), f"video_id {dict(readings.dtypes)['video_id']}, {_SUMMARY}"))
    usual, stuck = _source_limits(summary)
    spikes = (
        summary.where("what = 'spike'")
        .join(usual, ["video_id", "metric"])
        .where((F.col("v1") >= SPIKE_FACTOR * F.col("usual_step")) & (F.col("v2") <= F.col("usual_step")))
        .select("video_id", "metric", "first", "last")
    )
    ranges = _by_block(stuck.withColumn("kind", F.lit("stuck")).unionByName(spikes.withColumn("kind", F.lit("spike"))))
    read = F.expr("case metric when 'poi' then x is not null and y is not null and off % 2 = 0 else a is not null and off < 2 end")
    hits = (
        readings.withColumn("block", block)
        .join(ranges, ["video_id", "block"])
        .where(F.col("frame_id").between(F.col("first"), F.col("last")) & read)
        .groupBy("video_id", "frame_id", "metric")
        .agg(F.max("kind").alias("kind"))  # "stuck" sorts after "spike"
    )
    bad = readings.where("off > 0").select("video_id", "frame_id", F.explode(F.expr("filter(array(if(off % 2 = 1, 'poi', null), if(off >= 2, 'aoi', null)), m -> m is not null)")).alias("metric"), F.lit("impossible").alias("kind"))
    return bad.unionByName(hits)
