"""Fit several models over a trajectory table; peaks and an exponential fit in one go."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.operators import asof, fits, series
from medloom.operators.fits import MODELS
from medloom.operators.ordered import ROWS_PER_TASK
from medloom.session import cut_lineage


def fit_models(
    points: DataFrame, models: Sequence[str] = ("EX", "SQ", "BI", "FH"), ids: DataFrame | None = None,
    offset: float = 0.0,
) -> dict[str, DataFrame]:
    """Per model one table: traj_id, parameters, their standard errors, and the error statistics.

    ``ids`` (one column ``traj_id``) limits the work to some trajectories.
    """
    if ids is not None:
        points = points.join(ids.select("traj_id"), "traj_id", "left_semi")
    points = cut_lineage(points)
    out = {}
    for name in models:
        model = MODELS[name]
        best = fits.fit(points, model, offset)
        errors = fits.standard_errors(points, best, model, offset)
        stats = fits.fit_statistics(fits.residual_rows(points, best, model, offset), model)
        out[name] = cut_lineage(best.drop("sse").join(errors, "traj_id", "left").join(stats, "traj_id", "left"))
    return out


def wide_table(points: DataFrame, fitted: dict[str, DataFrame], lab: str) -> DataFrame:
    """One row per trajectory, columns ``param_MODEL_LAB``, ``param_stderr_MODEL_LAB``, ``stat_MODEL_LAB``.

    A trajectory that a model could not fit has nulls there.
    """
    ids = points.select("traj_id").distinct()
    parts = [
        table.withColumnsRenamed({c: f"{c}_{name}_{lab}" for c in table.columns if c != "traj_id"})
        for name, table in fitted.items()
    ]
    return reduce(lambda a, b: a.join(b, "traj_id", "left"), parts, ids)


def long_table(fitted: dict[str, DataFrame]) -> DataFrame:
    """(traj_id, model, name, value): parameters, standard errors and statistics of all models."""
    parts = [
        table.unpivot("traj_id", [c for c in table.columns if c != "traj_id"], "name", "value").select(
            "traj_id", F.lit(model).alias("model"), "name", F.col("value").cast("double").alias("value")
        )
        for model, table in fitted.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def rolling_tracks(
    points: DataFrame, rate: float = 0.44, rate_low: float = 0.35, rate_high: float = 0.8, delta_EX: bool = True,
    eval_C: bool = True, eval_C_d: bool = True, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(traj_id, pos, ...): what each point and the next ones say by themselves, for the points that have next ones.

    ``delta_EX``, ``delta_EX_LL``, ``delta_EX_UL``: the next value less what decay without a source leaves of this one,
    at three rates. ``C_track2``: the source that explains the pair at ``rate``. ``C_track3``, ``d_track3``: source and
    rate over three points, first value fixed; ``sse_track3`` is its error.
    """
    keys, tracks = ["traj_id"], []
    if delta_EX:
        tracks.append(series.excess_over_decay(points, keys, rate, 0, rate_high, rate_low, "pos", rows_per_task).select(
            "traj_id", "pos", F.col("delta").alias("delta_EX"), F.col("delta_low").alias("delta_EX_LL"),
            F.col("delta_high").alias("delta_EX_UL")))
    if eval_C:
        pairs = series.two_point_source(points, keys, rate, "pos", rows_per_task)
        tracks.append(pairs.withColumnRenamed("C", "C_track2"))
    if eval_C_d:
        triples = series.three_point_track(points, keys, "pos", rows_per_task)
        tracks.append(triples.withColumnsRenamed({"C": "C_track3", "d": "d_track3", "sse": "sse_track3"}))
    if not tracks:
        raise ValueError("no track asked for")
    # A track of pairs has all positions that a track of triples has, so it comes first where there is one.
    return reduce(lambda a, b: a.join(b, ["traj_id", "pos"], "left"), tracks)


def with_tracks(wide: DataFrame, tracks: DataFrame, lab: str) -> DataFrame:
    """The wide table with one row per trajectory and position; trajectories without a track have one row of nulls."""
    named = tracks.withColumnsRenamed({c: f"{c}_{lab}" for c in tracks.columns if c not in ("traj_id", "pos")})
    return wide.join(named, "traj_id", "left")


class PeakFits(NamedTuple):
    """``table``: one row per segment that meets the criteria, with its ``outcome`` (first, second or failed), named
    parameters with their errors, error statistics and ends. ``points`` are those the outcome stands on, ``curves``
    the fitted ones at 50 times, ``counts`` one row."""

    table: DataFrame
    points: DataFrame
    curves: DataFrame
    counts: DataFrame


def _chosen_near(dates: DataFrame, keys: list[str], date_column: str, within_days: float):
    date_keys = [k for k in keys if k in dates.columns]
    return lambda peaks: asof.near_any_date(peaks, dates, date_keys, "peak_t", date_column, within_days)


def _segment_table(found: series.Peaks, keys: list[str], id_column: str) -> DataFrame:
    """(keys, peak_seq, traj_id, pos, t, x, n, first t and x) of all segments."""
    rows = series.segment_points(found, keys)
    ends = rows.groupBy(*keys, "peak_seq").agg(
        F.min(F.struct("pos", "t", "x")).alias("_a"), F.max(F.struct("pos", "t", "x")).alias("_z"), F.count(F.lit(1)).alias("n"))
    traj_id = F.concat_ws("_", F.col(id_column).cast("string"), F.col("peak_seq").cast("string"))
    return rows.join(ends, [*keys, "peak_seq"]).withColumn("traj_id", traj_id)


def _attempt(points: DataFrame, offset: float, worst_nrmsd: float | None) -> DataFrame:
    """Fits that pass, with their statistics."""
    best = fits.fit(points, fits.EX, offset)
    rows = cut_lineage(fits.residual_rows(points, best, fits.EX, offset))
    errors = fits.fit_errors(rows, ["traj_id"])
    found = best.join(errors, "traj_id")
    return cut_lineage(found if worst_nrmsd is None else found.filter(F.coalesce(F.col("nRMSD") <= worst_nrmsd, F.lit(False))))


def fit_peaks(
    labs_table: DataFrame, keys: list[str], id_column: str, dates: DataFrame | None = None, date_column: str = "day",
    within_days: float = 28, min_points: int = 5, min_height: float = 150, prominence: float = 1, offset: float = 0.0,
    worst_nrmsd: float | None = None, tie: str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> PeakFits:
    """Peaks, the segments after them and an exponential fit of each, tried again with a cut tail where it fails.

    ``dates`` (keys and a day) keeps the peaks near one of the key's dates before segments are drawn. A segment needs
    more than ``min_points`` points and a first value above ``min_height``. An attempt fails when there is no fit, or,
    with ``worst_nrmsd``, when the fit's nRMSD is beyond it. What failed is tried once more without its long tail, if
    points go and more than ``min_points`` stay (``series.cut_tail``); where that fails too, all points are kept and
    the parameters are null. The ends in the table are those of the whole segment.
    """
    choose = None if dates is None else _chosen_near(dates, keys, date_column, within_days)
    found = series.find_peaks(
        labs_table, keys, prominence, min_height, edge=True, rows_per_task=rows_per_task, tie=tie, choose=choose)
    found = found._replace(peaks=cut_lineage(found.peaks))
    rows = _segment_table(found, keys, id_column)
    whole = cut_lineage(rows.filter((F.col("n") > min_points) & (F.col("_a.x") > min_height)).select(
        *keys, "peak_seq", "traj_id", "pos", (F.col("t") - F.col("_a.t")).alias("t"), "x", F.col("_a.t").alias("t0"),
        F.col("_z.t").alias("tf"), F.col("_a.x").alias("x0"), F.col("_z.x").alias("xf"), "n"))
    first = _attempt(whole.select("traj_id", "pos", "t", "x"), offset, worst_nrmsd)
    failed = whole.join(first.select("traj_id"), "traj_id", "left_anti")
    cut = series.cut_tail(failed, ["traj_id"], min_points, rows_per_task)
    shorter = cut.groupBy("traj_id").agg(F.count(F.lit(1)).alias("_left"))
    shorter = shorter.join(whole.filter("pos = 0").select("traj_id", "n"), "traj_id").filter("_left < n")
    cut = cut_lineage(cut.join(shorter.select("traj_id"), "traj_id", "left_semi").select("traj_id", "pos", "t", "x"))
    second = _attempt(cut, offset, worst_nrmsd)
    passed = first.withColumn("outcome", F.lit("first")).unionByName(second.withColumn("outcome", F.lit("second")))
    passed = cut_lineage(passed)
    kept = cut.join(second.select("traj_id"), "traj_id", "left_semi")
    points = whole.join(second.select("traj_id"), "traj_id", "left_anti").select("traj_id", "pos", "t", "x")
    points = cut_lineage(points.unionByName(kept))
    fitted = passed.drop("outcome", "qerr", "MAPE", "nRMSD")
    errors = fits.standard_errors(points.join(passed.select("traj_id"), "traj_id", "left_semi"), fitted, fits.EX, offset)
    used = points.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_used"))
    ends = whole.filter("pos = 0").select(
        *keys, F.col("peak_seq").alias("peak"), "traj_id", "t0", "tf", (F.col("tf") - F.col("t0")).alias("tlen"), "x0", "xf", "n")
    table = ends.join(used, "traj_id").join(passed, "traj_id", "left").join(errors, "traj_id", "left")
    table = cut_lineage(table.withColumn("outcome", F.coalesce("outcome", F.lit("failed"))))
    curves = fits.highres_curve(points.withColumn("t", F.col("t") + F.lit(float(offset))), fitted, fits.EX)
    peaks = found.peaks.agg(F.count(F.lit(1)).alias("num_peaks"))
    fit_count = table.agg(
        F.count(F.lit(1)).alias("num_meeting_traj_criteria"), F.count_if(F.col("outcome") != "failed").alias("num_fit"),
        F.count_if(F.col("outcome") == "second").alias("num_fit_after_cut"))
    # Both are one row.
    return PeakFits(table, points, curves, peaks.crossJoin(F.broadcast(fit_count)))


def peaks_and_fit(
    labs_table: DataFrame, keys: list[str], id_column: str, dates: DataFrame | None = None, date_column: str = "day",
    within_days: float = 28, min_points: int = 5, min_height: float = 150, prominence: float = 1,
    include_trough: bool = False, tie: str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """(fits, points) of the exponential model on every peak-to-trough segment with at least ``min_points`` points.

    ``dates`` (keys and a day) keeps the peaks near one of the key's dates before segments are drawn.
    """
    choose = None if dates is None else _chosen_near(dates, keys, date_column, within_days)
    found = series.find_peaks(
        labs_table, keys, prominence, min_height, edge=True, include_trough=include_trough, min_points=min_points,
        rows_per_task=rows_per_task, tie=tie, choose=choose,
    )
    points = cut_lineage(_segment_table(found, keys, id_column).select(
        *keys, "peak_seq", "traj_id", "pos", (F.col("t") - F.col("_a.t")).alias("t"), "x"))
    return fits.fit(points, fits.EX), points
