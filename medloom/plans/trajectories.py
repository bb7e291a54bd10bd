"""From a laboratory table to peak-to-trough trajectories with their metadata."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.operators.ordered import ROWS_PER_TASK
from medloom.operators.series import (
    Screens, find_peaks, screen_segments, segment_points, trajectory_meta,
)
from medloom.session import cut_lineage


class Trajectories(NamedTuple):
    """``points`` (id, lab, traj_id, pos, t from 0, x), ``meta`` one row per trajectory, ``run_meta`` one row."""

    points: DataFrame
    meta: DataFrame
    run_meta: DataFrame


def build_trajectories(
    labs_table: DataFrame,
    id_column: str,
    lab_column: str,
    labs: list[str] | None = ("ALT",),
    min_points: int = 5,
    min_height: float = 150,
    prominence: float = 1,
    screens: Screens = Screens(),
    tie: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Trajectories:
    """Trajectories of all ids and labs at once from (id, lab, t, x[, tie]).

    The lab filter comes first so that it reaches the scan, which is read once: numbered points, peaks, screened points
    and trajectories are written to the checkpoint folder, and the counts come from these. Rows without id or lab
    belong to no series and are not counted.
    """
    if labs is not None:
        labs_table = labs_table.filter(F.col(lab_column).isin(list(labs)))
    keys = [id_column, lab_column]
    found = find_peaks(
        labs_table, keys, prominence, min_height, edge=True, mode="peak_to_min", strict=True,
        min_points=min_points, rows_per_task=rows_per_task, tie=tie,
    )
    found = found._replace(peaks=cut_lineage(found.peaks))
    segment = segment_points(found, keys)
    screened = cut_lineage(screen_segments(segment, keys, screens, min_points, min_height, rows_per_task))
    meta = cut_lineage(trajectory_meta(screened, keys, id_column))
    traj_id = F.concat_ws("_", F.col(id_column).cast("string"), F.col("peak_seq").cast("string"))
    starts = meta.select(*keys, "peak_seq", F.col("t0").alias("_t0"))
    points = screened.join(starts, [*keys, "peak_seq"]).select(
        *keys, "peak_seq", traj_id.alias("traj_id"), "pos", (F.col("t") - F.col("_t0")).alias("t"), "x"
    )
    # From tables that are there already: points, peaks and trajectories are each worked out once.
    counts = [
        found.points.filter("seq = 0").select(id_column).distinct().agg(F.count(F.lit(1)).alias("num_input_ids")),
        found.peaks.agg(F.count(F.lit(1)).alias("num_peaks")),
        meta.agg(F.count(F.lit(1)).alias("num_traj_meeting_criteria")),
    ]
    # Each count is one row.
    run_meta = counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2])).select(
        F.lit("peak_to_trough").alias("peak_finding_mode"),
        F.lit(None if labs is None else ",".join(labs)).cast("string").alias("lab"),
        "num_input_ids",
        "num_peaks",
        "num_traj_meeting_criteria",
        F.lit(min_points).alias("min_peak2trough"),
        F.lit(float(min_height)).alias("min_peak_height"),
        F.lit(float(prominence)).alias("prominence"),
        F.lit(screens.first_gap).alias("screen_first_gap"),
        F.lit(screens.steady_state).alias("screen_steady_state"),
        F.lit(screens.steady_state_cutoff).alias("screen_steady_state_cutoff"),
        F.lit(screens.long_tail).alias("screen_long_tail"),
    )
    return Trajectories(points, meta, run_meta)
