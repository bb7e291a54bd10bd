"""Writers of fit tables and trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.plans.trajectories import Trajectories


def write_fits(fits: DataFrame, statistics: DataFrame, folder: str, prefix: str, mode: str = "errorifexists") -> None:
    """Fit parameters as CSV with a header, run statistics as JSON lines, both as folders of part files."""
    fits.write.mode(mode).option("header", True).csv(f"{folder}/{prefix}_param_fits")
    statistics.write.mode(mode).json(f"{folder}/{prefix}_loopfit_stats")


def write_trajectories(built: Trajectories, lab_column: str, folder: str, mode: str = "errorifexists") -> None:
    """Points and metadata as Parquet, partitioned by lab, and the run's metadata."""
    built.points.write.mode(mode).partitionBy(lab_column).parquet(f"{folder}/traj_points")
    built.meta.write.mode(mode).partitionBy(lab_column).parquet(f"{folder}/traj_meta")
    built.run_meta.write.mode(mode).parquet(f"{folder}/run_meta")


def replace_trajectories(built: Trajectories, lab_column: str, folder: str) -> str:
    """Write the trajectories of some labs in place of what the folder has of these labs; other labs stay.

    Points and metadata go to folders of their own (lab, run). Only then a commit row per lab is replaced, by dynamic
    partition overwrite, and readers take the committed run of each lab. So a run that fails on the way changes nothing
    that readers see, and running it again replaces its own labs only. Files of earlier runs stay until they are
    removed. Returns the name of the run.
    """
    # The letter keeps partition discovery from reading it as a number.
    run = "r" + uuid.uuid4().hex
    marked = F.lit(run)
    built.points.withColumn("run", marked).write.mode("append").partitionBy(lab_column, "run").parquet(f"{folder}/traj_points")
    built.meta.withColumn("run", marked).write.mode("append").partitionBy(lab_column, "run").parquet(f"{folder}/traj_meta")
    named = built.run_meta.first()["lab"]
    # Without a choice of labs these are the ones that have trajectories.
    labs = built.meta.select(lab_column).distinct() if named is None else built.run_meta.select(
        F.explode(F.split("lab", ",")).alias(lab_column))
    commits = labs.crossJoin(F.broadcast(built.run_meta.drop("lab"))).withColumn("run", marked)
    writer = commits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(lab_column).parquet(f"{folder}/commits")
    return run


def read_trajectories(spark: SparkSession, lab_column: str, folder: str) -> Trajectories:
    """The committed run of each lab; ``run_meta`` has one row per lab."""
    commits = spark.read.parquet(f"{folder}/commits")
    # The columns of a commit are those of its run's counts and settings; run and lab choose the folders to read.
    chosen = commits.select(lab_column, "run")
    points = spark.read.parquet(f"{folder}/traj_points").join(chosen, [lab_column, "run"], "left_semi").drop("run")
    meta = spark.read.parquet(f"{folder}/traj_meta").join(chosen, [lab_column, "run"], "left_semi").drop("run")
    return Trajectories(points, meta, commits)


def write_with_rejects(accepted: DataFrame, rejected: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    accepted.write.mode(mode).parquet(f"{folder}/accepted")
    rejected.write.mode(mode).parquet(f"{folder}/rejected")
