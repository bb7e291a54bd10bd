"""Binned statistics, fit errors and residual tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.operators.ordered import ROWS_PER_TASK, Rows, run_by_size, scan

STATISTICS = {
    "mean": lambda y: F.avg(y),
    "sum": lambda y: F.sum(y),
    "count": lambda y: F.count(y),
    "std": lambda y: F.stddev_pop(y),
    "min": lambda y: F.min(y),
    "max": lambda y: F.max(y),
    "sem": lambda y: F.stddev_pop(y) / F.sqrt(F.count(y)),
}


def binned(df: DataFrame, x: str, y: str, bins: int = 10, statistic: str = "mean") -> DataFrame:
    """(bin, center, stat) over equal-width bins of [min, max], the last one closed; empty bins are null."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    limits = points.agg(F.min(x).cast("double").alias("_min"), F.max(x).cast("double").alias("_max"))
    # A single value of x gets a range of one around it.
    half = F.when(F.col("_min") == F.col("_max"), 0.5).otherwise(0.0)
    limits = limits.select((F.col("_min") - half).alias("_lo"), (F.col("_max") + half).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # The limits are one row, so the broadcast does not grow with the data.
    place = F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    placed = points.crossJoin(F.broadcast(limits)).withColumn("bin", place)
    filled = placed.groupBy("bin").agg(STATISTICS[statistic](F.col(y)).alias("stat"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(limits))
    centers = edges.select("bin", (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("center"))
    return centers.join(filled, "bin", "left").select("bin", "center", "stat")


def fit_errors(
    residuals: DataFrame, keys: list[str], x: str = "x", residual: str = "residual", also: dict[str, Column] | None = None,
) -> DataFrame:
    """Range-normalised mean absolute error, mean absolute percentage error (a fraction) and normalised RMSD.

    A residual is model minus data. ``also``: further aggregates, worked out in the same pass.
    """
    also = also or {}
    data, r = F.col(x), F.col(residual)
    model = data + r
    sums = residuals.groupBy(*keys).agg(
        F.avg(F.abs(r)).alias("_mae"),
        F.avg(F.try_divide(F.abs(r), data)).alias("MAPE"),
        F.avg(r * r).alias("_mse"),
        F.max(F.greatest(data, model)).alias("_hi"),
        F.min(F.least(data, model)).alias("_lo"),
        F.max(data).alias("_xhi"),
        F.min(data).alias("_xlo"),
        *[column.alias(name) for name, column in also.items()],
    )
    return sums.select(
        *keys,
        F.try_divide(F.col("_mae"), F.col("_hi") - F.col("_lo")).alias("qerr"),
        "MAPE",
        F.try_divide(F.sqrt("_mse"), F.col("_xhi") - F.col("_xlo")).alias("nRMSD"),
        *also,
    )


def information_criteria(n: Column, sse: Column, parameters: int) -> dict[str, Column]:
    """chisqr, redchi, aic and bic of a least-squares fit with so many free parameters."""
    log = n * F.ln(F.when(sse > 0, sse) / n)
    return {
        "chisqr": sse,
        "redchi": F.try_divide(sse, F.when(n > parameters, n - parameters)),
        "aic": log + 2 * parameters,
        "bic": log + parameters * F.ln(n),
    }


def autocorrelation(
    points: DataFrame, keys: list[str], x: str = "x", lag: int = 1, position: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, R, z) of the lag-h autocorrelation; z = R * sqrt(n) for lag 1 only."""

    def build(rows: Rows) -> DataFrame:
        value = F.col(x)
        rows = scan(rows, whole={"_sum": (F.sum, value), "_n": (F.sum, F.lit(1))})
        df = rows.df.withColumn("_d", value - F.col("_sum") / F.col("_n")).select(*rows.parts, position, "_d", "_n")
        if rows.chunked:
            later = df.select(*keys, (F.col(position) - lag).alias(position), F.col("_d").alias("_later"))
            df = df.join(later, [*keys, position], "left")
        else:
            df = df.withColumn("_later", F.lead("_d", lag).over(rows.window()))
        return df.groupBy(*keys).agg(
            F.sum(F.col("_d") * F.col("_later")).alias("_ch"),
            F.sum(F.col("_d") * F.col("_d")).alias("_c0"),
            F.max("_n").alias("_n"),
        )

    sums = run_by_size(points, keys, [position], build, rows_per_task)
    r = F.try_divide(F.col("_ch"), F.col("_c0"))
    z = r * F.sqrt("_n") if lag == 1 else F.lit(None).cast("double")
    return sums.select(*keys, r.alias("R"), z.alias("z"))


def runs_of_signs(
    residuals: DataFrame, keys: list[str], residual: str = "residual", position: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, n_runs, z): do the signs change as often as in random residuals? Zeros only count in n."""
    sign = F.when(F.col(residual) != 0, F.signum(residual))

    def build(rows: Rows) -> DataFrame:
        df = scan(rows.with_df(rows.df.withColumn("_sign", sign)), last_before={"_prev": F.col("_sign")}).df
        return df.groupBy(*keys).agg(
            (F.count_if(F.col("_sign") != F.col("_prev")) + 1).alias("n_runs"),
            F.count_if(F.col("_sign") == 1).alias("_p"),
            F.count(F.lit(1)).alias("_n"),
        )

    counts = run_by_size(residuals, keys, [position], build, rows_per_task)
    n, p = F.col("_n"), F.col("_p")
    mu = 2 * p * (n - p) / n + 1
    variance = F.try_divide((mu - 1) * (mu - 2), n - 1)
    z = (F.col("n_runs") - mu + 0.5) / F.sqrt(F.when(variance > 0, variance))
    return counts.select(*keys, "n_runs", z.alias("z"))


def area_under_curve(
    points: DataFrame, keys: list[str], delay: float = 3, order: str = "t", tie: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, area): trapezoids, but the left value over a gap longer than ``delay``; 0 for one point."""

    def build(rows: Rows) -> DataFrame:
        df = scan(rows, next_after={"_next": F.struct("t", "x")}).df
        gap = F.col("_next.t") - F.col("t")
        part = F.when(gap > delay, gap * F.col("x")).otherwise(gap * (F.col("x") + F.col("_next.x")) / 2)
        return df.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("area"))

    return run_by_size(points, keys, [order, "x"] if tie is None else [order, tie, "x"], build, rows_per_task)
