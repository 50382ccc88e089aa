"""Counts, label statistics and metrics, each in a single aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def majority_label(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``label, n`` (per group): the most frequent label, the smallest one on a tie; nulls do not vote."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    # Most rows first, then the smallest label: counts enter with their sign turned.
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label"))).alias("b")
    return counts.groupBy(*by).agg(best).select(*by, F.col("b.label").alias("label"), (-F.col("b.minus")).alias("n"))


def mean_label(label: str) -> Column:
    return F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0))


def label_summary(df: DataFrame, label: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """``n_rows, n_labels, mean_label, stratify``."""
    distinct = F.count_distinct(label) if exact else F.approx_count_distinct(label)
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n_rows"), distinct.alias("n_labels"), mean_label(label).alias("mean_label"))
        .withColumn("stratify", F.col("n_labels") > 1)
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """``mse, rmse, r2, n_samples`` over rows with a label and a prediction; null where there is nothing to average or explain."""
    scored = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    y, p = (F.when(scored, F.col(c).cast("double")) for c in (label, prediction))
    error = y - p
    mse = F.avg(error * error)
    spread = F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return df.groupBy(*by).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.lit(1.0) - F.sum(error * error) / spread).alias("r2"),
        F.count(y).alias("n_samples"),
        *extra,
    )


def unscored_count(label: str, prediction: str = "prediction") -> Column:
    """Aggregate: rows that have a label but no prediction, which regression metrics leave out."""
    return F.count_if(F.col(label).isNotNull() & F.col(prediction).isNull())


def unscored(df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``n_unscored`` per group."""
    return df.groupBy(*by).agg(unscored_count(label, prediction).alias("n_unscored"))


def classification_metrics(
    df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """``accuracy, n_samples``; accuracy is null where there are no rows."""
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False))
    return df.groupBy(*by).agg(
        F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n_samples"), *extra
    )


def metrics_for(
    task: str, df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """The metrics of a task, and ``extra`` aggregates in the same pass."""
    return (regression_metrics if task == "regression" else classification_metrics)(df, label, prediction, by, extra)


def map_to_long(metrics: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """``job_id, metrics`` (a map) to ``job_id, metric_name, metric_value, recorded_at`` and the frame's other columns."""
    at = recorded_at if recorded_at is not None else F.current_timestamp()
    others = [F.col(f"`{c}`") for c in metrics.columns if c not in ("job_id", "metrics")]
    return metrics.select("job_id", F.explode("metrics").alias("metric_name", "metric_value"), at.alias("recorded_at"), *others)


def to_long(metrics: DataFrame, names: Sequence[str], recorded_at: Column | None = None) -> DataFrame:
    """Wide metrics to long form in one pass."""
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return map_to_long(metrics.select("job_id", pairs.alias("metrics")), recorded_at)


def metrics_map(row: Mapping[str, object]) -> dict[str, float | None]:
    """Metrics of one row as plain numbers, for messages."""
    return {k: None if v is None else float(v) for k, v in row.items()}
