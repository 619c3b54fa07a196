"""Analysis of result tables.

Keys that are null are left out and equal values go to the smaller key. Raw results
are reduced to sums per key on the map side before anything else happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_even
from ..plans.durable import materialise
from ..plans.medians import exact_medians

# Columns a result table may be grouped by, in this order.
GROUP_COLUMNS = ("model", "workflow", "preprocessing", "provider", "embeddings", "config_name")


def _hit() -> Column:
    return F.col("correct").cast("int")


def _present(results: DataFrame, names: Sequence[str]) -> list[str]:
    return [name for name in names if name in results.columns]


def _keyed(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.dropna(subset=list(by)) if by else results


def _means(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return _keyed(results, by).groupBy(*by).agg(
        F.avg(_hit()).alias("accuracy"), F.avg("time_seconds").alias("avg_time")
    )


def comparison_table(evaluations: DataFrame) -> DataFrame:
    """One row per evaluation document; old documents carry other names."""

    def metric(name: str, default: object) -> Column:
        # A document with ``metrics`` is read from there only.
        return F.coalesce(
            F.when(F.col("metrics").isNotNull(), F.col(f"metrics.{name}")).otherwise(
                F.col(f"summary.{name}")
            ),
            F.lit(default),
        ).alias(name)

    return evaluations.select(
        "_filename",
        F.coalesce("metadata.experiment", "metadata.prompt_variant", F.lit("unknown")).alias(
            "variant"
        ),
        F.coalesce("metadata.model", F.lit("unknown")).alias("model"),
        *(metric(n, 0.0) for n in ("accuracy", "precision", "recall", "f1")),
        *(metric(n, None) for n in ("TP", "FP", "TN", "FN")),
    )


def test_rows(evaluations: DataFrame) -> DataFrame:
    """One row per test of each document, with the name of its run."""
    return evaluations.select(
        F.coalesce("metadata.experiment", "metadata.prompt_variant", F.lit("unknown")).alias("run"),
        "_filename",
        F.explode("test_results").alias("t"),
    ).select(
        "run",
        "_filename",
        F.coalesce("t.block_id", "t.blk_id", F.lit("unknown")).alias("block_id"),
        "t.expected_label",
        "t.predicted_label",
        "t.correct",
    )


def per_test_cells(tests: DataFrame) -> DataFrame:
    """``block, expected, run, cell``: prediction and status of each block in each run."""
    mark = (
        F.when(F.col("correct"), "correct")
        .when(F.col("predicted_label").isNull(), "unparseable")
        .otherwise("wrong")
    )
    cell = F.concat_ws(" ", F.coalesce(F.col("predicted_label").cast("string"), F.lit("None")), mark)
    expected = tests.groupBy("block_id").agg(F.max("expected_label").alias("_expected"))
    cells = tests.groupBy("block_id", "run").agg(F.max(cell).alias("cell"))
    return cells.join(expected, "block_id").select(
        "block_id",
        F.substring("block_id", 1, 20).alias("block"),
        F.coalesce(F.col("_expected").cast("string"), F.lit("-")).alias("expected"),
        "run",
        "cell",
    )


def per_test_breakdown(tests: DataFrame, runs: Sequence[str]) -> DataFrame:
    """``per_test_cells`` with a column for each of ``runs``, ``-`` where a run lacks the block."""
    cells = per_test_cells(tests).groupBy("block_id", "block", "expected")
    return cells.pivot("run", list(runs)).agg(F.max("cell")).select(
        "block", "expected", *(F.coalesce(F.col(f"`{run}`"), F.lit("-")).alias(run) for run in runs)
    )


def best_config(table: DataFrame) -> DataFrame:
    """The row of ``comparison_table`` with the best F1 (else accuracy), first by name."""
    score = F.coalesce("f1", "accuracy", F.lit(0.0))
    return table.orderBy(F.desc(score), "_filename").limit(1)


def grouped_metrics(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, deviation and number of answers; mean, deviation and median of time."""
    keyed = _keyed(results, by)
    sums = keyed.groupBy(*by).agg(
        round_half_even(F.avg(_hit()), 3).alias("accuracy"),
        round_half_even(F.stddev_samp(_hit()), 3).alias("accuracy_std"),
        F.count("correct").alias("n_samples"),
        round_half_even(F.avg("time_seconds"), 3).alias("avg_time"),
        round_half_even(F.stddev_samp("time_seconds"), 3).alias("time_std"),
    )
    medians = exact_medians(keyed, by, "time_seconds", "_median")
    return (
        sums.join(medians, list(by), "left")
        .withColumn("median_time", round_half_even(F.col("_median"), 3))
        .drop("_median")
    )


def statistical_summary(results: DataFrame) -> DataFrame:
    """Accuracy, time and answers for every group column but the configuration name.

    Sums per combination of all group columns feed the grouping sets, so these expand
    combinations and not results.
    """
    by = _present(results, [c for c in GROUP_COLUMNS if c != "config_name"])
    cells = results.groupBy(*by).agg(
        F.sum(_hit()).alias("hits"),
        F.count("correct").alias("answers"),
        F.sum("time_seconds").alias("seconds"),
        F.count("time_seconds").alias("timed"),
    )
    sets = cells.groupingSets([[F.col(c)] for c in by], *(F.col(c) for c in by)).agg(
        (F.sum("hits") / F.sum("answers")).alias("accuracy"),
        (F.sum("seconds") / F.sum("timed")).alias("avg_time"),
        F.sum("answers").alias("n_samples"),
        *(F.grouping(c).alias(f"no_{c}") for c in by),
    )
    name = F.coalesce(*(F.when(F.col(f"no_{c}") == 0, c) for c in by))
    value = F.coalesce(*(F.col(c).cast("string") for c in by))
    shown = sets.select(
        name.alias("group_column"),
        value.alias("group_value"),
        round_half_even(round_half_even(F.col("accuracy"), 3) * 100, 1).alias("accuracy"),
        round_half_even(round_half_even(F.col("avg_time"), 3), 2).alias("avg_time"),
        "n_samples",
    )
    return shown.where(F.col("group_value").isNotNull())


def best_and_fastest(results: DataFrame) -> DataFrame:
    """Per group column: the value with the best accuracy and the one with the least time."""
    return statistical_summary(results).groupBy("group_column").agg(
        F.min_by("group_value", F.struct(-F.col("accuracy"), "group_value")).alias("best_accuracy"),
        F.min_by("group_value", F.struct("avg_time", "group_value")).alias("fastest"),
    )


def preprocessing_impact(results: DataFrame) -> DataFrame:
    """Accuracy gained and time saved by preprocessing."""
    on, off = F.col("preprocessing"), ~F.col("preprocessing")
    percent, seconds = _hit() * 100, F.col("time_seconds")
    return results.agg(
        F.avg(F.when(on, percent)).alias("accuracy_with"),
        F.avg(F.when(off, percent)).alias("accuracy_without"),
        (F.avg(F.when(on, percent)) - F.avg(F.when(off, percent))).alias("accuracy_gain"),
        (F.avg(F.when(off, seconds)) - F.avg(F.when(on, seconds))).alias("time_saved"),
    )


def interaction_cells(results: DataFrame, a: str, b: str) -> DataFrame:
    """Mean accuracy in percent by ``a`` and ``b``, a row for each pair that occurs."""
    return _means(results, [a, b]).select(a, b, (F.col("accuracy") * 100).alias("accuracy"))


def interaction_matrix(
    results: DataFrame, a: str, b: str, values: Sequence | None = None
) -> DataFrame:
    """``interaction_cells`` with a column for each value of ``b``; 0 where a pair does not occur.

    A column per value is what a matrix for people is; where ``b`` has many values, use the
    cells. Without ``values`` they are looked up, in order.
    """
    cells = materialise(interaction_cells(results, a, b), "interaction-cells")
    if values is None:
        values = [row[0] for row in cells.select(b).distinct().orderBy(b).collect()]
    return cells.groupBy(a).pivot(b, list(values)).agg(F.first("accuracy")).na.fill(0)


def faceted(results: DataFrame, metric: str) -> DataFrame:
    """``correct`` as mean percent or ``time_seconds`` as median, by the first three groups."""
    by = _present(results, GROUP_COLUMNS[:3])
    label = F.concat_ws(" | ", *(F.col(c).cast("string") for c in by)).alias("label")
    if metric == "correct":
        values = _means(results, by).withColumn("value", F.col("accuracy") * 100)
    else:
        values = exact_medians(_keyed(results, by), by, metric, "value")
    return values.select(label, "value")


def efficiency_matrix(results: DataFrame) -> DataFrame:
    """Accuracy, time and accuracy per logarithm of time by the first three groups."""
    by = _present(results, GROUP_COLUMNS[:3])
    return _means(results, by).withColumn(
        "efficiency", F.col("accuracy") * 100 / F.log1p("avg_time")
    )


def accuracy_bars(results: DataFrame, by: str) -> DataFrame:
    """Mean, deviation and number of answers in percent, best first."""
    return (
        _keyed(results, [by])
        .groupBy(by)
        .agg(
            (F.avg(_hit()) * 100).alias("mean"),
            (F.stddev_samp(_hit()) * 100).alias("std"),
            F.count("correct").alias("count"),
        )
        .orderBy(F.desc("mean"), by)
    )


def time_bars(results: DataFrame, by: str) -> DataFrame:
    """Mean, deviation and median of time, fastest first."""
    keyed = _keyed(results, [by])
    sums = keyed.groupBy(by).agg(
        F.avg("time_seconds").alias("mean"), F.stddev_samp("time_seconds").alias("std")
    )
    medians = exact_medians(keyed, [by], "time_seconds", "median")
    return sums.join(medians, by, "left").orderBy("mean", by)


def _best(cells: DataFrame, key: str, name: str) -> DataFrame:
    return cells.agg(
        F.min_by(F.col(key), F.struct(-F.col("accuracy"), F.col(key))).alias(name),
        F.max(F.col("accuracy") * 100).alias(f"{name}_accuracy"),
    )


def best_model(results: DataFrame) -> DataFrame:
    """The best model over all results and over those with preprocessing."""
    cells = results.groupBy("model").agg(
        F.avg(_hit()).alias("accuracy"), F.avg(F.when(F.col("preprocessing"), _hit())).alias("prep")
    ).where(F.col("model").isNotNull())
    return cells.agg(
        F.min_by("model", F.struct(-F.col("accuracy"), "model")).alias("best"),
        F.min_by("model", F.when(F.col("prep").isNotNull(), F.struct(-F.col("prep"), "model"))).alias(
            "best_with_preprocessing"
        ),
        F.max(F.col("accuracy") * 100).alias("accuracy"),
        F.max(F.col("prep") * 100).alias("accuracy_with_preprocessing"),
    )


def workflow_time_diff(results: DataFrame) -> DataFrame:
    """The best workflow and how far the mean times of the first two by name lie apart."""
    cells = _means(results, ["workflow"])
    first_two = cells.orderBy("workflow").limit(2)
    gap = first_two.agg((F.max("avg_time") - F.min("avg_time")).alias("gap"))
    return _best(cells, "workflow", "best_workflow").withColumn("time_difference", gap.scalar())


def top_configurations(results: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most accurate combinations of the group columns."""
    by = _present(results, GROUP_COLUMNS[:4])
    return _means(results, by).drop("avg_time").orderBy(F.desc("accuracy"), *by).limit(k)


def config_metrics(results: DataFrame) -> DataFrame:
    """Per configuration: accuracy in percent and mean time, from values of three digits."""
    return _means(results, ["config_name"]).select(
        "config_name",
        (round_half_even(F.col("accuracy"), 3) * 100).alias("accuracy"),
        round_half_even(F.col("avg_time"), 3).alias("avg_time"),
    )


def quadrants(results: DataFrame) -> DataFrame:
    """Each configuration's side of the median accuracy and the median time."""
    cells = config_metrics(results)
    accuracy = exact_medians(cells, [], "accuracy", "median").scalar()
    seconds = exact_medians(cells, [], "avg_time", "median").scalar()
    return cells.withColumn("median_accuracy", accuracy).withColumn(
        "median_time", seconds
    ).select(
        "*",
        (F.col("accuracy") >= F.col("median_accuracy")).alias("accurate"),
        (F.col("avg_time") <= F.col("median_time")).alias("fast"),
    )


def model_ranking(results: DataFrame) -> DataFrame:
    """Accuracy per model with preprocessing, best first."""
    used = results.where(F.col("preprocessing"))
    return _means(used, ["model"]).drop("avg_time").orderBy(F.desc("accuracy"), "model")
