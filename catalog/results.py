"""Analysis of result tables and evaluation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.operators import results as ops
from cairnlog.operators.scoring import confusion_metrics, unparseable_and_total
from cairnlog.sources.evaluations import evaluation_summary, stored_tests

from . import register
from .views import Tables, sql


def _results(t: Tables) -> DataFrame:
    return t.view("v_results")


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.round(name, 6))
    return frame


def _runs(t: Tables) -> DataFrame:
    """One row per run: ``metadata`` and ``metrics``."""
    predictions = t.view("v_predictions")
    counts = confusion_metrics(predictions, "run").join(
        unparseable_and_total(predictions, "run"), "run"
    )
    metrics = F.struct(
        "TP", "TN", "FP", "FN", "accuracy", "precision", "recall", "f1", "unparseable", "total"
    )
    return counts.select(
        F.col("run").alias("experiment"),
        F.struct(F.col("run").alias("experiment"), F.lit("m").alias("model")).alias("metadata"),
        metrics.alias("metrics"),
    )


def _evaluations(t: Tables) -> DataFrame:
    """Documents of the present kind, and for two runs of the older kind."""
    old = F.col("experiment").isin("run0", "run3")
    nothing = F.lit(None)
    return _runs(t).select(
        F.concat(F.lit("eval_"), "experiment", F.lit(".json")).alias("_filename"),
        F.struct(
            F.when(~old, F.col("experiment")).alias("experiment"),
            F.when(F.col("experiment") == "run0", "variant0").alias("prompt_variant"),
            F.when(~old, "m").alias("model"),
        ).alias("metadata"),
        F.when(~old, F.col("metrics")).otherwise(nothing).alias("metrics"),
        F.when(old, F.col("metrics")).otherwise(nothing).alias("summary"),
    )


_METRICS = """m AS (SELECT run, TP, TN, FP, FN, n, total, round_even(a * 10000, 0) / 10000 AS accuracy,
    round_even(pr * 10000, 0) / 10000 AS precision, round_even(re * 10000, 0) / 10000 AS recall,
    round_even(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * 10000, 0) / 10000 AS f1
  FROM (SELECT *, (TP + TN) / n AS a, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0 END AS pr,
      CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0 END AS re
    FROM (SELECT run, count(*) FILTER (expected = 1 AND predicted = 1) AS TP,
      count(*) FILTER (expected = 0 AND predicted = 0) AS TN, count(*) FILTER (expected = 0 AND predicted = 1) AS FP,
      count(*) FILTER (expected = 1 AND predicted = 0) AS FN, count(predicted) AS n, count(*) AS total
      FROM v_predictions GROUP BY run)))"""
_TABLE = """SELECT concat('eval_', run, '.json') AS _filename,
    CASE run WHEN 'run0' THEN 'variant0' WHEN 'run3' THEN 'unknown' ELSE run END AS variant,
    CASE WHEN run IN ('run0', 'run3') THEN 'unknown' ELSE 'm' END AS model,
    accuracy, precision, recall, f1, "TP", "FP", "TN", "FN" FROM m"""


def _with_metrics(body: str) -> str:
    return sql("SELECT 1", "v_predictions").replace("\nSELECT 1", ",\n" + _METRICS + "\n" + body)


register("r1_comparison_table", lambda t: ops.comparison_table(_evaluations(t)), _with_metrics(_TABLE))
register(
    "r3_best_config",
    lambda t: ops.best_config(ops.comparison_table(_evaluations(t))),
    _with_metrics(f"{_TABLE} ORDER BY f1 DESC, _filename LIMIT 1"),
)
register(
    "a14_evaluation_summary",
    lambda t: evaluation_summary(_runs(t)),
    _with_metrics(
        """SELECT run AS "Experiment", 'm' AS "Model", "TP", "FP", "TN", "FN", precision AS "Precision",
        recall AS "Recall", f1 AS "F1", accuracy AS "Accuracy" FROM m"""
    ),
)


def _tests(t: Tables) -> DataFrame:
    """One row per run and block."""
    predicted = F.max("predicted")
    return (
        t.view("v_predictions")
        .withColumn("block_id", F.concat(F.lit("blk_"), (F.col("event_id") % 700).cast("string"), F.lit("_with_a_long_identifier")))
        .groupBy("run", "block_id")
        .agg(
            F.max("expected").alias("expected_label"),
            predicted.alias("predicted_label"),
            F.coalesce(predicted == F.max("expected"), F.lit(False)).alias("correct"),
        )
    )


_TESTS = """tests AS (SELECT run, concat('blk_', CAST(event_id % 700 AS varchar), '_with_a_long_identifier') AS block_id,
    max(expected) AS e, max(predicted) AS p FROM v_predictions GROUP BY 1, 2)"""
_CELL = """coalesce(max(CASE WHEN run = '{0}' THEN concat(coalesce(CAST(p AS varchar), 'None'), ' ',
    CASE WHEN p = e THEN 'correct' WHEN p IS NULL THEN 'unparseable' ELSE 'wrong' END) END), '-') AS {0}"""
register(
    "r2_per_test_breakdown",
    lambda t: ops.per_test_breakdown(_tests(t), [f"run{i}" for i in range(5)]),
    sql("SELECT 1", "v_predictions").replace(
        "\nSELECT 1",
        ",\n"
        + _TESTS
        + f"""\nSELECT block_id[1:20] AS block, CAST(max(e) AS varchar) AS expected,
        {", ".join(_CELL.format(f"run{i}") for i in range(5))} FROM tests GROUP BY block_id""",
    ),
)
register(
    "r2_per_test_cells",
    lambda t: ops.per_test_cells(_tests(t)),
    sql("SELECT 1", "v_predictions").replace(
        "\nSELECT 1",
        ",\n"
        + _TESTS
        + """\nSELECT block_id, block_id[1:20] AS block, CAST(max(e) OVER (PARTITION BY block_id) AS varchar) AS expected,
        run, concat(coalesce(CAST(p AS varchar), 'None'), ' ', CASE WHEN p = e THEN 'correct'
        WHEN p IS NULL THEN 'unparseable' ELSE 'wrong' END) AS cell FROM tests""",
    ),
)
register(
    "a14_evaluation_documents",
    lambda t: stored_tests(_runs(t), _tests(t).withColumnRenamed("run", "experiment")),
    sql("SELECT 1", "v_predictions").replace(
        "\nSELECT 1",
        ",\n"
        + _TESTS
        + """\nSELECT run AS experiment, count(*) AS tests, count(*) FILTER (p = e) AS correct,
        (SELECT count(*) FROM v_predictions v WHERE v.run = tests.run) AS total FROM tests GROUP BY run""",
    ),
)

_ROUND3 = "round_even({0} * 1000, 0) / 1000"


def _r3(expression: str) -> str:
    return _ROUND3.format(expression)


_HIT = "CAST(correct AS INTEGER)"
_GROUPED = f"""{_r3(f'avg({_HIT})')} AS accuracy, {_r3(f'stddev_samp({_HIT})')} AS accuracy_std,
  count(correct) AS n_samples, {_r3('avg(time_seconds)')} AS avg_time,
  {_r3('stddev_samp(time_seconds)')} AS time_std, {_r3('median(time_seconds)')} AS median_time"""
register(
    "r4_grouped_metrics",
    lambda t: ops.grouped_metrics(_results(t), ["model", "workflow"]),
    sql(f"SELECT model, workflow, {_GROUPED} FROM v_results GROUP BY model, workflow", "v_results"),
)
register(
    "r4_grouped_metrics_by_config",
    lambda t: ops.grouped_metrics(_results(t), ["config_name"]),
    sql(f"SELECT config_name, {_GROUPED} FROM v_results GROUP BY config_name", "v_results"),
)
_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS group_column, CAST({c} AS varchar) AS group_value,
      round_even({_r3(f'avg({_HIT})')} * 100 * 10, 0) / 10 AS accuracy,
      round_even({_r3('avg(time_seconds)')} * 100, 0) / 100 AS avg_time, count(correct) AS n_samples
      FROM v_results GROUP BY {c}"""
    for c in ("model", "workflow", "preprocessing")
)
register("r5_statistical_summary", lambda t: ops.statistical_summary(_results(t)), sql(_SUMMARY, "v_results"))
register(
    "r6_best_and_fastest",
    lambda t: ops.best_and_fastest(_results(t)),
    sql(
        f"""SELECT group_column, first(group_value ORDER BY accuracy DESC, group_value) AS best_accuracy,
        first(group_value ORDER BY avg_time, group_value) AS fastest FROM ({_SUMMARY}) GROUP BY 1""",
        "v_results",
    ),
)
register(
    "r7_preprocessing_impact",
    lambda t: _rounded(
        ops.preprocessing_impact(_results(t)),
        "accuracy_with", "accuracy_without", "accuracy_gain", "time_saved",
    ),
    sql(
        f"""SELECT round(a, 6) AS accuracy_with, round(b, 6) AS accuracy_without, round(a - b, 6) AS accuracy_gain,
        round(d - c, 6) AS time_saved FROM (SELECT avg({_HIT} * 100) FILTER (preprocessing) AS a,
          avg({_HIT} * 100) FILTER (NOT preprocessing) AS b, avg(time_seconds) FILTER (preprocessing) AS c,
          avg(time_seconds) FILTER (NOT preprocessing) AS d FROM v_results)""",
        "v_results",
    ),
)
register(
    "r8_interaction_matrix",
    lambda t: _rounded(
        ops.interaction_matrix(_results(t), "model", "workflow", ["simple", "evaluator"]),
        "simple", "evaluator",
    ),
    sql(
        f"""SELECT model, {", ".join(f"round(coalesce(avg({_HIT}) FILTER (workflow = '{w}') * 100, 0), 6) AS {w}" for w in ("simple", "evaluator"))}
        FROM v_results GROUP BY model""",
        "v_results",
    ),
)
register(
    "r8_interaction_cells",
    lambda t: _rounded(ops.interaction_cells(_results(t), "question_id", "config_name"), "accuracy"),
    sql(
        f"SELECT question_id, config_name, round(avg({_HIT}) * 100, 6) AS accuracy FROM v_results GROUP BY 1, 2",
        "v_results",
    ),
)
_LABEL = "concat(model, ' | ', workflow, ' | ', CAST(preprocessing AS varchar))"
register(
    "r9_faceted_accuracy",
    lambda t: _rounded(ops.faceted(_results(t), "correct"), "value"),
    sql(f"SELECT {_LABEL} AS label, round(avg({_HIT}) * 100, 6) AS value FROM v_results GROUP BY 1", "v_results"),
)
register(
    "r9_faceted_time",
    lambda t: _rounded(ops.faceted(_results(t), "time_seconds"), "value"),
    sql(f"SELECT {_LABEL} AS label, round(median(time_seconds), 6) AS value FROM v_results GROUP BY 1", "v_results"),
)
register(
    "r10_efficiency_matrix",
    lambda t: _rounded(ops.efficiency_matrix(_results(t)), "accuracy", "avg_time", "efficiency"),
    sql(
        f"""SELECT model, workflow, preprocessing, round(avg({_HIT}), 6) AS accuracy, round(avg(time_seconds), 6) AS avg_time,
        round(avg({_HIT}) * 100 / ln(1 + avg(time_seconds)), 6) AS efficiency FROM v_results GROUP BY 1, 2, 3""",
        "v_results",
    ),
)
register(
    "r11_accuracy_bars",
    lambda t: _rounded(ops.accuracy_bars(_results(t), "model"), "mean", "std"),
    sql(
        f"""SELECT model, round(avg({_HIT}) * 100, 6) AS mean, round(stddev_samp({_HIT}) * 100, 6) AS std,
        count(correct) AS count FROM v_results GROUP BY model""",
        "v_results",
    ),
)
register(
    "r11_time_bars",
    lambda t: _rounded(ops.time_bars(_results(t), "workflow"), "mean", "std", "median"),
    sql(
        """SELECT workflow, round(avg(time_seconds), 6) AS mean, round(stddev_samp(time_seconds), 6) AS std,
        round(median(time_seconds), 6) AS median FROM v_results GROUP BY workflow""",
        "v_results",
    ),
)
_MODEL = f"""SELECT model, avg({_HIT}) AS a, avg({_HIT}) FILTER (preprocessing) AS b FROM v_results GROUP BY model"""
register(
    "r12_best_model",
    lambda t: _rounded(ops.best_model(_results(t)), "accuracy", "accuracy_with_preprocessing"),
    sql(
        f"""SELECT first(model ORDER BY a DESC, model) AS best, first(model ORDER BY b DESC, model) AS best_with_preprocessing,
        round(max(a) * 100, 6) AS accuracy, round(max(b) * 100, 6) AS accuracy_with_preprocessing FROM ({_MODEL})""",
        "v_results",
    ),
)
register(
    "r13_workflow_time_diff",
    lambda t: _rounded(
        ops.workflow_time_diff(_results(t)), "best_workflow_accuracy", "time_difference"
    ),
    sql(
        f"""SELECT first(workflow ORDER BY a DESC, workflow) AS best_workflow, round(max(a) * 100, 6) AS best_workflow_accuracy,
        round(max(s) - min(s), 6) AS time_difference
        FROM (SELECT workflow, avg({_HIT}) AS a, avg(time_seconds) AS s FROM v_results GROUP BY workflow)""",
        "v_results",
    ),
)
register(
    "r14_top_configurations",
    lambda t: _rounded(ops.top_configurations(_results(t)), "accuracy"),
    sql(
        f"""SELECT model, workflow, preprocessing, round(a, 6) AS accuracy FROM (SELECT model, workflow, preprocessing, avg({_HIT}) AS a
        FROM v_results GROUP BY 1, 2, 3) ORDER BY a DESC, model, workflow, preprocessing LIMIT 3""",
        "v_results",
    ),
)
_CONFIG = f"""SELECT config_name, {_r3(f'avg({_HIT})')} * 100 AS accuracy, {_r3('avg(time_seconds)')} AS avg_time
  FROM v_results GROUP BY config_name"""
register("r15_config_metrics", lambda t: _rounded(ops.config_metrics(_results(t)), "accuracy"),
         sql(f"SELECT config_name, round(accuracy, 6) AS accuracy, avg_time FROM ({_CONFIG})", "v_results"))
register(
    "r16_quadrants",
    lambda t: _rounded(
        ops.quadrants(_results(t)), "accuracy", "median_accuracy", "median_time"
    ),
    sql(
        f"""SELECT config_name, round(accuracy, 6) AS accuracy, avg_time, round(ma, 6) AS median_accuracy, round(mt, 6) AS median_time,
        accuracy >= ma AS accurate, avg_time <= mt AS fast FROM ({_CONFIG}),
        (SELECT median(accuracy) AS ma, median(avg_time) AS mt FROM ({_CONFIG}))""",
        "v_results",
    ),
)
register(
    "r17_model_ranking",
    lambda t: _rounded(ops.model_ranking(_results(t)), "accuracy"),
    sql(
        f"SELECT model, round(avg({_HIT}), 6) AS accuracy FROM v_results WHERE preprocessing GROUP BY model",
        "v_results",
    ),
)
