"""Experiment grids, scored answers and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.answers import compare, with_answer
from ..functions.text import round_half_even
from ..plans.durable import materialise

SPEC_COLUMNS = (
    "answer_type", "expected_int", "expected_list", "tolerance", "case_sensitive", "order_matters"
)


def experiment_grid(configs: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case for every configuration of the same ``task``.

    Configurations are written first: Catalyst then knows their size and broadcasts
    them if small, which keeps a task with most of the cases spread.
    """
    return cases.join(materialise(configs, "configs"), "task")


def with_file_context(questions: DataFrame, file_name: str) -> DataFrame:
    """Questions that name the file they are about, once."""
    # Fixed value: the wording of the prefix.
    prefix = f"Solve the following task based on this file: {file_name}.\n\n"
    return questions.withColumn("question", F.concat(F.lit(prefix), F.col("question")))


def retry_outcome(verdicts: DataFrame, max_iterations: int = 3) -> DataFrame:
    """Per task: the iteration that was accepted first, or the last one allowed.

    ``verdicts`` has ``task_id``, ``iteration`` (from 1), ``acceptable`` and ``content``.
    """
    used = verdicts.where(F.col("iteration") <= max_iterations)
    accepted = F.min(F.when(F.col("acceptable"), F.col("iteration")))
    # Accepted rows come first in ascending, the others after them in descending order.
    rank = F.when(F.col("acceptable"), F.col("iteration")).otherwise(
        F.lit(1 << 40) - F.col("iteration")
    )
    return used.groupBy("task_id").agg(
        F.coalesce(accepted, F.lit(max_iterations)).cast("int").alias("iterations_used"),
        accepted.isNull().alias("max_iterations_reached"),
        F.min_by("content", rank).alias("content"),
    )


def score_answers(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses joined with their questions and scored, in the result table's columns.

    ``questions`` is a specification of few rows. It is written first, so that Catalyst
    knows its size and broadcasts it if small; few keys would make a bad shuffle. Responses keep their own columns (configuration, time, tokens) and a
    response without any value in it becomes an error row.
    """
    specification = materialise(questions.withColumnRenamed("id", "question_id"), "questions")
    joined = responses.join(specification, "question_id")
    read, answer = with_answer(joined, F.col("response"))
    verdict = compare(answer, {name: F.col(name) for name in SPEC_COLUMNS})
    scored = read.withColumn("_verdict", verdict)
    failed = F.col("found_json").isNull()
    # Fixed value: the wording of the error.
    error = F.concat(
        F.lit("Could not extract valid JSON from response: "),
        F.substring("response", 1, 200),
        F.lit("..."),
    )
    expected = F.when(
        F.col("answer_type") == "integer", F.col("expected_int").cast("string")
    ).otherwise(F.to_json(F.col("expected_list")))
    zero = F.lit(0).cast("long")
    values = {
        "expected": expected,
        "answer": F.when(~failed, F.col("_verdict.answer")),
        "correct": F.when(failed, False).otherwise(F.col("_verdict.correct")),
        "reason": F.when(failed, F.concat(F.lit("Error: "), error)).otherwise(
            F.col("_verdict.reason")
        ),
        "tokens_input": F.when(failed, zero).otherwise(F.col("tokens_input")),
        "tokens_output": F.when(failed, zero).otherwise(F.col("tokens_output")),
        "tokens_total": F.when(failed, zero).otherwise(
            F.col("tokens_input") + F.col("tokens_output")
        ),
        "error": F.when(failed, error),
    }
    types = dict(field.split() for field in schemas.RESULTS.split(", "))

    def column(name: str) -> Column:
        if name in values:
            return values[name].alias(name)
        if name in joined.columns:
            return F.col(name)
        return F.lit(None).cast(types[name]).alias(name)

    return scored.select(*(column(name) for name in schemas.RESULT_COLUMNS))


def config_summary(results: DataFrame) -> DataFrame:
    """Per configuration: correct and all answers, accuracy, mean time, tokens."""
    return results.groupBy("config_name").agg(
        F.count_if("correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("correct") / F.count(F.lit(1)) * 100).alias("accuracy"),
        F.avg(F.coalesce("time_seconds", F.lit(0.0))).alias("avg_time"),
        F.sum("tokens_total").alias("total_tokens"),
        (F.sum("tokens_total") / F.count(F.lit(1))).alias("avg_tokens"),
    )


def confusion_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates of ``expected`` and ``predicted``; null predictions left out."""
    e, p = F.col("expected"), F.col("predicted")
    counts = predictions.groupBy(*by).agg(
        F.count_if((e == 1) & (p == 1)).alias("TP"),
        F.count_if((e == 0) & (p == 0)).alias("TN"),
        F.count_if((e == 0) & (p == 1)).alias("FP"),
        F.count_if((e == 1) & (p == 0)).alias("FN"),
        F.count("predicted").alias("_parsed"),
    )
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {
        "accuracy": ratio(tp + F.col("TN"), F.col("_parsed")),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
    }
    return counts.select(
        *by,
        "TP",
        "TN",
        "FP",
        "FN",
        *(round_half_even(value, 4).alias(name) for name, value in rates.items()),
    )


def unparseable_and_total(predictions: DataFrame, *by: str) -> DataFrame:
    """Null predictions and all predictions."""
    return predictions.groupBy(*by).agg(
        F.count_if(F.col("predicted").isNull()).alias("unparseable"),
        F.count(F.lit(1)).alias("total"),
    )
