"""Answer parsing, comparison, scoring and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.functions import answers as fn
from cairnlog.operators import scoring as ops
from cairnlog.operators.questions import generate_questions
from cairnlog.operators.stats import log_facts

from . import register
from .counts import _FACTS, _QUESTION_SQL
from .views import Tables, sql

def _response():
    return F.col("response")


def _responses(t: Tables) -> DataFrame:
    return t.view("v_responses")


_CLEAN = r"regexp_replace(regexp_replace(response, '\d{4,}', ' ', 'g'), '[^\d]', ' ', 'g')"
_LABEL = rf"""CASE WHEN contains(response, '"label": 0') THEN 0 WHEN contains(response, '"label": 1') THEN 1
  WHEN len(regexp_extract_all({_CLEAN}, '\b[01]\b')) > 0 THEN CAST(regexp_extract_all({_CLEAN}, '\b[01]\b')[-1] AS INTEGER)
  WHEN regexp_matches(response, '(?i)normal') THEN 0 WHEN regexp_matches(response, '(?i)anomal') THEN 1 END"""
register(
    "q1_normalize_label",
    lambda t: _responses(t).select("event_id", fn.normalize_label(_response()).alias("label")),
    sql(f"SELECT event_id, {_LABEL} AS label FROM v_responses", "v_responses"),
)
register(
    "q1_normalize_label_prose",
    lambda t: t.table("documents").select(
        "doc_id", fn.normalize_label(F.col("text")).alias("label")
    ),
    f"SELECT doc_id, {_LABEL.replace('response', 'text')} AS label FROM documents",
)
register(
    "q2_prediction_status",
    lambda t: t.view("v_predictions").select(
        "event_id", fn.prediction_status(F.col("expected"), F.col("predicted")).alias("status")
    ),
    sql(
        """SELECT event_id, CASE WHEN predicted IS NULL THEN 'unparseable' WHEN predicted = expected
        THEN 'correct' ELSE 'wrong' END AS status FROM v_predictions""",
        "v_predictions",
    ),
)


def _first_json(pattern: str) -> str:
    return f"list_filter(regexp_extract_all(response, '{pattern}'), lambda m: json_valid(m))[1]"


_FENCE = r"(?s)```json\s*\n(.*?)\n```"
_OBJECT = r"(?s)[{][^{}]*[}]"
_LIST = r"(?s)\[.*?\]"
_NUMBER = r"\b(\d+)\b"
_QUOTED = '"([^"]+)"'
_JSON = f"""coalesce(
  CASE WHEN json_valid(regexp_extract(response, '{_FENCE}', 1)) THEN nullif(regexp_extract(response, '{_FENCE}', 1), '') END,
  {_first_json(_OBJECT)}, {_first_json(_LIST)},
  CASE WHEN json_valid(trim(response)) THEN trim(response) END,
  nullif(regexp_extract(response, '{_NUMBER}', 1), ''),
  '"' || nullif(regexp_extract(response, '{_QUOTED}', 1), '') || '"')"""
_ANSWERS = f"""answers AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.answer')
    THEN CAST(json_extract(j, '$.answer') AS varchar) ELSE j END AS a
  FROM (SELECT *, {_JSON} AS j FROM v_responses))"""


def _answered(body: str) -> str:
    return sql("SELECT 1", "v_responses").replace("\nSELECT 1", ",\n" + _ANSWERS + "\n" + body)


register(
    "q3_extract_json",
    lambda t: _responses(t).select("event_id", fn.extract_json(_response()).alias("json")),
    _answered("SELECT event_id, j AS json FROM answers"),
)
_PLAIN = """CASE WHEN json_type(a) = 'VARCHAR' THEN json_extract_string(a, '$') ELSE a END"""
_INT = r"""CASE json_type(a) WHEN 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract(a, '\d+'), '') AS BIGINT)
  WHEN 'UBIGINT' THEN CAST(a AS BIGINT) WHEN 'BIGINT' THEN CAST(a AS BIGINT) END"""
_ITEMS = """CASE WHEN json_type(a) = 'ARRAY' THEN from_json(a, '["VARCHAR"]') END"""
def _kind_of_three():
    return (
        F.when(F.col("event_id") % 3 == 0, "integer")
        .when(F.col("event_id") % 3 == 1, "string_match")
        .otherwise("list")
    )


def _verdicts(t: Tables, verdict) -> DataFrame:
    frame, answer = fn.with_answer(_responses(t), _response())
    return frame.select("event_id", verdict(answer).alias("v")).select("event_id", "v.*")


register(
    "q4_typed_answer",
    lambda t: _verdicts(t, lambda answer: fn.typed_answer(answer, _kind_of_three())).withColumn(
        "items", F.array_join("items", "|")
    ),
    _answered(
        f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_INT} END AS integer,
        CASE WHEN event_id % 3 = 1 THEN {_PLAIN} END AS text,
        CASE WHEN event_id % 3 = 2 THEN array_to_string({_ITEMS}, '|') END AS items FROM answers"""
    ),
)
register(
    "q5_unwrap_answer",
    lambda t: fn.with_answer(_responses(t), _response())[0].select(
        "event_id", F.col("answer_json").alias("answer")
    ),
    _answered("SELECT event_id, a AS answer FROM answers"),
)


_INT_VERDICT = f"""SELECT event_id, a, {_INT} AS i, {_PLAIN} AS plain, expected_int AS e, tolerance AS tol, json_type(a) AS kind FROM answers"""
_TOL = "CAST(tol AS varchar)"
_INT_COLUMNS = f"""coalesce(abs(i - e) <= tol, false) AS correct, abs(i - e) AS difference,
  coalesce(CAST(i AS varchar), plain) AS answer,
  CASE WHEN i IS NULL THEN CASE WHEN a IS NULL THEN NULL ELSE concat(CASE WHEN kind = 'VARCHAR' THEN 'Could not extract integer from: ' ELSE 'Could not convert to integer: ' END, plain) END
    WHEN abs(i - e) <= tol THEN concat('Correct (within tolerance ±', {_TOL}, ')')
    ELSE concat('Incorrect: got ', CAST(i AS varchar), ', expected ', CAST(e AS varchar), ' (±', {_TOL}, ')') END AS reason"""
register(
    "q6_compare_integer",
    lambda t: _verdicts(
        t, lambda answer: fn.compare_integer(answer, F.col("expected_int"), F.col("tolerance"))
    ),
    _answered(f"SELECT event_id, {_INT_COLUMNS} FROM ({_INT_VERDICT})"),
)
def _wanted():
    return F.array(F.lit("nothing"), F.upper("expected_text"))


_MATCH = """CASE WHEN contains(lower(plain), 'nothing') OR contains('nothing', lower(plain)) THEN 'nothing'
  WHEN contains(lower(plain), expected_text) OR contains(expected_text, lower(plain)) THEN expected_text END"""
_TEXT_COLUMNS = f"""{_MATCH} IS NOT NULL AS correct, CAST(NULL AS BIGINT) AS difference, plain AS answer,
  coalesce('Matched expected value: ' || {_MATCH}, 'Did not match any expected values') AS reason"""
_TEXT_INPUT = f"SELECT *, trim({_PLAIN}) AS plain FROM answers"
register(
    "q7_compare_string",
    lambda t: _verdicts(t, lambda answer: fn.compare_string(answer, _wanted(), F.lit(False))),
    _answered(f"SELECT event_id, {_TEXT_COLUMNS} FROM ({_TEXT_INPUT})"),
)
def _wanted_list():
    return F.array(F.lit("view"), F.upper("expected_text"), F.lit("click"))


_LIST_INPUT = f"""SELECT *, ['view', upper(expected_text), 'click'] AS wanted, CASE json_type(a)
    WHEN 'ARRAY' THEN list_transform({_ITEMS}, lambda x: trim(x))
    WHEN 'VARCHAR' THEN list_filter(list_transform(string_split_regex(json_extract_string(a, '$'), '[,;\n]'), lambda x: trim(x)), lambda x: x <> '') END AS items,
  {_PLAIN} AS plain FROM answers"""
_FOLD = "list_sort(list_distinct(list_transform({0}, lambda x: lower(x))))"
_MISSING = f"list_filter({_FOLD.format('wanted')}, lambda x: NOT list_contains({_FOLD.format('items')}, x))"
_EXTRA = f"list_filter({_FOLD.format('items')}, lambda x: NOT list_contains({_FOLD.format('wanted')}, x))"
_KIND = """CASE json_type(a) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' ELSE 'number' END"""
_LIST_PARTS = f"SELECT *, {_MISSING} AS missing, {_EXTRA} AS extra FROM ({_LIST_INPUT})"
_LIST_COLUMNS = f"""coalesce(len(missing) = 0 AND len(extra) = 0, false) AS correct, CAST(NULL AS BIGINT) AS difference,
  CASE WHEN items IS NULL THEN plain ELSE concat('[', array_to_string(items, ', '), ']') END AS answer,
  CASE WHEN items IS NULL THEN 'Answer is not a list: ' || {_KIND}
    WHEN len(missing) = 0 AND len(extra) = 0 THEN 'Correct (all items present, order ignored)'
    ELSE concat('Incorrect: ', concat_ws(', ', CASE WHEN len(missing) > 0 THEN concat('missing: [', array_to_string(missing, ', '), ']') END,
      CASE WHEN len(extra) > 0 THEN concat('extra: [', array_to_string(extra, ', '), ']') END)) END AS reason"""
register(
    "q8_compare_list",
    lambda t: _verdicts(t, lambda answer: fn.compare_list(answer, _wanted_list(), F.lit(False))),
    _answered(f"SELECT event_id, {_LIST_COLUMNS} FROM ({_LIST_PARTS})"),
)
register(
    "q9_missing_extra",
    lambda t: fn.with_answer(_responses(t), _response())[0]
    .where(F.col("answer_items").isNotNull())
    .select(
        "event_id",
        F.array_join(fn.missing_items(F.col("answer_items"), _wanted_list()), "|").alias("missing"),
        F.array_join(fn.extra_items(F.col("answer_items"), _wanted_list()), "|").alias("extra"),
    ),
    _answered(
        f"""SELECT event_id, array_to_string(missing, '|') AS missing, array_to_string(extra, '|') AS extra
        FROM ({_LIST_PARTS}) WHERE items IS NOT NULL"""
    ),
)
def _kind_of_four():
    return (
        F.when(F.col("event_id") % 4 == 0, "integer")
        .when(F.col("event_id") % 4 == 1, "string_match")
        .when(F.col("event_id") % 4 == 2, "list")
        .otherwise("essay")
    )


register(
    "q10_compare",
    lambda t: _verdicts(
        t,
        lambda answer: fn.compare(
            answer,
            {
                "answer_type": _kind_of_four(),
                "expected_int": F.col("expected_int"),
                "expected_list": F.when(F.col("event_id") % 4 == 1, _wanted()).otherwise(_wanted_list()),
                "tolerance": F.col("tolerance"),
                "case_sensitive": F.lit(None).cast("boolean"),
                "order_matters": F.lit(None).cast("boolean"),
            },
        ),
    ),
    _answered(
        f"""SELECT event_id, {_INT_COLUMNS} FROM ({_INT_VERDICT}) WHERE event_id % 4 = 0
        UNION ALL BY NAME SELECT event_id, {_TEXT_COLUMNS} FROM ({_TEXT_INPUT}) WHERE event_id % 4 = 1
        UNION ALL BY NAME SELECT event_id, {_LIST_COLUMNS} FROM ({_LIST_PARTS}) WHERE event_id % 4 = 2
        UNION ALL BY NAME SELECT event_id, false AS correct, CAST(NULL AS BIGINT) AS difference, {_PLAIN} AS answer,
          'Unknown answer type: essay' AS reason FROM answers WHERE event_id % 4 = 3"""
    ),
)
_WORDS = "|".join(fn.ACCEPT_WORDS)
_VERDICT = f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false
    ELSE regexp_matches(lower(verdict_text), '{_WORDS}') END AS acceptable,
  CASE event_id % 5 WHEN 0 THEN 'fine' WHEN 1 THEN 'short' WHEN 3 THEN 'No reasoning provided'
    ELSE 'Could not parse JSON evaluation. Used heuristic.' END AS reasoning,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'more' WHEN 3 THEN ''
    ELSE CASE WHEN regexp_matches(lower(verdict_text), '{_WORDS}') THEN '' ELSE verdict_text END END AS suggestions
  FROM v_responses"""
register(
    "q11_parse_verdict",
    lambda t: _responses(t)
    .select("event_id", fn.parse_verdict(F.col("verdict_text")).alias("v"))
    .select("event_id", "v.*"),
    sql(_VERDICT, "v_responses"),
)


def _tries(t: Tables) -> DataFrame:
    return _responses(t).select(
        F.floor(F.col("event_id") / 6).alias("task_id"),
        (F.col("event_id") % 6 + 1).alias("iteration"),
        ((F.col("event_id") * 7 + F.floor(F.col("event_id") / 6)) % 5 == 0).alias("acceptable"),
        _response().alias("content"),
    )


register(
    "q12_retry_outcome",
    lambda t: ops.retry_outcome(_tries(t), 3),
    sql(
        """SELECT task_id, CAST(coalesce(ok, 3) AS INTEGER) AS iterations_used,
          ok IS NULL AS max_iterations_reached, content FROM (
            SELECT *, min(CASE WHEN acceptable THEN iteration END) OVER (PARTITION BY task_id) AS ok,
              max(iteration) OVER (PARTITION BY task_id) AS last FROM (
              SELECT event_id // 6 AS task_id, event_id % 6 + 1 AS iteration,
                (event_id * 7 + event_id // 6) % 5 = 0 AS acceptable, response AS content
              FROM v_responses) WHERE iteration <= 3)
        WHERE iteration = coalesce(ok, last)""",
        "v_responses",
    ),
)


# The ids of all questions.
_QUESTIONS = (
    "q1_error_count", "q2_total_lines", "q3_top_component", "q4_top3_components", "q5_peak_error_hour",
    "q6_warning_count", "q7_level_types", "q8_error_ratio", "q9_unique_nodes", "q10_busiest_node",
    "q11_has_fatal", "q12_component_most_errors", "q13_info_error_ratio", "q14_info_vs_warning",
    "q15_quietest_hour", "q16_busiest_hour", "q17_nodes_vs_components", "q18_hours_with_errors",
)


def _scored(t: Tables) -> DataFrame:
    """Every response as an answer to one of the questions, each of which gets its share."""
    questions = generate_questions(log_facts(t.parsed()))
    number = (F.col("event_id") % len(_QUESTIONS) + 1).cast("int")
    responses = _responses(t).select(
        "event_id",
        _response(),
        F.concat(F.lit("cfg"), (F.col("event_id") % 4).cast("string")).alias("config_name"),
        F.element_at(F.array(*map(F.lit, _QUESTIONS)), number).alias("question_id"),
        F.col("expected_int").alias("tokens_input"),
        (F.col("event_id") % 9).alias("tokens_output"),
    )
    return ops.score_answers(responses, questions)


_IDS = ", ".join(f"'{name}'" for name in _QUESTIONS)
_EXPECTED = "string_split(q.expected_texts, '|')"
_SCORED = f"""SELECT concat('cfg', CAST(event_id % 4 AS varchar)) AS config_name, q.id AS question_id,
    coalesce(CASE q.answer_type
      WHEN 'integer' THEN abs({_INT} - q.expected_int) <= q.tolerance
      WHEN 'string_match' THEN len(list_filter({_EXPECTED},
        lambda x: contains(lower(trim(plain)), lower(x)) OR contains(lower(x), lower(trim(plain))))) > 0
      ELSE {_FOLD.format("items")} = {_FOLD.format(_EXPECTED)} END, false) AS correct,
    a IS NULL AS failed,
    CASE WHEN a IS NULL THEN 0 ELSE r.expected_int + event_id % 9 END AS tokens
  FROM ({_LIST_INPUT}) r JOIN quest q ON q.id = [{_IDS}][event_id % {len(_QUESTIONS)} + 1]"""
register(
    "q13_score_answers",
    lambda t: _scored(t)
    .groupBy("config_name", "question_id")
    .agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("correct"),
        F.count("error").alias("errors"),
        F.sum("tokens_total").alias("tokens"),
    ),
    sql("SELECT 1", "ph", "v_responses").replace(
        "\nSELECT 1",
        ",\n"
        + _FACTS
        + ",\nquest AS ("
        + _QUESTION_SQL
        + "),\n"
        + _ANSWERS
        + f"""\nSELECT config_name, question_id, count(*) AS n, count(*) FILTER (correct) AS correct,
        count(*) FILTER (failed) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM ({_SCORED}) GROUP BY 1, 2""",
    ),
)


def _grid(t: Tables) -> DataFrame:
    configs = (
        t.view("v_results")
        .select("config_name", "workflow")
        .distinct()
        .select("config_name", F.col("workflow").alias("task"))
    )
    cases = t.table("events").select(
        F.col("event_id").alias("case_id"),
        F.when(F.col("event_type").isin("view", "click"), "simple").otherwise("evaluator").alias("task"),
    )
    return ops.experiment_grid(configs, cases)


register(
    "d4_experiment_grid",
    _grid,
    sql(
        """SELECT task, config_name, case_id FROM (SELECT DISTINCT config_name, workflow AS task FROM v_results)
        JOIN (SELECT event_id AS case_id, CASE WHEN event_type IN ('view', 'click') THEN 'simple' ELSE 'evaluator' END AS task
          FROM events) USING (task)""",
        "v_results",
    ),
)
register(
    "e22_config_summary",
    lambda t: _rounded(ops.config_summary(t.view("v_results")), "accuracy", "avg_time", "avg_tokens"),
    sql(
        """SELECT config_name, count(*) FILTER (correct) AS correct, count(*) AS total,
        round(count(*) FILTER (correct) / count(*) * 100, 6) AS accuracy, round(avg(time_seconds), 6) AS avg_time,
        CAST(sum(tokens_total) AS BIGINT) AS total_tokens, round(sum(tokens_total) / count(*), 6) AS avg_tokens
        FROM v_results GROUP BY config_name""",
        "v_results",
    ),
)


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.round(name, 6))
    return frame


_CONFUSION = """SELECT run, count(*) FILTER (expected = 1 AND predicted = 1) AS "TP",
    count(*) FILTER (expected = 0 AND predicted = 0) AS "TN", count(*) FILTER (expected = 0 AND predicted = 1) AS "FP",
    count(*) FILTER (expected = 1 AND predicted = 0) AS "FN", count(predicted) AS n FROM v_predictions GROUP BY run"""
_RATES = f"""SELECT *, CASE WHEN n > 0 THEN ("TP" + "TN") / n ELSE 0 END AS a,
    CASE WHEN "TP" + "FP" > 0 THEN "TP" / ("TP" + "FP") ELSE 0 END AS pr,
    CASE WHEN "TP" + "FN" > 0 THEN "TP" / ("TP" + "FN") ELSE 0 END AS re FROM ({_CONFUSION})"""
register(
    "e24_confusion_metrics",
    lambda t: ops.confusion_metrics(t.view("v_predictions"), "run"),
    sql(
        f"""SELECT run, "TP", "TN", "FP", "FN", round_even(a * 10000, 0) / 10000 AS accuracy,
        round_even(pr * 10000, 0) / 10000 AS precision, round_even(re * 10000, 0) / 10000 AS recall,
        round_even(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * 10000, 0) / 10000 AS f1
        FROM ({_RATES})""",
        "v_predictions",
    ),
)
register(
    "e25_unparseable_and_total",
    lambda t: ops.unparseable_and_total(t.view("v_predictions"), "run"),
    sql(
        """SELECT run, count(*) FILTER (predicted IS NULL) AS unparseable, count(*) AS total
        FROM v_predictions GROUP BY run""",
        "v_predictions",
    ),
)
