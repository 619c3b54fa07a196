"""Cases of answer extraction, comparison and labels, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlog.functions import answers as fn
from cairnlog.operators.scoring import confusion_metrics, retry_outcome, score_answers

EXTRACTED = [
    ("7 of the 9 hosts replied", 7),
    ('They call it "DISK" here.', "DISK"),
    ('Result:\n```\n["DISK", "NET"]\n``` as asked', ["DISK", "NET"]),
    ('```json\n{"answer": "NET"}\n```', {"answer": "NET"}),
    (' {"answer": [3]} ', {"answer": [3]}),
    ("[true, null]", [True, None]),
    ("0088", 88),
    ("1" * 60 + " lines", int("1" * 60)),
    ('{"answer": 1, "answer": 2}', {"answer": 2}),
    # The innermost object wins over its wrapper.
    ('{"a": {"b": 1}}', {"b": 1}),
    ("Minus -7.5 degrees", 7),
    ("```json\nnot json\n``` but [4]", [4]),
]


def test_extract_json(spark):
    rows = spark.createDataFrame([(t,) for t, _ in EXTRACTED] + [("no idea",)], "text string")
    found = [r[0] for r in rows.select(fn.extract_json(F.col("text"))).collect()]
    assert [json.loads(x) for x in found[:-1]] == [value for _, value in EXTRACTED]
    assert found[-1] is None


COMPARED = [
    ('"none"', "integer", {"n": 31}, False),
    ("null", "integer", {"n": 31}, False),
    ("31.7", "integer", {"n": 31}, True),
    ('"some -31 lines"', "integer", {"n": 31}, True),
    ("28", "integer", {"n": 31, "tolerance": 2}, False),
    ("33", "integer", {"n": 31, "tolerance": 2}, True),
    ("31", "integer", {"n": 31}, True),
    ('""', "string_match", {"texts": ["DISK"]}, True),
    ('"disk"', "string_match", {"texts": ["DISK"]}, True),
    ('"disk"', "string_match", {"texts": ["DISK"], "case": True}, False),
    ('"It must be DISK, then"', "string_match", {"texts": ["DISK", "disk"]}, True),
    ('"net; fan\\n disk"', "list", {"texts": ["DISK", "NET", "FAN"]}, True),
    ('["NET", "DISK"]', "list", {"texts": ["DISK", "NET"], "order": True}, False),
    ('["NET", "DISK"]', "list", {"texts": ["DISK", "NET"]}, True),
    ("5", "list", {"texts": ["DISK"]}, False),
    ("5", "essay", {}, False),
]


def test_compare(spark):
    rows = [
        (a, kind, s.get("n"), s.get("texts"), s.get("tolerance"), s.get("case"), s.get("order"))
        for a, kind, s, _ in COMPARED
    ]
    frame = spark.createDataFrame(
        rows,
        "json string, answer_type string, expected_int long, expected_list array<string>, "
        "tolerance int, case_sensitive boolean, order_matters boolean",
    )
    spec = {c: F.col(c) for c in frame.columns[1:]}
    verdict = fn.compare(fn.read_answer(F.col("json")), spec)
    found = frame.select(verdict.alias("v")).select("v.*").collect()
    assert [r["correct"] for r in found] == [ok for *_, ok in COMPARED]
    assert found[4]["reason"] == "Incorrect: got 28, expected 31 (±2)"
    assert found[4]["difference"] == 3
    assert found[0]["reason"] == "Could not extract integer from: none"
    assert found[8]["reason"] == "Matched expected value: disk"
    assert found[-1]["reason"] == "Unknown answer type: essay"


@pytest.mark.parametrize(
    "text,label",
    [
        ('{"label": 0, "signals": ["1"]}', 0),
        ('{"label":1}', 1),
        ("081109 block 12345 is 1", 1),
        ("first 0 then 1", 1),
        ("The session looks NORMAL", 0),
        ("abnormal", 0),
        ("clearly anomalous", 1),
        ("7 or 23", None),
        ("no idea", None),
        (None, None),
    ],
)
def test_normalize_label(spark, text, label):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(fn.normalize_label(F.col("text"))).head()[0] == label


def test_parse_verdict(spark):
    texts = [
        '{"acceptable": true, "reasoning": "ok", "suggestions": ""}',
        'Sure:\n```json\n{"acceptable": false, "suggestions": "more"}\n```',
        '```\n{"acceptable": "false"}\n```',
        "This is not acceptable",
        "rejected",
        '{"other": 1}',
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = frame.select(fn.parse_verdict(F.col("text")).alias("v")).select("v.*").collect()
    assert [r["acceptable"] for r in found] == [True, False, True, True, False, False]
    assert found[1]["reasoning"] == "No reasoning provided"
    assert found[4]["suggestions"] == "rejected"


def test_retry_outcome(spark):
    rows = [("a", 1, False, "x"), ("a", 2, False, "y"), ("a", 3, True, "z"),
            ("b", 1, False, "p"), ("b", 2, False, "q"), ("b", 3, False, "r"), ("b", 4, True, "s"),
            ("c", 1, True, "k"), ("c", 2, False, "l")]
    frame = spark.createDataFrame(rows, "task_id string, iteration long, acceptable boolean, content string")
    found = {r["task_id"]: tuple(r)[1:] for r in retry_outcome(frame, 3).collect()}
    assert found == {"a": (3, False, "z"), "b": (3, True, "r"), "c": (1, False, "k")}


def test_score_answers(spark):
    questions = spark.createDataFrame(
        [("q1", "How many?", "integer", 5, None, 1, None, None),
         ("q2", "Which?", "string_match", None, ["APP"], None, False, None)],
        "id string, question string, answer_type string, expected_int long, "
        "expected_list array<string>, tolerance int, case_sensitive boolean, order_matters boolean",
    )
    responses = spark.createDataFrame(
        [("q1", '{"answer": 6}', "c", 10, 2), ("q2", '{"answer": "app"}', "c", 1, 1), ("q2", "hm", "c", 3, 4)],
        "question_id string, response string, config_name string, tokens_input long, tokens_output long",
    )
    found = sorted(score_answers(responses, questions).collect(), key=lambda r: (r["question_id"], r["correct"]))
    assert [r["correct"] for r in found] == [True, False, True]
    assert found[1]["error"].startswith("Could not extract valid JSON from response: hm")
    assert found[1]["tokens_total"] == 0 and found[0]["tokens_total"] == 12
    assert len(found[0]) == 19


def test_confusion_metrics_without_predictions(spark):
    frame = spark.createDataFrame([(1, None), (0, None)], "expected int, predicted int")
    row = confusion_metrics(frame).head()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
