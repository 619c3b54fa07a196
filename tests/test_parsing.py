"""Lines for parsers, bodies and templates, with results worked out by hand."""

from pyspark.sql import functions as F

from cairnlog.functions import parsing as p
from cairnlog.operators.templates import check_template, refine_template

HEAD = "190203 141516 21 "
ALLOCATION = HEAD + "INFO fs.Names: allocate /jobs/7/out-3 as blk_41 now"
FAILING_WRITE = HEAD + "ERROR fs.Node: write of blk_-42 to 10.1.2.3:4040 ended after 17, 0x2f left"
DELETION = HEAD + "WARN fs.Names: drop blk_43 (-1.5) from 10.1.2.4; x7 stays"
TEMPLATES = {
    ALLOCATION: "allocate <*> as <*> now",
    FAILING_WRITE: "write of <*> to <*>:<*> ended after <*>, <*> left",
    DELETION: "drop <*> (-1.5) from <*>; x7 stays",
}
# One token of every kind, with what a template has in its place.
TOKENS = {
    "blk_5": "<*>", "blk_-5": "<*>", "8": "<*>", "-8": "<*>", "8.25": "<*>", "0xBeef": "<*>", "/a/b.c": "<*>",
    "10.1.2.3": "<*>", "/10.1.2.3": "<*>", "10.1.2.3:99": "<*>:<*>", "/10.1.2.3:99": "<*>:<*>",
    "word": "word", "blk5": "blk5", "8x": "8x", "a/b": "a/b", "k=8": "k=8", "(8": "(8", "--8": "--8",
}


def apply(spark, function, *values):
    rows = spark.createDataFrame([tuple(v) if isinstance(v, tuple) else (v,) for v in values])
    return [r[0] for r in rows.select(function(*(F.col(c) for c in rows.columns))).collect()]


def test_openstack(spark):
    line = "2019-03-04 05:06:07.089 4711 INFO nova.front [req-8 u p] 172.16.0.9 [ok] took: 12"
    plain = "2019-03-04 05:06:07.089 INFO nova.scheduler.host [req-9] host chosen"
    found = apply(spark, p.parse_openstack, line, plain, "nothing here")
    assert found[1].asDict() == {
        "timestamp": "2019-03-04 05:06:07.089", "level": "INFO",
        "component": "nova.scheduler.host", "message": "host chosen",
    }
    # The process number takes the place of the level; the last bracket wins.
    assert found[0]["level"] == "4711" and found[0]["message"] == "took: 12"
    assert found[2] is None


def test_bgl_and_generic(spark):
    line = "- 99 2011.07.31 R40-M0 2011-07-31-07.08.09.000123 R40-M0 RAS APP FATAL node  card lost "
    found = apply(spark, p.parse_bgl_node, line, "too short")
    assert tuple(found[0]) == ("2011-07-31-07.08.09.000123", "R40-M0", "FATAL", "APP", "node  card lost")
    assert found[1] is None
    found = apply(spark, p.parse_generic, "t1 INFO two  words", "t1 INFO", "one", "")
    assert [tuple(x) if x else None for x in found] == [
        ("t1", "INFO", "", "two  words"), ("t1", "INFO", "", ""), None, None]
    assert apply(spark, p.line_format, line, "a b", "a") == ["bgl", "generic", "generic"]


def test_block_headers(spark):
    bodies = apply(spark, p.message_body, *TEMPLATES, "190203 141516 INFO fs.Node: no process number", "no header")
    assert bodies[0] == "allocate /jobs/7/out-3 as blk_41 now"
    assert bodies[3:] == ["no process number", "no header"]
    assert apply(spark, p.mine_template, *bodies[:3]) == list(TEMPLATES.values())
    assert apply(spark, p.block_id, DELETION, "blk_-12 blk_3", "none") == ["blk_43", "blk_-12", None]


def test_tokens_before_punctuation(spark):
    ends = ["", ".", ",", ";", ":", ")"]
    bodies = [f"at {token}{end} end" for token in TOKENS for end in ends]
    expected = [f"at {shape}{end} end" for shape in TOKENS.values() for end in ends]
    assert apply(spark, p.mine_template, *bodies) == expected
    assert apply(spark, p.mine_template, "", "8", "8!", "8..") == ["", "<*>", "8!", "8.."]


def test_template_critic_and_refiner(spark):
    body, half = "allocate /jobs/7/out-3 as blk_41 now", "write of blk_<*> to <*>:<*> ended after 17, 0x2f left"
    found = apply(spark, check_template, (ALLOCATION, body), (FAILING_WRITE, half), (DELETION, "drop"), (DELETION, TEMPLATES[DELETION]))
    assert [x["template"] for x in found] == [*TEMPLATES.values(), TEMPLATES[DELETION]]
    assert [x["is_correct"] for x in found] == [False, False, False, True]
    found = apply(spark, refine_template, (ALLOCATION, body, TEMPLATES[ALLOCATION]), (FAILING_WRITE, TEMPLATES[FAILING_WRITE], half),
                  (DELETION, "drop", "drop <*>"))
    assert [x["template"] for x in found] == list(TEMPLATES.values())
    assert [x["chosen"] for x in found] == ["critic", "parser", "mined"]


def test_hour_of(spark):
    assert apply(spark, p.hour_of, "2011-07-31-15.08.09.1", "2011.07.31", "a-b-c-07") == ["15", None, "07"]


def test_lines_with_separators_of_other_kinds_parse(spark):
    line = "2019-03-04 05:06:07.089 INFO nova.x [r] one\u2028two\u0085three"
    assert apply(spark, p.parse_openstack, line)[0]["message"] == "one\u2028two\u0085three"
