"""Sessions of every rule, and a session with most of the lines."""

import hashlib

from pyspark.sql import functions as F

from cairnlog.operators import sessions as s

NODES = ("10.1.2.3:50", "10.1.2.4:50")
# What each event of a life cycle says, from the texts the rules look for.
SAYS = {
    "allocate": s.ALLOCATED, "begin": s.RECEIVING, "end": s.RECEIVED, "responder": s.TERMINATING,
    "delete": s.DELETED[1], "delete name": s.DELETED[0],
    "store": f"{s.STORED}: blockMap updated: {NODES[0]} is added to",
    "store again": f"{s.STORED}: blockMap updated: {NODES[1]} is added to",
}
# A session for every rule: its events, whether it is anomalous for HDFS and in general.
RULES = {
    **{f"word {word}": (["begin", "end", "store", f"one {word.upper()}s"], 1, 1) for word in s.FAILURE_WORDS},
    "whole": (["allocate", "begin", "end", "responder", "store", "store again", "store again"], 0, 0),
    "stored but not allocated": (["store"], 0, 0),
    "allocated but not stored": (["allocate"], 1, 0),
    "failures repeat": (["store", "a crash", "a fatal crash"], 1, 1),
    "deleted after it was stored": (["begin", "end", "store", "delete"], 0, 0),
    "deleted before it was stored": (["delete name", "store"], 0, 0),
    "only deleted": (["delete"], 1, 0),
    "reception without end": (["begin"], 1, 1),
    "reception ended by the responder": (["begin", "responder"], 1, 0),
    "reception ended": (["begin", "end"], 1, 0),
    "received first": (["end", "allocate", "store"], 0, 0),
    "nothing known": (["hello"], 1, 0),
}


def keyed(spark, sessions):
    rows = [
        (name, n, f"{SAYS.get(event, event)} blk_{i}")
        for i, (name, events) in enumerate(sessions.items())
        for n, event in enumerate(events)
    ]
    return spark.createDataFrame(rows, "session_id string, line_no long, raw_line string")


def labelled(spark, profile):
    features = s.with_behaviour(s.session_features(keyed(spark, {name: rule[0] for name, rule in RULES.items()})))
    found = s.explain_sessions(s.with_signals(s.with_label(features, profile)))
    return {row["session_id"]: row for row in found.collect()}


def test_labels_by_rule(spark):
    for profile, place in (("hdfs", 1), ("generic", 2)):
        found = labelled(spark, profile)
        assert {name: row["label"] for name, row in found.items()} == {n: rule[place] for n, rule in RULES.items()}
        names = {0: "NORMAL", 1: "ANOMALOUS"}
        assert all(row["explanation"]["classification"] == names[row["label"]] for row in found.values())


def test_behaviour_and_signals(spark):
    found = labelled(spark, "hdfs")

    def having(flag):
        return {name for name, row in found.items() if row[flag]}

    assert having("missing_storage") == {"allocated but not stored"}
    assert having("unfinished") == {"reception without end"}
    assert having("repeated_failures") == {"failures repeat"}
    assert having("received_first") == {"received first"}
    assert having("early_end") == {"allocated but not stored", "reception without end"}
    assert found["whole"]["storing_nodes"] == 2
    assert found["whole"]["signals"] == ["the block was received", "stored by 2 nodes", "the responder ended"]
    assert found["failures repeat"]["signals"] == ["a failure is named", "failures repeat"]
    ends = ["the operation stops early", "no node stored the block", "life cycle cut short"]
    assert found["reception without end"]["signals"] == ends
    assert "deleted after it was stored" in found["deleted after it was stored"]["signals"]
    assert "No block storage confirmation" in found["only deleted"]["explanation"]["key_evidence"]
    assert "2 events with a failure word" in found["failures repeat"]["explanation"]["key_evidence"]


def test_critic(spark):
    features = s.with_behaviour(s.session_features(keyed(spark, {name: rule[0] for name, rule in RULES.items()})))
    for proposed in (0, 1):
        found = s.critique_labels(features.withColumn("proposed_label", F.lit(proposed)), "generic").collect()
        for row in found:
            # Without any event there is nothing to say against the proposal.
            final = proposed if row["session_id"] == "nothing known" else RULES[row["session_id"]][2]
            assert (row["final_label"], row["changed"]) == (final, final != proposed)


def hot_lines(spark):
    rows = [(n, f"line {n} of blk_{7 if n % 3 else n}") for n in range(1, 301)] + [(301, "nothing")]
    return spark.createDataFrame(rows, "line_no long, raw_line string")


def test_a_hot_session_is_rows_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(s, "LINES_PER_SEGMENT", 50)
    events = s.extract_sessions(hot_lines(spark))
    hot = sorted((r for r in events.collect() if r["session_id"] == "blk_7"), key=lambda r: r["event_no"])
    assert [(r["event_no"], r["line_no"]) for r in hot] == list(enumerate((n for n in range(1, 301) if n % 3), 1))
    assert {(r["n_events"], r["first_line"]) for r in hot} == {(200, 1)}
    assert events.count() == 300
    text = sorted((r["row_no"], r["text"]) for r in s.format_sessions(events).collect() if r["session_id"] == "blk_7")
    assert text[0] == (0, "=== Block Session: blk_7 (200 events) ===") and len(text) == 201


def test_sessions_follow_files(spark):
    rows = [("b.log", n, f"b{n} blk_1") for n in (1, 2)] + [("a.log", n, f"a{n} blk_1") for n in (1, 2, 3)]
    lines = spark.createDataFrame(rows, "file string, line_no long, raw_line string")
    found = s.extract_sessions(lines).orderBy("event_no").collect()
    assert [r["raw_line"][:2] for r in found] == ["a1", "a2", "a3", "b1", "b2"]


def test_first_sessions(spark):
    lines = hot_lines(spark)
    assert s.first_sessions(lines, 2).select("session_id").distinct().count() == 2
    assert s.first_sessions(lines, 0).count() == 300


def test_first_sessions_follow_files(spark):
    rows = [("b.log", n, f"line {n} of blk_{n}") for n in range(1, 9)]
    rows += [("a.log", 50 + n, f"line of blk_{50 + n}") for n in range(3)] + [("a.log", 60, "again blk_5")]
    lines = spark.createDataFrame(rows, "file string, line_no long, raw_line string")
    for n, expected in ((3, {"blk_50", "blk_51", "blk_52"}), (5, {"blk_50", "blk_51", "blk_52", "blk_5", "blk_1"})):
        found = s.first_sessions(lines, n)
        assert {row["session_id"] for row in found.collect()} == expected


def test_balanced_sample_ranks_one_cell_of_the_order(spark, monkeypatch):
    ids = [(f"b{i}", int(i % 3 == 0)) for i in range(3000)] + [("only", 2), (None, 0), ("lost", None)]
    labels = spark.createDataFrame(ids, "block_id string, label int")
    ranked = []
    number = s.number_in_groups
    monkeypatch.setattr(s, "CELL_DIGITS", 2)
    monkeypatch.setattr(s, "number_in_groups", lambda rows, *rest: (ranked.append(rows.count()), number(rows, *rest))[1])
    for n in (0, 1, 2, 301, 1999, 2000, 2001, 9000):
        found = [tuple(row) for row in s.balanced_sample(labels, n).collect()]
        expected = []
        for label in (0, 1, 2):
            own = sorted((hashlib.md5(f"42:{b}".encode()).hexdigest() if b else "", b or "") for b, x in ids if x == label)
            expected += [(b or None, label) for _, b in own[: n // 2]]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
    # About 12 ids to a cell and label, however many are wanted.
    assert max(ranked) <= 60


def test_balanced_sample(spark):
    labels = spark.range(100).select(F.concat(F.lit("b"), "id").alias("block_id"), (F.col("id") < 4).cast("int").alias("label"))
    found = s.balanced_sample(labels, 20).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in found} == {0: 10, 1: 4}
    assert s.balanced_sample(labels, None).count() == 100
