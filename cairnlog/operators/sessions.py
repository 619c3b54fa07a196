"""Block sessions: grouping, features, labels, critics and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import block_id, message_body
from ..functions.text import mentions
from ..plans.durable import materialise
from ..plans.numbering import number_in_groups
from ..plans.once import add_once

LINES_PER_SEGMENT = 65_536
# Words that mark an explicit failure, any case.
FAILURE_WORDS = ("error", "fail", "exception", "crash", "interrupt", "fatal")
# Texts of the block life cycle.
ALLOCATED, RECEIVING, RECEIVED = "allocateBlock", "Receiving block", "Received block"
STORED, TERMINATING = "addStoredBlock", "terminating"
DELETED = ("NameSystem.delete", "Deleting block")
STORING_NODE = r"blockMap updated: (\S+) is added to"


def session_lines(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """Lines with the ``session_id`` of the first block they name; others are dropped."""
    keyed = add_once(lines, {"session_id": block_id(F.col(value))})
    return keyed.where(F.col("session_id").isNotNull())


def extract_sessions(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """One row per event of a session: ``session_id, event_no, line_no``, the line,
    ``first_line, n_events``.

    ``event_no`` runs from 1 in line order; with a ``file`` column files follow each
    other by name. Events are rows, so a session of any size has the same shape.
    """
    keyed = session_lines(lines, value)
    order = [name for name in ("file", "line_no") if name in keyed.columns]
    keyed = keyed.select("session_id", *order, value)
    segment = F.struct(*order[:-1], F.floor(F.col("line_no") / LINES_PER_SEGMENT).alias("part"))
    numbered = number_in_groups(
        keyed,
        ["session_id"],
        segment,
        [F.col(name) for name in order],
        "event_no",
        whole={"_first": (F.min(F.struct(*order)), F.min), "n_events": (F.count(F.lit(1)), F.sum)},
    )
    return numbered.select(
        "session_id",
        "event_no",
        *order,
        value,
        F.col("_first.line_no").alias("first_line"),
        "n_events",
    )


def first_sessions(lines: DataFrame, n: int = 10, value: str = "raw_line") -> DataFrame:
    """Lines of the first ``n`` sessions by first appearance; 0 keeps all.

    With a ``file`` column files follow each other by name, as in ``extract_sessions``.
    """
    keyed = session_lines(lines, value)
    if n <= 0:
        return keyed
    order = [name for name in ("file", "line_no") if name in keyed.columns]
    # Sessions that start on one line do not exist: a line belongs to one session.
    starts = keyed.groupBy("session_id").agg(F.min(F.struct(*order)).alias("_first"))
    return keyed.join(starts.orderBy("_first").limit(n), "session_id", "left_semi")


def format_sessions(sessions: DataFrame, value: str = "raw_line") -> DataFrame:
    """Sessions as lines of text, ``row_no`` 0 being a header: one row per line."""
    header = F.format_string(
        "=== Block Session: %s (%d events) ===", F.col("session_id"), F.col("n_events")
    )
    event = F.struct(F.col("event_no").alias("row_no"), F.col(value).alias("text"))
    first = F.struct(F.lit(0).cast("long").alias("row_no"), header.alias("text"))
    rows = F.when(F.col("event_no") == 1, F.array(first, event)).otherwise(F.array(event))
    return sessions.select("session_id", F.inline(rows))


#: Hex digits of a digest that make a cell of the shuffled order.
CELL_DIGITS = 3


def _cut_cells(cells: DataFrame, wanted: int) -> DataFrame:
    """``label, _cut, _rest`` from counts of cells: the cell that holds the last wanted id of
    a label, and how many of the cell's ids are wanted. Labels with fewer ids have none."""
    before = F.sum("n").over(
        Window.partitionBy("label").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per label and cell: at most 16 ** CELL_DIGITS to a label.
    running = cells.withColumn("_before", F.coalesce(before, F.lit(0)))
    return running.where(
        (F.col("_before") < wanted) & (F.col("_before") + F.col("n") >= wanted)
    ).select("label", F.col("_cell").alias("_cut"), (wanted - F.col("_before")).alias("_rest"))


def balanced_sample(
    labels: DataFrame, n: int | None, seed: int = 42, *, order: Column | None = None
) -> DataFrame:
    """``n // 2`` ids per label, or all ids when a label has fewer; ``n`` None keeps all.

    ``order`` is a hex digest that shuffles the ids; by default one of seed and id. Counts
    of digest prefixes tell up to which prefix ids are wanted: rows beyond it go at once,
    rows before it stay, and only those of the last prefix are ranked.
    """
    if n is None:
        return labels
    wanted = max(n // 2, 0)
    digest = order if order is not None else F.md5(F.concat(F.lit(f"{seed}:"), "block_id"))
    shuffled = labels.where(F.col("label").isNotNull() & F.lit(wanted > 0)).withColumn(
        "_digest", F.coalesce(digest, F.lit(""))
    )
    shuffled = shuffled.withColumn("_cell", F.substring("_digest", 1, CELL_DIGITS))
    cells = shuffled.groupBy("label", "_cell").agg(F.count(F.lit(1)).alias("n"))
    cuts = materialise(_cut_cells(cells, wanted), "sample-cuts")
    placed = shuffled.join(cuts, "label", "left")
    sure = placed.where(F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut")))
    ranked = number_in_groups(
        placed.where(F.col("_cell") == F.col("_cut")),
        ["label"],
        F.substring("_digest", CELL_DIGITS + 1, CELL_DIGITS),
        [F.col("_digest"), F.col("block_id")],
        "_place",
    )
    last = ranked.where(F.col("_place") <= F.col("_rest"))
    return sure.select(*labels.columns).unionByName(last.select(*labels.columns))


def sessions_with_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    return sessions.join(labels, "block_id")


def selected_sessions(ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """Selected ids that have a session."""
    return ids.join(sessions, "block_id", "left_semi")


def missing_sessions(ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """Selected ids without a session."""
    return ids.join(sessions, "block_id", "left_anti")


def textual_signals(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """Per session: lines that name a failure, and which words occur."""
    body = message_body(F.col(value))
    keyed = session_lines(lines, value).select("session_id", F.lower(body).alias("body"))
    counted = keyed.groupBy("session_id").agg(
        F.count_if(mentions(F.col("body"), FAILURE_WORDS)).alias("failure_lines"),
        *(F.count_if(F.col("body").contains(w)).alias(f"_{w}") for w in FAILURE_WORDS),
    )
    words = F.array_compact(F.array(*(F.when(F.col(f"_{w}") > 0, w) for w in FAILURE_WORDS)))
    return counted.select("session_id", "failure_lines", words.alias("words"))


def session_features(keyed: DataFrame, value: str = "raw_line") -> DataFrame:
    """Life-cycle counts per session of lines that carry a ``session_id``.

    Lines are summed up per (session, storing node) first. Sessions are then put
    together from those few rows, which also makes the distinct count of nodes a plain
    count and leaves little to shuffle for a session with very many lines.
    """
    body = message_body(F.col(value))
    node = F.regexp_extract("body", STORING_NODE, 1)
    deleted = F.col("body").contains(DELETED[0]) | F.col("body").contains(DELETED[1])
    tests = {
        "allocated": F.col("body").contains(ALLOCATED),
        "receiving": F.col("body").contains(RECEIVING),
        "received": F.col("body").contains(RECEIVED),
        "stored": F.col("body").contains(STORED),
        "terminating": F.col("body").contains(TERMINATING),
        "deleted": deleted,
        "failures": mentions(F.lower("body"), FAILURE_WORDS),
    }
    places = {"first_allocated": "allocated", "first_received": "received"}
    per_node = (
        keyed.select("session_id", "line_no", body.alias("body"))
        .groupBy("session_id", F.when(node != "", node).alias("node"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            *(F.count_if(test).alias(name) for name, test in tests.items()),
            *(F.min(F.when(tests[t], F.col("line_no"))).alias(n) for n, t in places.items()),
        )
    )
    return per_node.groupBy("session_id").agg(
        F.sum("events").alias("events"),
        *(F.sum(name).alias(name) for name in tests),
        F.count("node").alias("storing_nodes"),
        *(F.min(name).alias(name) for name in places),
    )


def lifecycle_features(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """``session_features`` of raw lines."""
    return session_features(session_lines(lines, value), value)


def with_behaviour(features: DataFrame) -> DataFrame:
    """Add what is irregular about the life cycle."""
    c = F.col
    return (
        features.withColumn("missing_storage", (c("allocated") > 0) & (c("stored") == 0))
        .withColumn(
            "unfinished",
            (c("receiving") > 0) & (c("received") == 0) & (c("terminating") == 0),
        )
        .withColumn("repeated_failures", c("failures") >= 2)
        .withColumn(
            "received_first",
            F.coalesce(c("first_received") < c("first_allocated"), F.lit(False)),
        )
        .withColumn(
            "early_end",
            ((c("allocated") > 0) | (c("receiving") > 0))
            & (c("stored") == 0)
            & (c("received") == 0)
            & (c("terminating") == 0),
        )
    )


def hdfs_label() -> Column:
    """1 for an explicit failure or no storage confirmation; deletion after storage is normal."""
    return F.when((F.col("failures") > 0) | (F.col("stored") == 0), 1).otherwise(0)


def generic_label() -> Column:
    """1 for an explicit failure or a reception that neither completes nor terminates."""
    return F.when((F.col("failures") > 0) | F.col("unfinished"), 1).otherwise(0)


PROFILES = {"hdfs": hdfs_label, "generic": generic_label}


def with_label(behaviour: DataFrame, profile: str = "hdfs") -> DataFrame:
    return behaviour.withColumn("label", PROFILES[profile]())


def signal_phrases() -> Column:
    """Up to three short phrases, most telling first, for a row with features and label."""
    c = F.col
    anomalous = [
        F.when(c("failures") > 0, "a failure is named"),
        F.when(c("repeated_failures"), "failures repeat"),
        F.when(c("early_end"), "the operation stops early"),
        F.when(c("stored") == 0, "no node stored the block"),
        F.when(c("early_end"), "life cycle cut short"),
        F.when(c("unfinished"), "reception has no end"),
        F.when(c("received_first"), "received before it was allocated"),
    ]
    nodes = F.format_string("stored by %d nodes", c("storing_nodes"))
    normal = [
        F.when(c("received") > 0, "the block was received"),
        F.when(c("storing_nodes") > 0, nodes),
        F.when(c("terminating") > 0, "the responder ended"),
        F.when(
            (c("deleted") > 0) & (c("stored") > 0),
            "deleted after it was stored",
        ),
        F.when(c("failures") == 0, "no failure is named"),
    ]
    chosen = F.when(c("label") == 1, F.array(*anomalous)).otherwise(F.array(*normal))
    return F.slice(F.array_compact(chosen), 1, 3)


def with_signals(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("signals", signal_phrases())


def critique_labels(proposed: DataFrame, profile: str = "hdfs") -> DataFrame:
    """Check ``proposed_label`` against the features beside it.

    A session with no failure and no life-cycle event gives no evidence either way and
    keeps its label.
    """
    c = F.col
    events = ("allocated", "receiving", "received", "stored", "terminating", "deleted")
    evidence = c("failures") > 0
    for name in events:
        evidence = evidence | (c(name) > 0)
    final = F.when(evidence, PROFILES[profile]()).otherwise(c("proposed_label"))
    return proposed.withColumn("final_label", final.cast("int")).withColumn(
        "changed", ~c("final_label").eqNullSafe(c("proposed_label"))
    )


def explanation() -> Column:
    """Classification, summary, key evidence and reasoning; the label is taken as given."""
    c = F.col
    anomalous, failed = c("label") == 1, c("failures") > 0
    summary = (
        F.when(
            anomalous & failed,
            F.format_string("The block operation failed: %d log events name a failure.", c("failures")),
        )
        .when(
            anomalous,
            "The block operation started but did not complete, so its execution is incomplete.",
        )
        .when(
            c("stored") > 0,
            F.format_string(
                "The block was received and stored on %d nodes without errors.", c("storing_nodes")
            ),
        )
        .otherwise("The block operation ran without errors.")
    )
    evidence = F.array_compact(
        F.array(
            F.when(failed, F.format_string("%d events with a failure word", c("failures"))),
            F.when(c("allocated") > 0, F.format_string("%d block allocations", c("allocated"))),
            F.when(c("receiving") > 0, F.format_string("%d block reception starts", c("receiving"))),
            F.when(c("received") > 0, F.format_string("%d completed receptions", c("received"))),
            F.when(c("stored") > 0, F.format_string("%d storage confirmations", c("stored"))),
            F.when(c("stored") == 0, "No block storage confirmation"),
            F.when(
                c("terminating") > 0,
                F.format_string("%d packet responder terminations", c("terminating")),
            ),
            F.when(c("deleted") > 0, F.format_string("%d deletion events", c("deleted"))),
        )
    )
    reasoning = (
        F.when(
            anomalous & failed,
            "An explicit failure disrupts the block lifecycle of allocation, reception, storage "
            "confirmation and termination, which justifies the anomalous classification.",
        )
        .when(
            anomalous,
            "Reception should be followed by storage confirmation and completion; these events "
            "are absent, which justifies the anomalous classification.",
        )
        .otherwise(
            "The events fit the expected block lifecycle and no failure indicator was observed, "
            "which supports the normal classification."
        )
    )
    return F.struct(
        F.when(anomalous, "ANOMALOUS").otherwise("NORMAL").alias("classification"),
        summary.alias("summary"),
        evidence.alias("key_evidence"),
        reasoning.alias("reasoning"),
    )


def explain_sessions(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("explanation", explanation())


def detect_and_explain(
    lines: DataFrame, profile: str = "hdfs", value: str = "raw_line"
) -> DataFrame:
    """Raw lines to labelled and explained sessions."""
    features = with_behaviour(lifecycle_features(lines, value))
    return explain_sessions(with_signals(with_label(features, profile)))
