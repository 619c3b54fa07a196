"""Run logs: from nested documents to flat tables, and questions about them.

Tables are keyed by ``session_id``, ``interaction_no`` and ``iteration_no`` (both from
0). Everything below ``flatten`` works on the flat tables, so a session of any length
is summed up by partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.durable import materialise

BAR_WIDTH = 50
_CALL_KEYS = ("session_id", "interaction_no", "iteration_no")


def interactions_table(runs: DataFrame) -> DataFrame:
    """One row per interaction of each run."""
    return runs.select(
        "session_id",
        F.col("duration").alias("run_duration"),
        F.posexplode("interactions").alias("interaction_no", "i"),
    ).select(
        "session_id",
        "run_duration",
        F.col("interaction_no").cast("long"),
        "i.agent",
        "i.parent",
        "i.message",
        "i.start_time",
        "i.duration",
        F.coalesce("i.total_tool_calls", F.lit(0)).alias("total_tool_calls"),
        F.coalesce(F.size("i.iterations"), F.lit(0)).cast("long").alias("n_iterations"),
        F.col("i.iterations").alias("_iterations"),
    )


def iterations_table(runs: DataFrame) -> DataFrame:
    """One row per iteration of each interaction."""
    return (
        interactions_table(runs)
        .select(
            "session_id",
            "interaction_no",
            "n_iterations",
            F.posexplode("_iterations").alias("iteration_no", "t"),
        )
        .select(
            "session_id",
            "interaction_no",
            F.col("iteration_no").cast("long"),
            "n_iterations",
            F.col("t.iteration").alias("iteration"),
            F.col("t.timestamp").alias("timestamp"),
            F.col("t.response").alias("response"),
            F.col("t.tool_calls").alias("tool_calls"),
            F.col("t.tool_call_results").alias("tool_call_results"),
            F.col("t.model_info.usage.input_tokens").alias("input_tokens"),
            F.col("t.model_info.usage.output_tokens").alias("output_tokens"),
            F.col("t.model_info.usage.total_tokens").alias("total_tokens"),
        )
    )


def tool_calls_table(iterations: DataFrame) -> DataFrame:
    return iterations.select(*_CALL_KEYS, F.explode("tool_calls").alias("c")).select(
        *_CALL_KEYS, "c.name", "c.arguments", "c.id"
    )


def tool_results_table(iterations: DataFrame) -> DataFrame:
    return iterations.select(*_CALL_KEYS, F.explode("tool_call_results").alias("c")).select(
        *_CALL_KEYS, "c.name", "c.id", "c.result"
    )


def tool_call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its results; calls without one are kept."""
    match = F.col("c.name") == F.col("r.name")
    for key in _CALL_KEYS:
        match = match & (F.col(f"c.{key}") == F.col(f"r.{key}"))
    match = match & F.col("c.id").eqNullSafe(F.col("r.id"))
    return (
        calls.alias("c")
        .join(results.alias("r"), match, "left")
        .select(*(f"c.{k}" for k in _CALL_KEYS), "c.name", "c.id", "r.result")
    )


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls per tool."""
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def token_usage(iterations: DataFrame) -> DataFrame:
    """Tokens summed over every iteration of a session."""

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return iterations.groupBy("session_id").agg(
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        (total("input_tokens") + total("output_tokens")).alias("total_tokens"),
    )


def last_iteration_tokens(interactions: DataFrame, iterations: DataFrame) -> DataFrame:
    """Token use of the last iteration of each session's last interaction."""
    last = interactions.groupBy("session_id").agg(F.max("interaction_no").alias("interaction_no"))
    picks = [
        F.coalesce(F.max_by(F.col(name), F.col("iteration_no")), F.lit(0)).alias(name)
        for name in ("input_tokens", "output_tokens", "total_tokens")
    ]
    ends = iterations.groupBy("session_id", "interaction_no").agg(*picks)
    return last.join(ends, ["session_id", "interaction_no"], "left").drop("interaction_no")


def run_timeline(interactions: DataFrame) -> DataFrame:
    """Start and length of each interaction's bar; no bar where times are unknown."""
    total, start, length = F.col("run_duration"), F.col("start_time"), F.col("duration")
    known = total.isNotNull() & (total != 0) & length.isNotNull()
    begin = F.try_divide(F.coalesce(start, F.lit(0.0)), total) * BAR_WIDTH
    bar_start = F.when(known, begin.cast("int"))
    wanted = F.greatest(F.lit(1), (F.try_divide(length, total) * BAR_WIDTH).cast("int"))
    shown = F.greatest(
        F.lit(0), F.least(F.col("bar_start") + wanted, F.lit(BAR_WIDTH)) - F.col("bar_start")
    )
    return (
        interactions.withColumn("bar_start", bar_start)
        .withColumn("bar_length", F.when(known, shown).otherwise(0))
        .select(
            "session_id", "interaction_no", "agent", "parent", "start_time", "duration",
            "bar_start", "bar_length",
        )
    )


def run_iterations(iterations: DataFrame) -> DataFrame:
    """Each iteration with its tool names, or ``(response)``, and whether it is the last."""
    names = F.array_join(F.transform("tool_calls", lambda c: c["name"]), ", ")
    called = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    return iterations.select(
        *_CALL_KEYS,
        "iteration",
        "timestamp",
        F.when(called, names).otherwise("(response)").alias("tools"),
        (F.col("iteration_no") == F.col("n_iterations") - 1).alias("is_last"),
    )


def run_summary(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """Duration, interactions, iterations and tool calls per session."""
    sums = interactions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.sum("n_iterations").alias("iterations"),
        F.sum("total_tool_calls").alias("tool_calls"),
    )
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("interactions", "iterations", "tool_calls")]
    return sessions.select("session_id", "duration").join(sums, "session_id", "left").select(
        "session_id", F.coalesce("duration", F.lit(0.0)).alias("duration"), *counts
    )


def agent_breakdown(interactions: DataFrame) -> DataFrame:
    """Iterations, tool calls and time per interaction."""
    return interactions.select(
        "session_id", "interaction_no", "agent", "n_iterations", "total_tool_calls", "duration"
    )


def newest_runs(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("session_id"))


def _longer(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """Every open path continued by every segment that begins where the path ends.

    ``nodes`` may not repeat, but for the last one, which then closes the path.
    """
    left = paths.where("open").select(
        "session_id", "rooted", "top", F.col("nodes").alias("head"), F.element_at("nodes", -1).alias("joint")
    )
    right = segments.select(
        "session_id", F.col("nodes")[0].alias("joint"), F.col("nodes").alias("tail"), F.col("open").alias("tail_open")
    )
    inner = F.slice("tail", F.lit(2), F.size("tail") - 2)
    crosses = F.coalesce(F.arrays_overlap("head", inner), F.lit(False))
    met = F.coalesce(F.array_contains("head", F.element_at("tail", -1)), F.lit(False))
    return (
        left.join(right, ["session_id", "joint"])
        .where(~crosses)
        .select(
            "session_id",
            "rooted",
            "top",
            F.concat("head", F.slice("tail", F.lit(2), F.size("tail") - 1)).alias("nodes"),
            (F.col("tail_open") & ~met).alias("open"),
        )
    )


def run_tree(interactions: DataFrame) -> DataFrame:
    """Interactions with ``depth`` and ``path`` of agent names below a root.

    Children name their parent, so paths are found between distinct agent names per
    session and interactions are attached once per path. An agent already on the path
    is shown but not followed again, so paths come to an end by themselves.

    Paths grow by doubling: round j has all paths from a root with fewer than 2 ** j steps
    and all segments, from any agent, of 2 ** j steps. Both are continued by the segments,
    which gives all rooted paths below 2 ** (j + 1) steps and the next segments. So a chain
    of a thousand agents takes ten rounds, each one join and one table.
    """
    edges = materialise(
        interactions.select("session_id", "parent", "agent").distinct(), "run-edges"
    )
    is_root = F.col("parent").isNull() | (F.col("parent") == "")
    roots = edges.where(is_root).select(
        "session_id",
        F.lit(True).alias("rooted"),
        F.col("parent").alias("top"),
        F.array("agent").alias("nodes"),
        F.lit(True).alias("open"),
    )
    segments = edges.where(~is_root).select(
        "session_id",
        F.lit(False).alias("rooted"),
        F.lit(None).cast("string").alias("top"),
        F.array("parent", "agent").alias("nodes"),
        F.coalesce(F.col("parent") != F.col("agent"), F.lit(True)).alias("open"),
    )
    paths, known = roots, roots.count()
    while known:
        seen = Observation()
        grown = paths.unionByName(_longer(paths.unionByName(segments), segments)).observe(
            seen, F.count_if("rooted").alias("rooted"), F.count_if(~F.col("rooted")).alias("segments")
        )
        stored = materialise(grown, "run-paths")
        paths, segments = stored.where("rooted"), stored.where(~F.col("rooted"))
        longer, known = seen.get["rooted"] > known, seen.get["rooted"]
        if not longer or not seen.get["segments"]:
            break
    placed = paths.select(
        "session_id",
        F.element_at("nodes", -1).alias("agent"),
        F.when(F.size("nodes") > 1, F.try_element_at("nodes", F.lit(-2))).otherwise(F.col("top")).alias("parent"),
        (F.size("nodes") - 1).alias("depth"),
        F.array_join("nodes", " > ").alias("path"),
    )
    same = (
        (F.col("i.session_id") == F.col("p.session_id"))
        & (F.col("i.agent") == F.col("p.agent"))
        & F.col("i.parent").eqNullSafe(F.col("p.parent"))
    )
    return (
        interactions.alias("i")
        .join(placed.alias("p"), same)
        .select("i.session_id", "i.interaction_no", "i.agent", "p.depth", "p.path")
    )
