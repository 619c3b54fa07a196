"""Plan helpers against plain Python, with hot keys."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cairnlog.operators.chunks import chunk_lines, first_chunks, similar_batch, similar_to_chunk
from cairnlog.operators import runs as runs_module
from cairnlog.operators.lines import uniq_adjacent
from cairnlog.operators.runs import run_tree
from cairnlog.plans.durable import shared_dir
from cairnlog.plans.medians import exact_medians
from cairnlog.plans.numbering import number_in_groups
from cairnlog.plans.prefix import running_totals
from scans import scanned_rows


def test_number_in_groups(spark):
    rows = [("hot" if n % 3 else "cold", n * 7 % 1009) for n in range(1000)]
    frame = spark.createDataFrame(rows, "k string, v long")
    found = number_in_groups(frame, ["k"], F.floor(F.col("v") / 64), [F.col("v")], "n").collect()
    for key in ("hot", "cold"):
        expected = {v: i for i, v in enumerate(sorted(v for k, v in rows if k == key), 1)}
        assert {r["v"]: r["n"] for r in found if r["k"] == key} == expected


def test_number_in_groups_with_aggregates_of_the_group(spark):
    rows = [("hot" if n % 3 else "cold", n * 7 % 1009) for n in range(1000)]
    frame = spark.createDataFrame(rows, "k string, v long")
    whole = {"n": (F.count(F.lit(1)), F.sum), "least": (F.min("v"), F.min)}
    found = number_in_groups(frame, ["k"], F.floor(F.col("v") / 64), [F.col("v")], "place", whole=whole).collect()
    for key in ("hot", "cold"):
        own = [v for k, v in rows if k == key]
        assert {(r["n"], r["least"]) for r in found if r["k"] == key} == {(len(own), min(own))}


@pytest.mark.parametrize("count", [0, 1, 700])
def test_running_totals(spark, count):
    rng = random.Random(count)
    values = [rng.randrange(-5, 50) for _ in range(count)]
    rows = list(enumerate(values))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "place long, v long").withColumn("one", F.lit(1))
    # One block, several of them, and more of them than splits.
    for rows_ in (65_536, 300, 20):
        got = running_totals(frame, ["place"], {"before": "v", "n": "one"}, block_rows=rows_).collect()
        assert sorted((r["place"], r["before"], r["n"]) for r in got) == [
            (i, sum(values[:i]), i) for i in range(count)
        ]


def test_windows_without_a_key_see_blocks_only(spark):
    frame = spark.range(5000).select(F.col("id").alias("place"), F.lit(1).alias("v"))
    totals = running_totals(frame, ["place"], {"before": "v"}, block_rows=700)
    assert totals.agg(F.max("before")).first()[0] == 4999
    plan = totals._jdf.queryExecution().executedPlan().toString()
    # The only exchange to one partition carries the totals of blocks.
    assert plan.count("SinglePartition") <= 2 and "_block" in plan


def test_exact_medians(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.choice([rng.uniform(-3, 900), 4.0, 0.0])) for _ in range(2001)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["m"] for r in exact_medians(frame, ["k"], "v", "m").collect()}
    for key in ("a", "b", "one", "two"):
        assert found[key] == statistics.median(v for k, v in rows if k == key)
    assert "none" not in found
    assert exact_medians(frame, [], "v", "m").head()[0] == statistics.median(v for _, v in rows if v is not None)


def python_chunks(files, size, overlap):
    found = []
    for name in sorted(files):
        lines, number = files[name], 0
        for start in range(0, len(lines), size - overlap):
            text = "".join(line + "\n" for line in lines[start : start + size])
            if text.strip():
                end = min(start + size, len(lines))
                found.append((len(found), text, name, start + 1, end, number, end - start))
                number += 1
    return found


def test_chunks(spark):
    rng = random.Random(3)
    files = {f"f{i}": [rng.choice(["", " ", "x", "yy z"]) for _ in range(n)] for i, n in enumerate([0, 1, 7, 100, 64])}
    files["blank"] = [""] * 30
    rows = [(f, i, v) for f, lines in files.items() for i, v in enumerate(lines, 1)]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string")
    for size, overlap in ((10, 3), (4, 0), (3, 2), (200, 10)):
        found = [tuple(r) for r in chunk_lines(lines, size, overlap).orderBy("chunk_index").collect()]
        assert found == python_chunks(files, size, overlap)
    assert first_chunks(chunk_lines(lines, 10, 3), 5).count() == 5


def test_chunks_hundred_lines_make_two(spark):
    lines = spark.range(1, 101).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit("x").alias("value"))
    found = chunk_lines(lines).orderBy("chunk_index").collect()
    assert [(r["start_line"], r["end_line"]) for r in found] == [(1, 100), (91, 100)]


def test_uniq_adjacent_over_segments(spark):
    values = [random.Random(n // 4).choice("ab") for n in range(200)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(values, 1)], "file string, line_no long, value string")
    expected = [i for i, v in enumerate(values, 1) if i == 1 or values[i - 2] != v]
    for segment in (1, 7, 1000):
        found = uniq_adjacent(lines, segment).orderBy("line_no").collect()
        assert [r["line_no"] for r in found] == expected


def test_similar_batch_equals_single(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "chunk_index long, vec array<double>").repartition(5)
    batch = similar_batch(corpus, [3, 9], 4).collect()
    for query in (3, 9):
        single = [r["chunk_index"] for r in similar_to_chunk(corpus, query, 4).collect()]
        mine = sorted((r for r in batch if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["chunk_index"] for r in mine] == single


def test_run_tree_stops_at_cycles(spark):
    rows = [("s", 0, "lead", None), ("s", 1, "dev", "lead"), ("s", 2, "lead", "dev"), ("s", 3, "test", "dev"),
            ("s", 4, "self", "self")]
    frame = spark.createDataFrame(rows, "session_id string, interaction_no long, agent string, parent string")
    found = {(r["interaction_no"], r["path"], r["depth"]) for r in run_tree(frame).collect()}
    assert found == {(0, "lead", 0), (1, "lead > dev", 1), (2, "lead > dev > lead", 2), (3, "lead > dev > test", 2)}


def test_run_tree_goes_all_the_way_down(spark):
    rows = [("s", n, f"a{n}", f"a{n - 1}" if n else None) for n in range(30)]
    frame = spark.createDataFrame(rows, "session_id string, interaction_no long, agent string, parent string")
    assert sorted(r["depth"] for r in run_tree(frame).collect()) == list(range(30))


def test_similar_batch_refuses_unknown_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_index long, vec array<double>")
    with pytest.raises(IndexError, match="7"):
        similar_batch(corpus, [1, 7])
    assert similar_batch(corpus, []).collect() == []


def test_medians_of_values_close_together(spark):
    rng = random.Random(8)
    values = [1.7e9 + rng.randrange(100_000) for _ in range(4001)]
    rows = [("k", v) for v in values] + [("k", float("nan")), ("n", 1.0), ("n", 2.0), ("n", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["m"] for r in exact_medians(frame, ["k"], "v", "m").collect()}
    assert found == {"k": statistics.median(values), "n": 1.5}


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    rows = [("s", 0, "a0", None)] + [("s", i, f"a{i}", f"a{i - 1}") for i in range(1, 1000)]
    interactions = spark.createDataFrame(rows, "session_id string, interaction_no long, agent string, parent string")
    written = []
    materialise = runs_module.materialise
    monkeypatch.setattr(runs_module, "materialise", lambda *a: (written.append(a[1]), materialise(*a))[1])
    found = run_tree(interactions).collect()
    assert {(r["agent"], r["depth"]) for r in found} == {(f"a{i}", i) for i in range(1000)} and len(found) == 1000
    assert max(found, key=lambda r: r["depth"])["path"] == " > ".join(f"a{i}" for i in range(1000))
    assert len(written) <= 12


def plain_tree(rows):
    """All paths from a root; an agent that is on its path already is not followed."""
    edges = {(s, p or "", a) for s, _, a, p in rows}
    paths, found = [(s, p, a, (a,)) for s, p, a in edges if not p], []
    while paths:
        s, p, a, path = paths.pop()
        found.append((s, p, a, path))
        if a not in path[:-1]:
            paths += [(s, a, b, (*path, b)) for t, q, b in edges if t == s and q == a and a]
    return sorted(
        (s, n, a, len(path) - 1, " > ".join(path))
        for s, n, a, p in rows
        for t, q, b, path in found
        if (t, q, b) == (s, p or "", a)
    )


def test_trees_with_rings(spark):
    rng = random.Random(17)
    for agents in (3, 5, 6):
        rows = [(f"s{i % 2}", i, f"a{rng.randrange(agents)}", rng.choice([None, *(f"a{j}" for j in range(agents))])) for i in range(16)]
        interactions = spark.createDataFrame(rows, "session_id string, interaction_no long, agent string, parent string")
        assert sorted(map(tuple, run_tree(interactions).collect())) == plain_tree(rows)
    none = spark.createDataFrame([("s", 1, "a", "b")], "session_id string, interaction_no long, agent string, parent string")
    assert run_tree(none).count() == 0


def test_stored_chunks_are_read_by_number(spark, tmp_path):
    from cairnlog.sources.chunks import read_chunk, read_chunk_range, read_chunks, write_chunks

    lines = spark.range(3000).select(
        F.concat(F.lit("f"), F.floor(F.col("id") / 1000)).alias("file"), (F.col("id") % 1000 + 1).alias("line_no"),
        F.concat(F.lit("line "), "id").alias("value"))
    chunks = chunk_lines(lines, 5, 1)
    path = str(tmp_path / "chunks")
    write_chunks(chunks, path, chunk_size=5, overlap=1, model_name="none", per_part=100)
    stored, config = read_chunks(spark, path)
    assert stored.columns == chunks.columns and config.columns == ["chunk_size", "overlap", "model_name"]
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, chunks.collect()))
    found, rows = scanned_rows(spark, lambda: read_chunk_range(spark, path, 0, 40).collect(), "parquet")
    assert sorted(r["chunk_index"] for r in found) == list(range(40)) and rows <= 102
    (one,), rows = scanned_rows(spark, lambda: read_chunk(spark, path, 450).collect(), "parquet")
    assert one["chunk_index"] == 450 and rows <= 210
    for wrong in (-1, 750, 10_000):
        with pytest.raises(IndexError):
            read_chunk(spark, path, wrong)
    first = chunk_lines(lines, 5, 1, first=40)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, found))
    write_chunks(chunks.limit(0), str(tmp_path / "none"), chunk_size=5, overlap=1, model_name="none")
    assert read_chunks(spark, str(tmp_path / "none"))[0].count() == 0
