"""Vector codes and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlog.llm import hard_negatives, vector_codes
from pyspark.sql import functions as F

COLUMNS = "vec_id long, embedding array<float>, label int, id string, q string, row string, code string, task int"


def vector_rows(seed=3, count=120, width=8):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        vector = [rng.uniform(-1, 1) for _ in range(width)]
        rows.append((i * 5, vector, rng.choice([0, 1, 1, 1, 2, None])))
    rows += [(1000 + i, rows[7][1], rng.choice([1, 2])) for i in range(60)]  # many copies of one vector
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.5] * (width - 1) + [None], 1), (2003, [math.nan] * width, 1),
        (2004, [math.inf] + [0.0] * (width - 1), 2), (2005, [0.1] * (width + 1), 1), (2006, [0.0] * width, 1),
        (2007, [0.0] * width, 2), (None, [0.3] * width, 1), rows[3], rows[3], (15, [0.2] * width, 2),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "a", "b", "c", "d", 9) for row in rows], COLUMNS)


def usable(rows, scale, width=8):
    out = []
    for id_, vector, label in rows:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector):
            out.append((id_, [math.floor(float(np.float32(x)) * scale) for x in vector], label))
    return out


def plain_codes(rows, parts=4, entries=256, rounds=4):
    rows = usable(rows, 1024)
    size = 8 // parts
    starting = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[row[1][p * size : (p + 1) * size] for row in starting] for p in range(parts)]

    def near(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), i) for i, entry in enumerate(books[part]))

    for _ in range(rounds):
        members = [[[] for _ in book] for book in books]
        for _, q, _ in rows:
            for p in range(parts):
                x = q[p * size : (p + 1) * size]
                members[p][near(p, x)[1]].append(x)
        for p in range(parts):
            for i, xs in enumerate(members[p]):
                if xs:
                    books[p][i] = [sum(column) // len(xs) for column in zip(*xs)]
    coded, by_label = [], {}
    for id_, q, label in rows:
        found = [near(p, q[p * size : (p + 1) * size]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        coded.append((id_, "".join(f"{i:02x}" for _, i in found), error, label))
    return [(i, c, e, by_label[label]) for i, c, e, label in coded], books


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("entries", [256, 16, 1])
def test_codes_match_brute_force(spark, entries):
    rows = vector_rows()
    coded, books = vector_codes.compress_vectors(frame(spark, rows).repartition(5), entries=entries)
    expected, plain_books = plain_codes(rows, entries=entries)
    assert coded.columns == ["vec_id", "code", "error", "label_error"]
    assert sorted_rows(map(tuple, coded.collect())) == sorted_rows(expected)
    assert [book.tolist() for book in books] == plain_books
    assert vector_codes.codebooks_digest(books) == vector_codes.codebooks_digest(
        [np.array(book) for book in plain_books]
    )


def test_codes_of_empty_tables_and_odd_lengths(spark):
    coded, books = vector_codes.compress_vectors(frame(spark, []))
    assert coded.count() == 0 and books == []
    coded, _ = vector_codes.compress_vectors(frame(spark, [(1, None, 1), (2, [], None)]))
    assert coded.count() == 0
    coded, books = vector_codes.compress_vectors(frame(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1)]))
    assert sorted(map(tuple, coded.collect())) == [(1, "000000", 0, 0), (2, "000000", 0, 0)]
    assert [book.shape for book in books] == [(2, 1)] * 3
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e5] * 64, 1)]))


@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 9), st.sampled_from([2, 5, 400]))
@settings(max_examples=60, deadline=None)
def test_search_finds_the_lowest_nearest_entry(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    book = vector_codes.Codebook(rng.integers(-spread, spread, (entries, width)))
    plain = np.empty((entries, width))
    plain[book.index] = book.entries
    parts = rng.integers(-spread, spread, (700, width))
    distance = ((parts[:, None, :] - plain[None]) ** 2).sum(axis=2)
    index, nearest = book.nearest(parts)
    assert index.tolist() == distance.argmin(axis=1).tolist()
    assert nearest.tolist() == distance.min(axis=1).astype(int).tolist()


def test_search_stops_where_sums_are_too_far_apart():
    rng = np.random.default_rng(1)
    entries = np.repeat(np.arange(256) * 40, 16).reshape(256, 16) + rng.integers(-3, 4, (256, 16))
    book = vector_codes.Codebook(entries)
    book.nearest(entries[rng.integers(0, 256, 5_000)] + 1)
    assert book.searched < 5_000 * 256 / 4


def plain_negatives(rows, positives=5, negatives=5):
    rows = [(i, q, label) for i, q, label in usable(rows, 256) if i is not None and label is not None]
    out = []
    for at, (anchor, q, label) in enumerate(rows):
        if anchor % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r[1])), r[0], r[2]) for n, r in enumerate(rows) if n != at]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            p = -score
            fitting = sorted(
                (s, i) for s, i, other in scored if other != label and 80 * p <= -100 * s <= 100 * p
            )
            for rank, (s, negative) in enumerate(fitting[:negatives], 1):
                out.append((anchor, positive, rank, negative, p, -s))
    return out


@pytest.mark.parametrize("window, rows_per_task, together", [(256, 2_048, 64), (4, 20, 3)])
def test_negatives_match_brute_force(spark, monkeypatch, window, rows_per_task, together):
    monkeypatch.setattr(hard_negatives, "WINDOW", window)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", rows_per_task)
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    rows = vector_rows()
    mined = hard_negatives.mine_hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, mined.collect())) == sorted(plain_negatives(rows))


def test_anchors_go_where_negatives_can_be(spark, monkeypatch):
    """Clusters in different directions: tasks of other directions get no anchor."""
    monkeypatch.setattr(hard_negatives, "TASK_NUMBERS", 40 * 8)
    monkeypatch.setattr(hard_negatives, "WINDOW", 8)
    rng = random.Random(4)
    axes = [[1.0 if i == j else 0.0 for j in range(8)] for i in range(8)]
    rows = [(i, [x + rng.uniform(-0.02, 0.02) for x in axes[i // 40]], rng.choice([1, 2])) for i in range(320)]
    sent = []
    route = hard_negatives._where_negatives_can_be

    def watched(stored, anchors, tasks, *limits):
        out = route(stored, anchors, tasks, *limits)
        sent.append((out.count(), anchors.count() * tasks))
        return out

    monkeypatch.setattr(hard_negatives, "_where_negatives_can_be", watched)
    mined = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, mined.collect())) == sorted(plain_negatives(rows))
    assert sent[0][1] >= 32 * 8 and sent[0][0] < sent[0][1] / 2


def test_negatives_with_more_partitions_than_asked_for(spark, monkeypatch):
    kind = type(frame(spark, []))
    ranged = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, count, *by: ranged(self, max(count, 37), *by))
    rows = vector_rows()
    mined = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, mined.collect())) == sorted(plain_negatives(rows))


def test_negatives_of_empty_tables(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], None)], [(0, [1.0], 1)], [(0, [0.0] * 3, 1), (1, [0.0] * 3, 1)]):
        mined = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") == 0)
        assert mined.columns[:3] == ["anchor_id", "positive_id", "rank"] and mined.count() == 0


def test_bounds_hold_and_exclude_windows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 300
    rows = np.rint(np.repeat(centres, 128, axis=0) + rng.normal(size=(1536, 16)) * 20)
    norms = np.linalg.norm(rows, axis=1)
    directions = hard_negatives.reference_directions(rows, 16)
    angles = hard_negatives.angles_to(rows, norms, directions)
    home = angles.argmin(axis=1)
    order = np.lexsort((angles[np.arange(len(rows)), home], home))
    rows, norms, angles = rows[order], norms[order], angles[order]
    ids = np.arange(len(rows))
    block = hard_negatives.Block(rows, norms, angles, np.repeat(["a"], len(rows)), ids, ids)
    lower, upper = block.bounds(norms, angles)
    scores = rows @ rows.T
    for number, start in enumerate(block.starts):
        window = scores[:, start : start + hard_negatives.WINDOW]
        assert (window >= lower[:, number, None]).all() and (window <= upper[:, number, None]).all()
    few = {"q": rows[::100], "norm": norms[::100], "angles": angles[::100], "row": ids[::100],
           "label": np.repeat(["a"], 16)}
    block.positives(few, 5)
    assert block.skipped > 0
