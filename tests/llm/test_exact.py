"""Exact duplicates against a plain version."""

import hashlib
import re

import pytest

from cairnlog.llm import exact_dedup
from pyspark.sql import functions as F

from .helpers import awkward, awkward_rows, empty

SPACE = re.compile("[\x20\x09-\x0d]+")


def plain(text):
    return SPACE.sub(" ", text or "")


def plain_groups(rows):
    """For every row, in order: the id that stays, the number of copies, the digest."""
    groups = {}
    for id_, text in rows:
        groups.setdefault(plain(text), []).append(id_)
    out = []
    for id_, text in rows:
        ids = groups[plain(text)]
        least = min((i for i in ids if i is not None), default=None)
        out.append((id_, least, len(ids), hashlib.sha256(plain(text).encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def copies():
    rows = awkward_rows()
    base = rows[8][1]
    rows += [(500 + i, base.replace(" ", ["\n", " \t ", "  "][i % 3], 5)) for i in range(90)]  # a third are copies
    rows += [(900, "other words"), (900, "other  words"), (901, "other\nwords"), (900, "no copy"), (None, "alone")]
    rows += [(902, " "), (903, " "), (904, "a b"), (905, "a b"), (906, " a b"), (907, "A b")]
    return rows


@pytest.mark.parametrize("partitions, bits", [(1, 4), (7, 4), (13, 1), (20, 2)])
def test_groups_match_brute_force(spark, partitions, bits):
    rows = copies()
    found = exact_dedup.exact_duplicates(awkward(spark, rows).repartition(partitions), round_bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = [tuple(row) for row in found.collect()]
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=repr) == sorted(plain_groups(rows), key=repr)
    kept = [(a, e) for a, b, _, k, e in got if k]
    assert len(kept) == len(set(kept)) == len({e for *_, e in got})
    assert all(a == b for a, b, _, k, _ in got if k)


def test_rows_that_stay_keep_their_columns(spark):
    rows = copies()
    left = exact_dedup.without_duplicates(awkward(spark, rows).repartition(5))
    assert left.columns == awkward(spark, []).columns
    got = sorted(((row["doc_id"], plain(row["text"])) for row in left.collect()), key=repr)
    stays = {}
    for id_, text in rows:
        ids = [i for i in (stays.get(plain(text)), id_) if i is not None]
        stays[plain(text)] = min(ids, default=None)
    assert got == sorted(((i, t) for t, i in stays.items()), key=repr)


def test_digests_alone_make_no_copy(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = copies()
    found = exact_dedup.exact_duplicates(awkward(spark, rows).repartition(6), round_bits=1)
    got = sorted(((a, b, c, e) for a, b, c, _, e in found.collect()), key=repr)
    assert got == sorted(plain_groups(rows), key=repr)


def test_no_task_joins_all_copies(spark):
    """A text that every row holds is one entry per run at every level."""
    rows = [(i, "same text") for i in range(400)]
    seen = []
    merged = exact_dedup._merged

    def watched(entries, bits):
        out = merged(entries, bits)
        seen.append(out.agg(F.count(F.lit(1)), F.max("n")).first())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(exact_dedup, "_merged", watched)
        found = exact_dedup.exact_duplicates(awkward(spark, rows).repartition(16), round_bits=1)
    assert [row[0] for row in seen] == [8, 4, 2, 1] and seen[-1][1] == 400
    assert found.where("keep_id = 0 and group_size = 400").count() == 400
    assert found.where("kept").count() == 1


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.without_duplicates(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    found = exact_dedup.exact_duplicates(awkward(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
