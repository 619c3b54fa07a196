"""Near-duplicates, line chunks and repeated passages against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlog.llm import line_dedup, near_dedup, phrases
from cairnlog.llm.components import connected_components
from cairnlog.llm.shingles import run_hashes
from cairnlog.llm.shipping import ship_code

from .helpers import awkward, awkward_rows, empty, lowered, sentence, words_of


@pytest.fixture(autouse=True)
def code(spark):
    ship_code(spark)


def shingle_sets(rows):
    out = []
    for doc, text in rows:
        words = lowered(text)
        count = max(1, len(words) - 4) if words else 0
        out.append((doc, {tuple(words[i : i + 5]) for i in range(count)}))
    return out


def plain_classes(rows):
    """Smallest reachable id of every row with an id."""
    sets = [(doc, own) for doc, own in shingle_sets(rows) if doc is not None]
    root = {doc: doc for doc, _ in sets}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc: find(doc) for doc in root}


def near_rows():
    rng = random.Random(3)
    words = [f"v{i}" for i in range(300)]
    rows, doc = [], 0
    for family in range(12):
        base = sentence(rng, words, rng.choice([30, 80, 160])).split()
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((doc, " ".join(copy)))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [awkward_rows(), near_rows()], ids=["awkward", "families"])
def test_near_duplicates(spark, rows):
    got = near_dedup.near_duplicates(awkward(spark, rows)).collect()
    expected, sizes = plain_classes(rows), defaultdict(set)
    for doc, own in shingle_sets(rows):
        sizes[doc].add(len(own))
    assert len(got) == len(rows)
    for row in got:
        assert row["component_id"] == expected.get(row["doc_id"])
        assert row["n_shingles"] in sizes[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] is None or row["doc_id"] == row["component_id"])


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []


def test_a_family_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_TASK", 3)
    rng = random.Random(5)
    base = sentence(rng, [f"u{i}" for i in range(200)], 100).split()
    rows = []
    for doc in range(40):
        copy = list(base)
        for place in rng.sample(range(100), 2 if doc % 2 else 5):
            copy[place] = f"x{doc}"
        rows.append((doc, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(awkward(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_sets_go_only_where_other_components_are(spark):
    """A thousand copies of one component and a few outliers: no copy is sent to other copies."""
    rows = [(1, i, 1) for i in range(1000)] + [(1, 2000 + i, 2000 + i) for i in range(3)]
    rows += [(2, i, i % 2) for i in range(300)] + [(3, i, i) for i in range(20)]
    families = spark.createDataFrame(rows, "leader long, class long, part long")
    dealt = near_dedup._dealt_to_blocks(families, 16).collect()
    sent = defaultdict(set)
    for row in dealt:
        sent[row["leader"], row["class"]].add((min(row["block"], row["other"]), max(row["block"], row["other"])))
    assert set(sent) == {row[:2] for row in rows}
    assert sum(len(own) for (leader, i), own in sent.items() if leader == 1 and i < 2000) == 1000
    for a in rows:
        for b in rows[1000:]:
            if a[0] == b[0] and a[2] != b[2]:
                assert sent[a[:2]] & sent[b[:2]], (a, b)


def test_meeting_links_gives_one_link_for_two_parts():
    same = np.arange(20, dtype="u8")
    links = near_dedup.meeting_links([1, 2, 3, 4], [1, 1, 3, 3], np.array([0, 0, 1, 1]), [same] * 4)
    assert len(links) == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def plain_chunks(lines):
    """Chunks by their definition: a line ends one if the rolling hash of it and the line before
    is even and the chunk has two lines with text."""
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]
    out, begin = [], 0
    for place in range(len(lines)):
        own = lines[begin : place + 1]
        filled = sum(1 for line in own if line.encode("utf-8", "surrogatepass").strip())
        if filled >= 2 and place:
            pair = np.array(hashes[place - 1 : place + 1], "u8")
            if int(line_dedup.rolling_hashes(pair)[1]) % 2 == 0:
                out.append((begin, place + 1, True))
                begin = place + 1
    rest = [line for line in lines[begin:] if line.encode("utf-8", "surrogatepass").strip()]
    return [*out, (begin, len(lines), len(rest) >= 2)] if begin < len(lines) else out


def plain_chunks_removed(rows):
    """Id, text left and lines removed of every row."""
    split = [(doc, text, [] if text is None else text.split("\n")) for doc, text in rows]
    places = defaultdict(list)
    for doc, _, lines in split:
        if doc is not None:
            bounds = plain_chunks(lines)
            keys = ["\n".join(lines[b:e]) if long else None for b, e, long in bounds]
            for n, ((begin, end, _), key) in enumerate(zip(bounds, keys)):
                if key is not None:
                    places[key].append((doc, begin, n, bounds, lines))
    repeated = {key for key, own in places.items() if min(own)[:2] < max(own)[:2]}

    def around(n, bounds, lines):
        sides = []
        for other in (n - 1, n + 1):
            if 0 <= other < len(bounds):
                b, e, long = bounds[other]
                sides.append(None if long and "\n".join(lines[b:e]) in repeated else lines[b:e])
            else:
                sides.append(None)
        return sides

    def same(a, b):
        count = 0
        while count < min(len(a or []), len(b or [])) and a[count] == b[count]:
            count += 1
        return count

    gone = defaultdict(set)
    for key in repeated:
        first = min(places[key], key=lambda p: p[:2])
        before, after = around(*first[2:])
        for doc, begin, n, bounds, lines in places[key]:
            if (doc, begin) > first[:2]:
                b, a = around(n, bounds, lines)
                lead = same((b or [])[::-1], (before or [])[::-1])
                gone[doc, "\n".join(lines)] |= set(range(begin - lead, bounds[n][1] + same(a, after)))
    out = []
    for doc, text, lines in split:
        own = gone.get((doc, text), set()) if doc is not None else set()
        left = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in own)
        out.append((doc, left, len(own)))
    return sorted(out, key=repr)


def chunks_removed(frame):
    cleaned, name = line_dedup.remove_repeated_chunks(frame)
    got = cleaned.select("doc_id", f"{name}.text", f"{name}.n_removed").collect()
    return sorted(map(tuple, got), key=repr)


def test_line_chunks(spark):
    rows = awkward_rows()
    lines = rows[5][1].split("\n")
    rows += [(15, "another text\n" + "\n".join(lines[3:20])), (15, "third\n" + "\n".join(lines[:9]))]  # ids again
    cleaned, name = line_dedup.remove_repeated_chunks(awkward(spark, rows))
    assert name == "_deduped" and cleaned.columns[:-1] == awkward(spark).columns
    expected = plain_chunks_removed(rows)
    assert chunks_removed(awkward(spark, rows)) == expected
    assert any(removed for _, _, removed in expected)


def test_boundaries_follow_the_lines():
    rng = random.Random(1)
    lines = [rng.choice(["", " ", sentence(rng, ["a", "b", "c", "d"], 6) + str(i)]) for i in range(400)]
    raw = [line.encode() for line in lines]
    bounds = line_dedup.chunk_bounds(raw)
    assert bounds == plain_chunks(lines)
    assert [b for b, _, _ in bounds] == [0, *(e for _, e, _ in bounds[:-1])] and bounds[-1][1] == 400
    ends = {e for _, e, _ in bounds}
    for shift in range(1, 20):
        moved = line_dedup.chunk_bounds([f"new {i}".encode() for i in range(shift)] + raw)
        again = {e - shift for _, e, _ in moved}
        assert {e for e in ends if e > 20} == {e for e in again if e > 20}
        cut = {e + shift for _, e, _ in line_dedup.chunk_bounds(raw[shift:])}
        assert {e for e in ends if e > shift + 20} == {e for e in cut if e > shift + 20}


def test_line_chunks_of_nothing(spark):
    cleaned, _ = line_dedup.remove_repeated_chunks(empty(spark))
    assert cleaned.collect() == []


def test_single_lines_between_blank_ones_stay(spark):
    rows = [(i, f"own {i}\n\nonly line\n\nown too {i}") for i in range(30)]
    assert all(removed == 0 for _, _, removed in chunks_removed(awkward(spark, rows)))


def plain_passages_removed(rows):
    """Id, words, removed words and kept text of every row, sorted."""
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda row: row[0]):
        words = words_of(text)
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), doc)
    out = []
    for doc, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if doc is not None and first[tuple(words[i : i + 13])] < doc:
                gone[i : i + 13] = [True] * 13
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def passages_removed(frame):
    got = phrases.remove_repeated_passages(frame).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


@pytest.mark.parametrize("range_entries, shard_bytes", [(250_000, 3_000_000), (500, 4_000), (500, 1)])
def test_passages(spark, monkeypatch, range_entries, shard_bytes):
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", range_entries)
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    rows = awkward_rows()
    rows.append((24, "an id of its own text " * 9))  # another text of an id
    assert passages_removed(awkward(spark, rows).repartition(3)) == plain_passages_removed(rows)


def test_rows_that_share_an_id_keep_what_only_they_hold(spark):
    rng = random.Random(9)
    passage, other = (sentence(rng, [f"i{i}" for i in range(300)], 40) for _ in range(2))
    rows = [(1, passage), (5, f"{passage} tail"), (5, other), (5, other), (6, f"{other} {passage}"), (2**60 + 1, other)]
    expected = plain_passages_removed(rows)
    assert [row[2] for row in expected if row[0] == 5] == [0, 0, 40]
    for partitions in (1, 6):
        assert passages_removed(awkward(spark, rows).repartition(partitions)) == expected


def test_passages_of_nothing(spark):
    assert phrases.remove_repeated_passages(empty(spark)).collect() == []


def test_owner_and_copies_in_different_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1)
    rng = random.Random(2)
    shared = sentence(rng, [f"s{i}" for i in range(50)], 20)
    rows = [(i, f"{sentence(rng, ['p', 'q', 'r'], 10)} {shared}") for i in range(30)]
    expected = plain_passages_removed(rows)
    assert sorted(row[2] >= 20 for row in expected) == [False] + 29 * [True]
    assert passages_removed(awkward(spark, rows)) == expected


@pytest.mark.parametrize("shard_bytes", [3_000_000, 1])
def test_a_passage_repeated_in_part_by_its_document(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    rng = random.Random(6)
    shared = sentence(rng, [f"p{i}" for i in range(300)], 40)
    part = " ".join(shared.split()[5:30])
    rows = [(1, shared), (2, f"{shared} x y z {part}"), (3, f"{part} q {part}"), (4, "tie " * 40), (5, "tie " * 60)]
    expected = plain_passages_removed(rows)
    assert expected[1][2] == 65
    assert passages_removed(awkward(spark, rows).repartition(5, "doc_id")) == expected


def test_only_the_automaton_knows_where_passages_occur(monkeypatch):
    """Of each confirmed window one place is given; all others are found by streaming."""
    rng = random.Random(11)
    shared = [f"m{i}".encode() for i in range(60)]
    rows = [(i, [f"u{rng.random()}".encode(), *shared[i : i + 40], *shared[:20]]) for i in range(12)]
    hi, lo, ids, several, numbers, places = phrases.shard_windows(rows, np.zeros(0, "u8"))
    own = np.flatnonzero(several)
    marks = phrases.locate_passages(rows, numbers[own], places[own], np.zeros(len(own), bool))
    expected = plain_passages_removed([(i, b" ".join(words).decode()) for i, words in rows])
    assert [(i, int(mark.sum())) for (i, _), mark in zip(rows, marks)] == sorted((e[0], e[2]) for e in expected)
    assert len(own) < sum(int(mark.sum()) for mark in marks) / 4
    monkeypatch.setattr(phrases, "LETTERS", 7)  # several letters to a word
    again = phrases.locate_passages(rows, numbers[own], places[own], np.zeros(len(own), bool))
    assert [mark.tolist() for mark in again] == [mark.tolist() for mark in marks]


def test_more_words_than_letters(spark):
    words = [f"{i:x}" for i in range(1_200_000)]
    rows = [(1, " ".join(words[500:560])), (2, " ".join(words)), (3, " ".join(words[-40:]))]
    got = phrases.remove_repeated_passages(awkward(spark, rows)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 60, 0), (2, 1_200_000, 60), (3, 40, 40)]


@given(st.lists(st.integers(0, 3), min_size=13, max_size=60))
@settings(max_examples=60, deadline=None)
def test_seeds_are_the_least_runs(values):
    hashes = np.array([hash((v, "x")) % 2**64 for v in values], "u8")
    runs = run_hashes(hashes, phrases.SEED)
    expected = [min(runs[i : i + phrases.WINDOW - phrases.SEED + 1]) for i in range(len(values) - 12)]
    assert phrases.window_seeds(hashes).tolist() == [int(x) for x in expected]


def test_runs_of_lines_in_other_surroundings(spark):
    rng = random.Random(8)
    fresh = lambda size: [sentence(rng, ["a", "b", "c", "d", "e"], 12) for _ in range(size)]
    rows, runs = [], [fresh(size) for size in (2, 2, 2, 3, 4, 30)]
    for doc in range(60):
        rows.append((doc, "\n".join([*fresh(rng.randrange(3)), *rng.choice(runs), *fresh(rng.randrange(3))])))
    got = chunks_removed(awkward(spark, rows))
    assert got == plain_chunks_removed(rows)
    seen, wanted, found = set(), 0, 0
    for (doc, text), (_, left, _) in zip(rows, sorted(got)):
        lines = text.split("\n")
        pairs = set(zip(lines, lines[1:]))
        again = {x for pair in pairs & seen for x in pair}
        wanted, found = wanted + len(again), found + len(again - set(left.split("\n")))
        assert set(lines) - again <= set(left.split("\n"))  # nothing else goes
        seen |= pairs
    assert found > 0.6 * wanted
