"""Benchmark items in documents, and the pipeline's stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cairnlog.llm import decontaminate, quality

from .helpers import awkward, awkward_rows, empty, sentence, words_of
from .test_dedup import plain_chunks_removed, plain_classes
from .test_tokens import plain_ids

ITEMS = "item_id long, text string, words string"


def plain_leaks(rows, items, similar=0.75):
    """Similarity of the best window of every document and item, over all windows."""
    out = {}
    for doc, text in rows:
        words = words_of((text or "").lower())
        for item, item_text in items:
            own = words_of((item_text or "").lower())
            if not own:
                continue
            size = min(5, len(own))
            bag = lambda ws: Counter(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))  # noqa: E731, B023
            wanted = bag(own)
            for start in range(max(len(words) - len(own), 0) + 1):
                found = bag(words[start : start + len(own)])
                common = sum((wanted & found).values())
                value = common / (sum(wanted.values()) + sum(found.values()) - common)
                if value >= similar and value > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = value, start
    return out


def leak_rows():
    rng = random.Random(12)
    words = [f"t{i}" for i in range(300)]
    items = [(i, sentence(rng, words, rng.choice([3, 5, 20, 50]))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "tie tie tie tie tie tie tie tie tie"), (23, items[3][1])]
    rows = [row for row in awkward_rows() if len(row[1] or "") < 5_000]
    for doc, (_, text) in enumerate(items[:12]):
        own = text.split()
        if len(own) > 30:
            own[0] = "changed"
        rows.append((100 + doc, f"{sentence(rng, words, 15)} {' '.join(own).upper()} {sentence(rng, words, 5)}"))
        rows.append((200 + doc, " ".join(own)))
    return rows, items


def check_leaks(spark, rows, items):
    benchmark = spark.createDataFrame([(*item, "w") for item in items], ITEMS)
    got = decontaminate.find_leaks(awkward(spark, rows), benchmark).collect()
    expected = plain_leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(expected) and len(got) == len(expected)
    for row in got:
        similarity, start = expected[row["doc_id"], row["item_id"]]
        assert abs(row["similarity"] - similarity) < 1e-9 and row["start_word"] == start
        assert row["distance"] <= decontaminate.RADIUS
    return expected


@pytest.mark.parametrize("threshold", ["32MB", "-1"])
def test_leaks(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_leaks(spark, *leak_rows())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_edited_copies_with_insertions(spark):
    """The best window of an edited copy may lie between two alignments."""
    rng = random.Random(21)
    items = [(i, sentence(rng, [f"e{n}" for n in range(400)], 59)) for i in range(4)]
    rows, between = [], 0
    for doc in range(240):
        words = items[doc % 4][1].split()
        for place in rng.sample(range(59), rng.choice([1, 2])):
            words[place] = "changed"
        at = rng.randrange(10, 50)
        words[at:at] = [f"new{i}" for i in range(rng.randrange(1, 7))]
        rows.append((doc, " ".join([*(f"a{i}" for i in range(9)), *words, *(f"z{i}" for i in range(9))])))
        if doc % 5 == 0:  # halves in the other order
            words = items[doc % 4][1].split()
            rows.append((1000 + doc, " ".join(["lead", *words[30:], *(["gap"] * (doc % 4)), *words[:30], "trail"])))
    expected = check_leaks(spark, rows, items)
    for (doc, item), (_, start) in expected.items():
        own, words = items[item][1].split(), dict(rows)[doc].split()
        hits = {i - j for i in range(len(words) - 4) for j in range(55) if words[i : i + 5] == own[j : j + 5]}
        between += start not in hits
    assert between


def test_fingerprints_filter_items(spark):
    """Windows meet few of many items of their length."""
    rng = random.Random(3)
    vocabulary = [f"c{n}" for n in range(2000)]
    items = [(i, sentence(rng, vocabulary, 40)) for i in range(2000)]
    rows = [(i, items[i * 7][1]) for i in range(100)]
    benchmark = spark.createDataFrame([(*item, "w") for item in items], ITEMS)
    seen = []
    candidates = decontaminate._candidates
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "_candidates", lambda *a: (seen.append(candidates(*a).count()), candidates(*a))[1])
        found = decontaminate.find_leaks(awkward(spark, rows), benchmark).count()
    assert found == 100 and seen[0] < 100 * 2000 / 20


def test_leaks_without_rows(spark):
    benchmark = spark.createDataFrame([(1, "some words of an item here", "w")], ITEMS)
    assert decontaminate.find_leaks(empty(spark), benchmark).collect() == []
    assert decontaminate.find_leaks(awkward(spark), benchmark.limit(0)).collect() == []


def test_leaks_need_no_python(spark):
    rows, items = leak_rows()
    benchmark = spark.createDataFrame([(*item, "w") for item in items], ITEMS)
    found = decontaminate.find_leaks(awkward(spark, rows), benchmark)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_stages_on_awkward_documents(spark, sf_dir):
    docs = awkward(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns, name
        assert kept.count() <= docs.count()
        assert stage(spark, empty(spark), sf_dir).count() == 0, name
    near = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert len({row["doc_id"] for row in near}) == len(near)
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    rows = packed.collect()
    fill = Counter()
    for row in rows:
        fill[row["sequence_id"]] += row["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1


def pipeline_documents():
    """Good documents, copies of all kinds, shared lines, benchmark passages and junk."""
    rng = random.Random(31)
    words = [f"n{i}" for i in range(900)]
    items = [(i, sentence(rng, words, 40)) for i in range(3)]

    def good(size=14, lines=5):
        return "\n".join(sentence(rng, words, size).capitalize() + "." for _ in range(lines))

    texts = [good() for _ in range(30)]
    shared = "\n".join(sentence(rng, words, 15).capitalize() + "." for _ in range(8))
    texts += [f"{good()}\n{shared}\n{good()}" for _ in range(4)]
    near = texts[3].split()
    near[7] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[1] + "\n| Home | About | Login |", "", None, "short", good(3000, 1)]
    texts += [f"{good()}\n{items[1][1].capitalize()}.\n{good()}", items[2][1] + "."]
    texts += ["### $$$ *** ||| " * 40, "\n".join(["same words again and again"] * 40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * place, texts[n]) for place, n in enumerate(order)], items


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage by its plain version, one after the other, against the written result."""
    rows, items = pipeline_documents()
    spark.createDataFrame([(*item, "w") for item in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, text, "xx", "s", None if text is None else len(text)) for i, text in rows]
    spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/documents.parquet")

    good = [(i, quality.judge(text)) for i, text in rows]
    good = [(i, found[-1]) for i, found in good if found[-2]]
    lines = [(i, text) for i, text, _ in plain_chunks_removed(good)]
    classes = plain_classes(lines)
    near = [(i, text) for i, text in lines if classes.get(i, i) == i]
    leaking = {i for i, _ in plain_leaks(near, items)}
    left = {i: text for i, text in near if i not in leaking}
    stages = [len(rows), len(good), len({i for i, text in lines if dict(good)[i] != text}), len(near), len(left)]
    assert stages[0] > stages[1] > stages[3] > stages[4] and stages[2]

    expected = []
    for i, text in left.items():
        ids = np.array([*plain_ids("word_bpe_49k.json", text), 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(row[c] for c in columns) for row in got) == sorted(expected)
    fill = {}
    for row in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == fill.get(row["sequence_id"], 0)
        fill[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(fill.values()) <= 2048


def test_documents_shorter_than_an_item_do_not_pass(spark, tmp_path):
    item = [f"k{i}" for i in range(59)]
    spark.createDataFrame([(1, " ".join(item), "w")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(cut, " ".join(item[: 59 - cut])) for cut in (0, 1, 2, 4, 13, 14, 30)]
    rows += [(100, " ".join(item[3:])), (101, "k1 k2 k3"), (102, " ".join(item[:20] + item[24:]))]
    kept = corpus_pipeline.remove_leaks(spark, awkward(spark, rows), str(tmp_path)).collect()
    # 42 of 55 shingles are similar, 41 are not; without four words in the middle 47 of 55 are left.
    assert {row["doc_id"] for row in kept} == {14, 30, 101}
