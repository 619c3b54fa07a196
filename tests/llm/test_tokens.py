"""Token files and packing: round trips and plain versions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnlog.llm import packing, token_files, tokenizer
from cairnlog.llm.queries import tokenizer_file
from cairnlog.llm.shipping import ship_code
from cairnlog.llm.storage import new_folder

from .helpers import awkward, awkward_rows, empty

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(autouse=True)
def code(spark):
    ship_code(spark)


def plain_ids(name, text):
    if not hasattr(plain_ids, name):
        setattr(plain_ids, name, Tokenizer.from_file(tokenizer_file(name)))
    return getattr(plain_ids, name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_chunks_give_the_ids_of_the_whole_text(name, monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 500)
    rng = random.Random(8)
    pieces = [*"ab Zß \n\t é1.,'!\x1ćΣ", "<|endoftext|>", "  ", "don't", " ", "日本", "İ", "ſ", "word", "Über"]
    encode = tokenizer.TextEncoder(tokenizer_file(name)).encode
    for _ in range(3_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(name, text)


@pytest.mark.parametrize("at_once", [1, 60, 500_000])
@pytest.mark.parametrize("name", FILES)
def test_many_texts_at_once(name, at_once, monkeypatch):
    monkeypatch.setattr(tokenizer, "AT_ONCE", at_once)
    rng = random.Random(9)
    pieces = [*"ab Zßé \n 19.,'", "'s", "'re", "'LL", "''", "'ve ", " 't", "\n\n", "  ", "word", "日"]
    weights = [*[4] * (len(pieces) - 1), 0.1]
    texts = ["".join(rng.choices(pieces, weights, k=rng.randrange(20))) for _ in range(3_000)]
    texts[::100] = [None] * 30
    texts[50::100] = ["a\0b", "<|endoftext|>", "\0"] * 10
    found = tokenizer.TextEncoder(tokenizer_file(name)).encode_all(texts)
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text), repr(text)


@pytest.mark.parametrize("name", FILES)
def test_repeated_pieces_are_looked_up_once(name, monkeypatch):
    """CPU goes with different pieces of many texts, not with each place of a piece."""
    asked = []

    class Asked(tokenizer._Remembered):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(tokenizer, "_Remembered", Asked)
    made = tokenizer.TextEncoder(tokenizer_file(name))
    assert len(list(made.encode_all(["One word, another word's\n"] * 500))) == 500
    assert len(asked) <= 10


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.randoms())
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(values, rng):
    ids = np.array(values, "<u4")
    cuts = sorted(rng.randrange(len(ids) + 1) for _ in range(3))
    lengths = np.diff([0, *cuts, len(ids)])
    file = token_files.TokenFile(token_files.encode_ids(ids, lengths))
    assert [part.tolist() for part in file.documents()] == [
        part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])
    ]
    begin = rng.randrange(len(ids) + 1)
    assert file.ids(begin, len(ids)).tolist() == ids[begin:].tolist()


def test_outliers_are_exceptions():
    ids = np.full(5_000, 7, "<u4")
    ids[::1_000] = 4_000_000_000
    packed = token_files.encode_ids(ids, np.array([5_000]))
    assert len(packed) < 300 and token_files.TokenFile(packed).ids(0, 5_000).tolist() == ids.tolist()


@pytest.mark.parametrize("file_ids", [token_files.FILE_IDS, 50])
def test_token_files(spark, file_ids):
    rows = awkward_rows()
    folder = new_folder(spark, "test-ids")
    path = tokenizer_file(FILES[0])
    files = token_files.write_token_files(awkward(spark, rows), path, folder, file_ids=file_ids)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert files.agg({"n_docs": "sum"}).first()[0] == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] or ""))
    start = 0
    for row, (doc, text) in zip(got, order, strict=True):
        ids = [*plain_ids(FILES[0], text), 0]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, start, len(ids))
        assert zlib.crc32(row["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_nothing(spark):
    folder = new_folder(spark, "test-ids")
    token_files.write_token_files(empty(spark), tokenizer_file(FILES[0]), folder)
    assert token_files.read_token_files(spark, folder).collect() == []


def test_best_fit_takes_the_tightest_bin():
    bins, opened = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert opened == 2 and bins[0] == bins[2] and bins[1] == bins[3] == bins[4]


@pytest.mark.parametrize("per_task", [packing.ITEMS_PER_TASK, 5])
def test_packing(spark, per_task):
    rows = awkward_rows()
    pieces = packing.tokenize_pieces(awkward(spark, rows), tokenizer_file(FILES[1]), capacity=64)
    places = packing.assign_sequences(pieces, capacity=64, items_per_task=per_task)
    joined = pieces.join(places, "item_id").collect()
    expected = []
    for doc, text in rows:
        ids = [*plain_ids(FILES[1], text), 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            expected.append((doc is None, doc or 0, piece, at, ids[at : at + 64]))
    got = [
        (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist())
        for r in joined
    ]
    assert sorted(got) == sorted(expected)
    by = {}
    for row in joined:
        by.setdefault(row["sequence_id"], []).append((row["offset"], row["length"], bytes(row["ids"])))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x[4]) for x in expected)
    assert len(by) <= -(-total // 64) + (1 if per_task > 5 else 6)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces, places).collect()}
    assert whole == {s: b"".join(ids for _, _, ids in sorted(parts)) for s, parts in by.items()}


def test_packing_of_nothing_and_of_wrong_lengths(spark):
    pieces = packing.tokenize_pieces(empty(spark), tokenizer_file(FILES[1]))
    assert packing.assign_sequences(pieces).collect() == []
    wrong = spark.createDataFrame([(1, 3000)], "item_id long, length long")
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.assign_sequences(wrong).collect()


def test_pieces_that_never_fit_together_end_the_rounds(spark):
    items = spark.range(200).selectExpr("id as item_id", "1500L as length")
    places = packing.assign_sequences(items, items_per_task=10)
    assert places.select("sequence_id").distinct().count() == 200
