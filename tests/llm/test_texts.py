"""Quality rules, secrets, chat views and URL rules on awkward inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairnlog.llm import chat, quality, secrets, url_filter
from cairnlog.llm.shipping import ship_code

from .helpers import awkward, awkward_rows, empty, sentence, words_of


@pytest.fixture(autouse=True)
def code(spark):
    ship_code(spark)


def plain_base(text):
    words, lines = words_of(text), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = set()
    for i, run in enumerate(runs):
        if runs.count(run) > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality(spark):
    rows = [row for row in awkward_rows() if len(row[1] or "") < 5_000]
    rows += [(90, "\n".join(["x y z."] * 20)), (91, "same\nsame\n \n \n" + "a b c " * 30)]
    got = awkward(spark, rows).select("doc_id", "text", quality.quality("text").alias("q")).collect()
    for row in got:
        q = row["q"]
        own = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert own == plain_base(row["text"])
        assert q["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (q["kept"] and q["base_failed"])
        if row["text"] is None:
            assert q["cleaned"] is None


def test_quality_lines():
    rng = random.Random(4)
    prose = "\n".join(sentence(rng, [f"p{i}" for i in range(500)], 30) + "." for _ in range(6))
    menu, shout = "Home | About | Jobs | News | Contact", "BUY!! NOW!! THE!! BEST!!"
    kept = quality.judge(f"{menu}\n{prose}\n{shout}\nAll rights reserved by us.")
    names = [field.split()[0] for field in quality.RESULT.split(", ")]
    row = dict(zip(names, kept))
    assert row["cleaned"] == prose and row["kept"] and row["n_failed_lines"] == 3
    junk = "\n".join(sentence(rng, ["a%%%", "b***", "c##", "word"], 40) + str(i) for i in range(9))
    assert not dict(zip(names, quality.judge(prose[:60] + "\n" + junk)))["kept"]
    assert dict(zip(names, quality.judge(prose)))["cleaned"] == prose


def test_furniture_in_four_languages():
    for phrase in quality.BOILERPLATE:
        assert "'" not in phrase and phrase == phrase.lower()
        found = quality.judge(f"Good line, kept.\n{phrase.capitalize()} here.\nAnother good line, kept.")
        assert found[-1] == "Good line, kept.\nAnother good line, kept."


def test_secrets(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good, bad = f"ghp_{body}{secrets.base_62_checksum(body)}", f"ghp_{body}AAAAAA"
    assert secrets.find_in_text(f"é {good} x") == [("github", 2, 2 + len(good))]
    assert [s for s in secrets.find_in_text(bad) if s[0] == "github"] == []
    texts = [
        "PassWord = 'abc123+/x' token:short secret=12345 api-key=abcdefgh apikey: abcdefgh API_KEY=abcdefgh",
        "paſſword=abcdefgh toKen=abcdefgh", "password=token=abcdef", "password=abcde password=abcdef",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16, "akia" + "A" * 16, "AKIAAKIA" + "B" * 20,
        "f" * 23, "g" + "0" * 24 + "g", "é" * 30 + "abcdef0123456789" * 4, ("a" * 23 + "x") * 9,
        "deadbeef" * 3 + "X" + "deadbeef" * 3, None, "", "secret=" + "0123456789abcdef" * 3,
    ]
    rng = random.Random(9)
    pieces = ["password", "Token", "secret", '"', "'", " ", ":", "=", "abc", "0f", "AKIA", "XYZ9", "é", "\n", "api_", "key"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789abcdefx") for _ in range(200)) for _ in range(50)]
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    frame = awkward(spark, list(enumerate(texts)))
    for row in frame.select("text", secrets.secrets("text").alias("s")).collect():
        text = row["text"] or ""
        spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [(s["kind"], s["start"], s["end"]) for s in row["s"]] == spans
    assert awkward(spark).select(secrets.secrets("text").alias("s")).count() == len(awkward_rows())
    assert empty(spark).select(secrets.secrets("text").alias("s")).collect() == []


def plain_url(url, rules):
    head = url.find("://") if url else -1
    rest = url[head + 3 :] if head >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for entry, verdict in rules:
        h, p = entry[: entry.index("/")], entry[entry.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(entry) > len(best[0]):
                best = (entry, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


@pytest.mark.parametrize("per_shard", [1_000_000, 2])
def test_urls(spark, monkeypatch, per_shard):
    monkeypatch.setattr(url_filter, "ENTRIES_PER_SHARD", per_shard)
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
             ("a.b.org/fr/x", "block"), ("é.org/", "block")]
    urls = [
        None, "", "example.net/en/", "://", "http://NET/", "http://net", "http://net?x=/", "https://a.example.net/en/1#f",
        "http://example.net/en", "http://xexample.net/en/", "http://notnet/", "ftp://a.b.org/fr/xyz", "http://org/fr/",
        "http://É.org/", "http://é.org/", "x://y://net/", "http://example.com/de/?a", "http://example.com./de/",
    ]
    schema = "entry string, verdict string, named boolean"
    entries = [(e, v, True) for e, v in rules] + [(None, "block", True), ("noslash", "block", True), ("bad.org/", "block", False)]
    index = url_filter.write_index(spark.createDataFrame(entries, schema))
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string, id string")
    got = url_filter.judge_urls(pages, index).collect()
    assert len(got) == len(urls) + 1
    for row in got:
        expected = plain_url([*urls, urls[4]][row["page_id"]], rules)
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == expected
    listed = spark.createDataFrame([(1, "http://www.bad.org/x"), (2, "http://good.org/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(listed, index).collect()} == {
        1: (None, "block"), 2: (None, "allow"),
    }
    nothing = url_filter.write_index(spark.createDataFrame([], schema))
    assert {r["verdict"] for r in url_filter.judge_urls(pages, nothing).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), index).collect() == []


def test_equal_digests_do_not_decide(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: 5)
    import numpy as np

    shard = url_filter.Shard(np.frombuffer(url_filter.shard_bytes(["a/", "b/"], [1, 2]), "u1"))
    assert shard.find(np.full(3, 5, "u8"), ["b/", "c/", "a/"]).tolist() == [2, -1, 1]


def test_chat_views(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["ann", "bob", "cy"]), f"turn {t} <|assistant|> x") for t in range(20)]
    rows += [(2, 0, "system", "only rules"), (3, None, None, None), (3, 5, "", "é"), (3, 5, "a|b", "t"), (3, 5, "a|b", "t")]
    rows += [(3, 6, "a_b", "u"), (3, 7, "unknown", "v"), (3, 8, "a%7Cb", "w"), (3, None, "x>\n", "y")]
    rows += [(None, 1, "ann", "lost"), (None, 2, "bob", "found"), (4, 0, "system", "s"), (4, 1, "ann", "")]
    data = [(*row, "x", 3) for row in rows]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part string, viewer int")
    got = chat.rotate_perspectives(frame).collect()
    by = {}
    for row in got:
        by.setdefault((row["conv_id"], row["viewer"]), []).append(row)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "%"), (3, "a%7Cb"), (3, "a_b"), (3, "unknown"), (3, "a%257Cb"), (3, "x%3E%0A"), (None, "ann"), (None, "bob"), (4, "ann")}
    for (conv, viewer), view in by.items():
        view.sort(key=lambda r: r["start"])
        whole = "".join(r["segment"] for r in view)
        assert len(view) == sum(1 for row in rows if row[0] == conv)
        at = 0
        for r in view:
            assert r["start"] == at and whole[r["start"] : r["end"]] == r["segment"]
            at = r["end"]
            learnt = whole[r["learn_start"] : r["learn_end"]]
            assert (r["name"] == viewer) == (r["speaks_as"] == "assistant")
            assert learnt.endswith("<|end|>\n") if r["name"] == viewer else learnt == ""
        assert [r["turn"] for r in view] == sorted((r["turn"] for r in view), key=lambda t: -1 if t is None else t)
    assert chat.rotate_perspectives(frame.limit(0)).collect() == []
    assert all(r["segment"].count("<|assistant|>") <= 1 for r in got)
    assert frame.select(F.lit(1)).count() == len(rows)
