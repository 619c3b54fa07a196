"""Awkward documents and plain versions of what the operators compute."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")

# Extra columns whose names operators use inside.
COLUMNS = "doc_id long, text string, id string, kept string, quality string, Deduped string, item_id int"


def sentence(rng, words, size):
    return " ".join(rng.choice(words) for _ in range(size))


def awkward_rows(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = sentence(rng, words, 40)
    lines = "\n".join(sentence(rng, words, 9) + "." for _ in range(30))
    base = sentence(rng, words, 120)
    edited = base.split()
    edited[3] = "other"
    texts = [
        None, "", " \n\t ", "one", "Two words", lines, lines, "intro line\n" + lines, base, base.upper(),
        " ".join(edited), base + " tail", "start " + shared + " end", shared,
        sentence(rng, words, 60) + " " + shared, sentence(rng, words, 30_000),
        "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "É ß Σς \x1c  \u2028x\n\n",
    ]
    rows = [(i * 3, text) for i, text in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, base))  # a row without id
    return rows


def awkward(spark, rows=None):
    data = [(*row, "a", "b", "c", "d", 1) for row in (awkward_rows() if rows is None else rows)]
    return spark.createDataFrame(data, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words_of(text):
    return WORD.findall(text or "")


def lowered(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return words_of((text or "").translate(table))
