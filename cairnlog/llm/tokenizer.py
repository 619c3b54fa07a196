"""Token ids of whole texts by the tokenizers library, without encoding a word twice.

The library spends most of its time on words it has seen before. For pre-tokenizers of the
two kinds below, texts of Latin letters, digits, ASCII punctuation, spaces and line feeds
are cut into the pre-tokenizer's pieces by its own rules, written for the bytes of these
characters; many texts are cut at once and each of their different pieces is looked up
once. Pieces are remembered per Python worker, up to a bound, and only new ones go to the
library's model. In other texts only the parts between single spaces that have
other characters go to the library, since neither pre-tokenizer looks across a space
between two visible characters. Files with any other kind of pre-tokenizer are encoded
text by text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Pieces that one Python worker remembers in each of two generations.
REMEMBERED = 200_000
#: Characters of texts that are cut at once; a longer text is cut alone.
AT_ONCE = 500_000

_RARE_SPACE = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Any character that pieces are not cut at here.
_OTHER = re.compile(f"[^\n -~{_LETTERS}]")
# The expressions of both pre-tokenizers, for the characters above.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED_PIECES = re.compile(
    rf"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
_WORD_PIECES = re.compile(rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

# Kinds of bytes in texts without other characters; every byte beyond ASCII is in a letter.
_SPACE, _FEED, _EDGE, _LETTER, _DIGIT, _SIGN = range(6)
_KINDS = np.full(256, _SIGN, "u1")
_KINDS[[0x20, 0x0A, 0x00]] = _SPACE, _FEED, _EDGE
_KINDS[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
#: What may follow an apostrophe, by size.
_ENDINGS = {
    size: np.array([list(x[1:].encode()) for x in _SUFFIXES.split("|") if len(x) == size + 1], "u1")
    for size in (1, 2)
}


def _starts(data: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces start in the bytes of texts that a zero byte follows each.

    A zero byte is a piece. Where pieces have no spaces, one space is still put before
    the piece that follows it, and the other spaces and line feeds are pieces.
    """
    kind = _KINDS[data]
    blank = kind <= _FEED
    changes = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=changes[1:])
    if not spaced:
        changes |= kind == _DIGIT
    starts = changes.copy()
    # A space belongs to what is visible after it. Of several blanks the last is on its own.
    led = (kind[:-1] == _SPACE) & (kind[1:] > _EDGE)
    starts[1:] &= ~led
    inner = blank[1:] & blank[:-1]
    starts[1:] &= ~inner
    starts[1:-1] |= inner[:-1] & (kind[2:] > _EDGE)
    # An ending such as 's is a piece where a piece could start with its apostrophe.
    at = np.flatnonzero(data == 0x27)
    at = at[(starts if spaced else changes)[at]]
    at = at[kind[at + 1] == _LETTER]
    for size, endings in _ENDINGS.items():
        near = data[np.minimum(at[:, None] + np.arange(1, size + 1), len(data) - 1)]
        found = at[(near[:, None] == endings).all(axis=2).any(axis=1)]
        starts[found + 1] = False
        starts[found + 1 + size] = True
    return np.flatnonzero(starts)


def _byte_table() -> dict[int, str]:
    """Byte-level BPE writes bytes as visible characters: printable Latin-1 ones stay."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable}
    table.update({b: chr(256 + i) for i, b in enumerate(others)})
    return table


def _only_single_spaces(text: str) -> bool:
    """Whether every space stands between two visible characters; may say no too often."""
    return not (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[0] == " "
        or text[-1] == " "
        or _RARE_SPACE.search(text)
    )


class _Remembered(dict):
    """Values by key, made when first asked for; an old generation is asked before."""

    def __init__(self, make, old: dict | None = None) -> None:
        self.make = make
        self.old = old or {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def bounded(self) -> _Remembered:
        """This one, or a new one that takes over what it meets again."""
        if len(self) <= REMEMBERED:
            return self
        self.old = {}
        return _Remembered(self.make, self)


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        plain_model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.lead = ""
        self.mode = "whole"
        if not plain_model or any(token["lstrip"] or token["rstrip"] for token in spec["added_tokens"]):
            pass
        elif (
            before.get("type") == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
            and spec.get("normalizer") is None
        ):
            self.mode, self.lead, self.cut = "spaced", " ", _SPACED_PIECES.findall
        elif (
            before.get("type") == "Sequence"
            and [step["type"] for step in before["pretokenizers"]] == ["Split", "ByteLevel"]
            and before["pretokenizers"][0]["behavior"] == "Removed"
            and r"[\p{L}]+|[\p{N}]|" in before["pretokenizers"][0]["pattern"].get("Regex", "")
            and [step["type"] for step in steps] == ["NFC", "Replace", "Lowercase"]
        ):
            self.mode, self.cut = "words", _WORD_PIECES.findall
        self.added = [token["content"] for token in spec["added_tokens"]]
        self.table = _byte_table()
        self.pieces = _Remembered(self._piece)
        self.parts = _Remembered(self._part)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        plain: list[str] = []
        waiting: list[bytes | None] = []
        size = 0
        for text in texts:
            if waiting and size + len(text or "") > AT_ONCE:
                yield from self._filled(waiting, plain)
                plain, waiting, size = [], [], 0
            size += len(text or "")
            if text and self.mode != "whole" and self._is_plain(text):
                plain.append(text)
                waiting.append(None)
            else:
                waiting.append(self._other(text) if text else b"")
        yield from self._filled(waiting, plain)

    def _filled(self, waiting: list[bytes | None], plain: list[str]) -> Iterator[bytes]:
        """The list with the ids of plain texts in the places that are open."""
        found = iter(self._plain_texts(plain) if plain else ())
        for ids in waiting:
            yield next(found) if ids is None else ids

    def _plain_texts(self, texts: list[str]) -> Iterator[bytes]:
        whole = "\0".join(texts) + "\0"
        data = np.frombuffer((whole.lower() if self.mode == "words" else whole).encode(), "u1")
        starts = _starts(data, self.mode == "spaced")
        ends = np.append(starts, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.mode == "words":
            different = [piece.strip() for piece in different]
        self.pieces = self.pieces.bounded()
        ids = list(map(self.pieces.__getitem__, different))
        sizes = np.fromiter(map(len, ids), "int64", len(ids)) // 4
        known = np.frombuffer(b"".join(ids), "<u4")
        own = sizes[which]
        after = np.cumsum(own)
        shift = (np.cumsum(sizes) - sizes)[which] - (after - own)
        out = known[np.arange(after[-1]) + np.repeat(shift, own)]
        at = 0
        for end in after[data[starts] == 0].tolist():
            yield out[at:end].tobytes()
            at = end

    def _other(self, text: str) -> bytes:
        if self.mode == "whole":
            return self._library(text)
        self.pieces = self.pieces.bounded()
        self.parts = self.parts.bounded()
        if self.mode == "words":
            return b"".join([self.parts[part] for part in text.replace("\n", " ").split(" ")])
        parts = text.split(" ") if _only_single_spaces(text) else _CLEAN_SPACE.split(text)
        first = self._plain(parts[0]) if self._is_plain(parts[0]) else self._library(parts[0])
        return first + b"".join([self.parts[part] for part in parts[1:]])

    def _is_plain(self, text: str) -> bool:
        return _OTHER.search(text) is None and not any(token in text for token in self.added)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        pieces = self.cut(text.lower() if self.mode == "words" else text)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _part(self, part: str) -> bytes:
        """Ids of what stands between two single spaces."""
        if not part and not self.lead:
            return b""
        part = self.lead + part
        return self._plain(part) if self._is_plain(part) else self._library(part)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, by the library's model; the end of a text has none."""
        if piece == "\0":
            return b""
        if piece.isascii():
            visible = piece.replace(" ", self.table[0x20]).replace("\n", self.table[0x0A])
        else:
            visible = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [token.id for token in self.tokenize(visible)]).tobytes()


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker; one for each file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
