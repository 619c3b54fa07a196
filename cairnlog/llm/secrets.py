"""Secrets in texts: keywords first, anchored expressions near them, checksums last.

One Aho-Corasick pass over the lower-cased text finds the keywords that a secret must
begin with. Only there an expression is tried, anchored at the keyword. Long hexadecimal
runs have no keyword: each must cover a probe every ``HEX_LENGTH`` characters, and only
runs at such probes are measured. Tokens with an embedded checksum count only if it fits.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order that decides between spans with the same start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

# Expressions and lengths of the kinds.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Prefix, 30 characters and a CRC-32 of these as 6 characters in base 62.
_CHECKED = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
}
_KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
_BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


_AUTOMATON: list = []


def base_62_checksum(body: str) -> str:
    """The CRC-32 of ``body`` as six digits in base 62."""
    number, digits = zlib.crc32(body.encode()), ""
    while number:
        number, digit = divmod(number, 62)
        digits = _BASE_62[digit] + digits
    return digits.rjust(6, "0")


def find_in_text(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end (exclusive, in code points) of all secrets, in order."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((last - size + 1, kind) for last, (size, kind) in _AUTOMATON[0].iter(lowered))
    spans: list[tuple[str, int, int]] = []
    free = {"assign": 0, "access": 0}
    for start, kind in hits:
        if kind in _CHECKED:
            match = _CHECKED[kind].match(text, start)
            if match and base_62_checksum(match[1]) == match[2]:
                spans.append((kind, start, match.end()))
        elif start >= free[kind]:
            match = (_ASSIGN if kind == "assign" else _ACCESS).match(text, start)
            if match:
                free[kind] = match.end()
                long_enough = (
                    len(match[2]) >= ASSIGN_LENGTH
                    if kind == "assign"
                    else match.end() - start >= ACCESS_LENGTH
                )
                if long_enough:
                    spans.append((kind, start, match.end()))
    end = 0
    for probe in _HEX.finditer(text[HEX_LENGTH - 1 :: HEX_LENGTH]):
        for place in range(probe.start(), probe.end()):
            at = HEX_LENGTH - 1 + place * HEX_LENGTH
            if at < end:
                continue
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = _HEX.match(text, at).end()
            if end - start >= HEX_LENGTH:
                spans.append(("hex", start, end))
    spans.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    return spans


def secrets(text: Column | str) -> Column:
    """``array<struct<kind, start, end>>`` of each text's secrets by start, then kind.

    Kinds: ``assign`` (a name, a sign and a value), ``access`` (key ids), ``hex`` (long
    runs), and with a checksum that fits, ``github`` and ``npm``. Spans of one kind do
    not overlap; those of different kinds may. A null or empty text has none. Rows are
    searched one by one; repeated rows and other columns make no difference.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": k, "start": s, "end": e} for k, s, e in find_in_text(text)] for text in texts],
            dtype=object,
        )

    return found.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
