"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much go.

A line fails when one of four rules fires: too many words with symbols, too many words
with repeated exclamation or question marks, a long line without any punctuation
(punctuation rules), separators between link names (navigation rule), or one of
``BOILERPLATE`` in it. A document also fails with too few words or too many repeated
three-word windows (base rules).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture in English, German, French and Spanish; compared with the
#: lower-cased line.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "privacy policy",
    "sign up for our newsletter", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookie-einstellungen", "cookies akzeptieren", "datenschutzerklärung",
    "javascript aktivieren", "newsletter abonnieren", "nutzungsbedingungen",
    "accepter les cookies", "activer javascript", "mentions légales", "politique de confidentialité",
    "politique de cookies", "recevoir notre newsletter", "tous droits réservés",
    "aceptar cookies", "activar javascript", "aviso legal", "política de cookies", "política de privacidad",
    "suscríbete a nuestro boletín", "todos los derechos reservados", "términos de uso",
)
#: Shares in percent above which a line fails.
SYMBOL_WORDS, SHOUTED_WORDS, SEPARATOR_WORDS = 30, 30, 20
#: Words from which a line needs a punctuation mark.
LONG_LINE = 20
MIN_WORDS = 50
#: Shares in percent above which a document fails.
MAX_REPEATED, MAX_LOST = 50, 50

_SUSPECT = re.compile(r"[#*$%&|<>]|!!|\?\?|[»›•·]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SEPARATOR = re.compile(r"[|»›•·>]+\Z")
_MARK = re.compile(r"[.!?,;:…。]")
_GAP = re.compile(r"[\x20\x09-\x0D]+")

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_failed_lines long, line_chars long, lost_chars long, "
    "base_failed boolean, kept boolean, cleaned string"
)


def _line_fails(line: str, phrases: Sequence[str]) -> bool:
    if _SUSPECT.search(line):
        words = [word for word in _GAP.split(line) if word]
        symbols = sum(1 for word in words if _SYMBOL.search(word))
        shouted = sum(1 for word in words if "!!" in word or "??" in word)
        separators = sum(1 for word in words if _SEPARATOR.match(word))
        if (
            100 * symbols > SYMBOL_WORDS * len(words)
            or 100 * shouted > SHOUTED_WORDS * len(words)
            or (separators >= 3 and 100 * separators > SEPARATOR_WORDS * len(words))
        ):
            return True
    if not _MARK.search(line) and len([word for word in _GAP.split(line) if word]) >= LONG_LINE:
        return True
    if phrases:
        lowered = line.lower()
        return any(phrase in lowered for phrase in phrases)
    return False


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice, first one included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], "int64")
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(
        pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True
    )
    start = counts[which] >= 2
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(start)] |= start
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """The fields of ``RESULT`` for one text; a null text has no words and null ``cleaned``."""
    raw = text or ""
    words = raw.encode("utf-8", "surrogatepass").split()
    gaps = sum(raw.count(gap) for gap in " \t\n\v\f\r")
    lines = raw.split("\n")
    filled = [line for line in lines if line and not (line.isspace() and not _GAP.sub("", line))]
    symbols = sum(raw.count(symbol) for symbol in SYMBOLS)
    lowered = raw.lower()
    phrases = [phrase for phrase in BOILERPLATE if phrase in lowered]
    good = [line for line in lines if not _line_fails(line, phrases)]
    line_chars = len(raw) - len(lines) + 1
    lost = line_chars - sum(map(len, good))
    repeated = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    return (
        len(words),
        len(raw) - gaps,
        symbols,
        len(filled) - len(set(filled)),
        repeated,
        len(lines) if text is not None else 0,
        len(lines) - len(good),
        line_chars,
        lost,
        base_failed,
        not base_failed and 100 * lost <= MAX_LOST * line_chars,
        None if text is None else "\n".join(good),
    )


def quality(text: Column | str) -> Column:
    """A struct of ``RESULT`` for each text.

    Null: no words, no lines, failed, ``cleaned`` null. Empty: as null with one empty
    line and ``cleaned`` empty. Rows are judged one by one, so repeated rows, ties and
    other columns make no difference. ``cleaned`` is the text without failing lines.
    """

    @F.pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        names = [field.split()[0] for field in RESULT.split(", ")]
        return pd.DataFrame([judge(text) for text in texts], columns=names)

    return judged.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def quality_sql() -> str:
    """DuckDB SQL with the numbers and verdicts of ``quality`` for ``documents``."""
    phrases = " OR ".join(f"contains(lower(line), '{phrase}')" for phrase in BOILERPLATE)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c >= 2)
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), judged AS (
  SELECT doc_id, line, w,
    100 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > {SYMBOL_WORDS} * len(w)
    OR 100 * len(list_filter(w, lambda x: contains(x, '!!') OR contains(x, '??'))) > {SHOUTED_WORDS} * len(w)
    OR (len(list_filter(w, lambda x: regexp_full_match(x, '[|»›•·>]+'))) >= 3
        AND 100 * len(list_filter(w, lambda x: regexp_full_match(x, '[|»›•·>]+'))) > {SEPARATOR_WORDS} * len(w))
    OR (len(w) >= {LONG_LINE} AND NOT regexp_matches(line, '[.!?,;:…。]'))
    OR {phrases} AS bad
  FROM lines
), per AS (
  SELECT doc_id, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS n_dup_lines,
    count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines,
    sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (bad), 0) AS lost_chars
  FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(words) AS n_words,
    cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, word_chars, cast(n_symbols AS BIGINT) AS n_symbols,
  cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(n_repeat_words AS BIGINT) AS n_repeat_words,
  cast(n_lines AS BIGINT) AS n_lines, cast(n_failed_lines AS BIGINT) AS n_failed_lines,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    AND 100 * lost_chars <= {MAX_LOST} * line_chars AS kept
FROM base JOIN per USING (doc_id)
"""
