"""Reading answers out of free text and comparing them with what was expected.

Answers travel as JSON text (``42``, ``"KERNEL"``, ``["A", "B"]``), which keeps their
type through the plan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.once import add_once
from .binding import let
from .parsing import strip
from .text import mentions

# How JSON is looked for in an answer, in this order.
FENCED_JSON = r"(?s)```json\s*\n(.*?)\n```"
FENCED_ANY = r"(?s)```\s*\n(.*?)\n```"
BARE_JSON = (r"(?s)\{[^{}]*\}", r"(?s)\{.*?\}", r"(?s)\[.*?\]")
FIRST_INTEGER = r"(?U)\b(\d+)\b"
QUOTED_TEXT = r'(?s)"([^"]+)"'

# The wording of reasons and of what an evaluator left out.
NO_INTEGER_IN = "Could not extract integer from: "
NOT_AN_INTEGER = "Could not convert to integer: "
WITHIN_TOLERANCE = "Correct (within tolerance ±"
GOT = "Incorrect: got "
BUT_EXPECTED = ", expected "
MATCHED = "Matched expected value: "
NO_MATCH = "Did not match any expected values"
NOT_A_LIST = "Answer is not a list: "
EXACT_ORDER = "Correct (exact order match)"
OTHER_ORDER = "Incorrect order: got "
ALL_PRESENT = "Correct (all items present, order ignored)"
OTHER_ITEMS = "Incorrect: "
UNKNOWN_TYPE = "Unknown answer type: "
NO_REASONING = "No reasoning provided"
NOT_READ = "Could not parse JSON evaluation. Used heuristic."

# Words by which an evaluator accepts when its JSON cannot be read.
ACCEPT_WORDS = ("acceptable", "adequate", "satisfactory", "good", "correct", "yes")


def normalize_label(text: Column) -> Column:
    """0, 1 or null from a detector's reply.

    "abnormal" contains "normal" and so reads as 0.
    """
    text = strip(text)
    # The last run of digits that is just 0 or 1; the greedy start looks from the end.
    lone = F.regexp_extract(text, r"(?Us)^.*(?<!\d)([01])(?!\d)", 1)
    return F.coalesce(
        F.when(text.contains('"label": 0') | text.contains('"label":0'), F.lit(0)),
        F.when(text.contains('"label": 1') | text.contains('"label":1'), F.lit(1)),
        lone.try_cast("int"),
        F.when(text.rlike("(?i)normal"), F.lit(0)),
        F.when(text.rlike("(?i)anomal"), F.lit(1)),
    )


def prediction_status(expected: Column, predicted: Column) -> Column:
    """``correct``, ``wrong`` or ``unparseable``."""
    return (
        F.when(predicted.isNull(), "unparseable")
        .when(predicted == expected, "correct")
        .otherwise("wrong")
    )


def _is_json(text: Column) -> Column:
    # Refused text costs an exception inside the reader; most shows in its first letter.
    # The reader stops after the first value. What follows it shows when the text stands
    # inside an object and inside an array: only a single value fits both.
    inside = [F.concat(F.lit(a), text, F.lit(b)) for a, b in (('{"v":', "}"), ("[", "]"))]
    whole = F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull()
    return text.rlike(r"^\s*[\[{\"\-0-9tfn]") & F.try_parse_json(text).isNotNull() & whole


def _integer_text(digits: Column) -> Column:
    """Digits as a JSON number of any length: no leading zeros."""
    return F.when(digits.rlike("^[0-9]+$"), F.regexp_replace(digits, "^0+(?=[0-9])", "")).otherwise(
        digits.try_cast("decimal(38,0)").cast("string")
    )


def extract_json(text: Column) -> Column:
    """The first JSON value found in the text, as JSON text; null when there is none."""

    def valid(found: Column) -> Column:
        return let(found, lambda x: F.when(_is_json(x), x))

    # A text without a fence or bracket need not be searched for one.
    fence = text.contains("```")
    candidates = [
        F.when(fence, valid(F.regexp_extract(text, FENCED_JSON, 1))),
        F.when(fence, valid(F.regexp_extract(text, FENCED_ANY, 1))),
    ]
    for pattern in BARE_JSON:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        candidates.append(F.try_element_at(F.filter(found, _is_json), F.lit(1)))
    candidates.append(valid(strip(text)))
    number = F.regexp_extract(text, FIRST_INTEGER, 1)
    candidates.append(F.when(number != "", _integer_text(number)))
    quoted = F.regexp_extract(text, QUOTED_TEXT, 1)
    escaped = F.replace(F.replace(quoted, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    candidates.append(F.when(quoted != "", F.concat(F.lit('"'), escaped, F.lit('"'))))
    return F.coalesce(*candidates)


def unwrap_answer(json: Column) -> Column:
    """The value under the key ``answer`` of an object, else the value itself."""
    inner = F.try_variant_get(F.try_parse_json(json), "$.answer", "variant")
    return F.coalesce(F.to_json(inner), json)


def json_kind(json: Column) -> Column:
    """``string``, ``list``, ``object``, ``null``, ``boolean`` or ``number``."""
    first = F.substring(F.ltrim(json), 1, 1)
    return (
        F.when(first == '"', "string")
        .when(first == "[", "list")
        .when(first == "{", "object")
        .when(first == "n", "null")
        .when(first.isin("t", "f"), "boolean")
        .otherwise("number")
    )


def json_plain(json: Column) -> Column:
    """A JSON value as plain text: strings lose their quotes."""
    bare = F.trim(json)
    # Only a text with escapes needs a JSON reader.
    unquoted = F.when(
        json.contains("\\"), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    ).otherwise(F.substring(bare, F.lit(2), F.length(bare) - 2))
    return F.when(json_kind(json) == "string", unquoted).otherwise(json)


def json_integer(kind: Column, plain: Column) -> Column:
    """An integer: the first digits of a string, a number cut to its whole part."""
    number = F.coalesce(plain.try_cast("long"), plain.try_cast("double").try_cast("long"))
    return (
        F.when(kind == "string", F.regexp_extract(plain, r"(?U)\d+", 0).try_cast("long"))
        .when(kind == "boolean", F.when(plain == "true", F.lit(1)).otherwise(F.lit(0)).cast("long"))
        .when(kind == "number", number)
    )


def answer_items(json: Column, kind: Column, plain: Column) -> Column:
    """Items of a list answer; text is cut at commas, semicolons and line ends."""
    pieces = F.filter(F.transform(F.split(plain, "[,;\n]"), strip), lambda p: p != "")
    listed = F.transform(F.from_json(json, "array<string>"), strip)
    return F.when(kind == "list", listed).when(kind == "string", pieces)


class Answer(NamedTuple):
    """The readings of an answer that comparisons are made of."""

    kind: Column
    plain: Column
    integer: Column
    items: Column


def read_answer(json: Column) -> Answer:
    kind, plain = json_kind(json), json_plain(json)
    return Answer(kind, plain, json_integer(kind, plain), answer_items(json, kind, plain))


def with_answer(frame: DataFrame, response: Column) -> tuple[DataFrame, Answer]:
    """Add the answer in ``response`` to a frame and give its readings.

    The text is searched once per row; what is found (``found_json``), the answer in it
    (``answer_json``) and each reading (``answer_kind`` and so on) are columns.
    """
    frame = add_once(frame, {"found_json": extract_json(response)}).withColumn(
        "answer_json", unwrap_answer(F.col("found_json"))
    )
    json, kind, plain = (F.col(f"answer_{name}") for name in ("json", "kind", "plain"))
    frame = frame.withColumns({"answer_kind": json_kind(json), "answer_plain": json_plain(json)})
    frame = frame.withColumns(
        {
            "answer_integer": json_integer(kind, plain),
            "answer_items": answer_items(json, kind, plain),
        }
    )
    return frame, Answer(*(F.col(f"answer_{name}") for name in Answer._fields))


def typed_answer(answer: Answer, answer_type: Column) -> Column:
    """The answer in the shape its question asks for."""
    return F.struct(
        F.when(answer_type == "integer", answer.integer).alias("integer"),
        F.when(answer_type == "string_match", answer.plain).alias("text"),
        F.when((answer_type == "list") & (answer.kind == "list"), answer.items).alias("items"),
    )


def _verdict(correct: Column, reason: Column, answer: Column, difference: Column) -> Column:
    return F.struct(
        F.coalesce(correct, F.lit(False)).alias("correct"),
        reason.alias("reason"),
        answer.alias("answer"),
        difference.cast("long").alias("difference"),
    )


def compare_integer(found: Answer, expected: Column, tolerance: Column) -> Column:
    """Verdict for a number within a tolerance."""
    value = found.integer
    difference = F.abs(value - expected)
    tolerance = F.coalesce(tolerance, F.lit(0))
    unread = F.when(found.kind == "string", NO_INTEGER_IN).otherwise(
        NOT_AN_INTEGER
    )
    reason = (
        F.when(value.isNull(), F.concat(unread, found.plain))
        .when(
            difference <= tolerance,
            F.concat(F.lit(WITHIN_TOLERANCE), tolerance.cast("string"), F.lit(")")),
        )
        .otherwise(
            F.concat(
                F.lit(GOT),
                value.cast("string"),
                F.lit(BUT_EXPECTED),
                expected.cast("string"),
                F.lit(" (±"),
                tolerance.cast("string"),
                F.lit(")"),
            )
        )
    )
    answer = F.coalesce(value.cast("string"), found.plain)
    return _verdict(difference <= tolerance, reason, answer, difference)


def compare_string(found: Answer, expected: Column, case_sensitive: Column) -> Column:
    """Verdict for a text that contains, or is contained in, an expected one.

    An empty answer is contained in any text.
    """
    plain = strip(found.plain)
    exact = F.coalesce(case_sensitive, F.lit(False))
    folded = F.when(exact, plain).otherwise(F.lower(plain))
    wanted = F.when(exact, expected).otherwise(F.transform(expected, F.lower))
    hits = F.filter(wanted, lambda e: F.contains(folded, e) | F.contains(e, folded))

    def verdict(first: Column) -> Column:
        matched = F.concat(F.lit(MATCHED), first)
        reason = F.coalesce(matched, F.lit(NO_MATCH))
        return _verdict(first.isNotNull(), reason, plain, F.lit(None))

    return let(F.try_element_at(hits, F.lit(1)), verdict)


def _folded(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: F.lower(strip(x)))))


def missing_items(items: Column, expected: Column) -> Column:
    """Expected items that the answer lacks, any case, sorted."""
    return F.array_except(_folded(expected), _folded(items))


def extra_items(items: Column, expected: Column) -> Column:
    """Answer items that were not expected, any case, sorted."""
    return F.array_except(_folded(items), _folded(expected))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def compare_list(found: Answer, expected: Column, order_matters: Column) -> Column:
    """Verdict for a list, as a set unless the order matters."""
    ordered = F.coalesce(order_matters, F.lit(False))

    def verdict(x: Column) -> Column:
        items, wanted, missing, extra = (x[n] for n in ("items", "wanted", "missing", "extra"))
        same_set = (F.size(missing) == 0) & (F.size(extra) == 0)
        correct = F.when(ordered, items == wanted).otherwise(same_set)
        parts = F.concat_ws(
            ", ",
            F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), _listed(missing))),
            F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), _listed(extra))),
        )
        in_order = (F.lit(OTHER_ORDER), _listed(items), F.lit(BUT_EXPECTED), _listed(wanted))
        reason = (
            F.when(items.isNull(), F.concat(F.lit(NOT_A_LIST), found.kind))
            .when(ordered & correct, EXACT_ORDER)
            .when(ordered, F.concat(*in_order))
            .when(correct, ALL_PRESENT)
            .otherwise(F.concat(F.lit(OTHER_ITEMS), parts))
        )
        answer = F.coalesce(_listed(items), found.plain)
        return _verdict(correct, reason, answer, F.lit(None))

    def compared(folded: Column) -> Column:
        got, want = folded["got"], folded["want"]
        return F.struct(
            found.items.alias("items"),
            F.transform(expected, strip).alias("wanted"),
            F.array_except(want, got).alias("missing"),
            F.array_except(got, want).alias("extra"),
        )

    folded = F.struct(_folded(found.items).alias("got"), _folded(expected).alias("want"))
    return let(let(folded, compared), verdict)


def compare(found: Answer, spec: dict[str, Column]) -> Column:
    """Verdict by the question's ``answer_type``; ``spec`` names the columns of a question."""
    kind = spec["answer_type"]
    unknown = _verdict(
        F.lit(False),
        F.concat(F.lit(UNKNOWN_TYPE), F.coalesce(kind, F.lit("None"))),
        found.plain,
        F.lit(None),
    )
    return (
        F.when(
            kind == "integer", compare_integer(found, spec["expected_int"], spec["tolerance"])
        )
        .when(
            kind == "string_match",
            compare_string(found, spec["expected_list"], spec["case_sensitive"]),
        )
        .when(kind == "list", compare_list(found, spec["expected_list"], spec["order_matters"]))
        .otherwise(unknown)
    )


def parse_verdict(text: Column) -> Column:
    """An evaluator's reply as acceptable, reasoning and suggestions.

    "not acceptable" and "incorrect" contain accepting words and so read as accepted
    when no JSON can be read.
    """
    # Without a closing fence the text runs to one character before its end.
    fenced = r"(?s)```%s(.*?)(?:```|.\z)"
    body = strip(
        F.when(text.contains("```json"), F.regexp_extract(text, fenced % "json", 1))
        .when(text.contains("```"), F.regexp_extract(text, fenced % "", 1))
        .otherwise(text)
    )
    parsed = F.try_parse_json(body)
    accepted = F.to_json(F.try_variant_get(parsed, "$.acceptable", "variant"))
    readable = accepted.isNotNull()
    by_words = mentions(F.lower(text), ACCEPT_WORDS)
    return F.struct(
        F.when(readable, ~accepted.isin("false", "null", "0", '""', "[]", "{}"))
        .otherwise(by_words)
        .alias("acceptable"),
        F.when(
            readable,
            F.coalesce(
                F.try_variant_get(parsed, "$.reasoning", "string"), F.lit(NO_REASONING)
            ),
        )
        .otherwise(F.lit(NOT_READ))
        .alias("reasoning"),
        F.when(
            readable,
            F.coalesce(F.try_variant_get(parsed, "$.suggestions", "string"), F.lit("")),
        )
        .otherwise(F.when(by_words, F.lit("")).otherwise(text))
        .alias("suggestions"),
    )
