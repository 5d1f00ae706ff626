"""Column helpers for character positions, pieces and snippets.

Offsets are Unicode code points, half open.  Slicing goes through UTF-32, where a code point is always
four bytes: taking a piece out of the middle of a long text then costs the piece, not the text before
it, so a text with many findings stays linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.patterns import CAPS_NAME


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``.

    A plain column reference may be inlined by the optimizer into every place that uses it, including
    the inside of a lambda that runs once per array element; the start of a fold is not.  The last step of a fold over
    nothing hands its result on as it is, where ``transform`` copies every element with all the strings in it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, lambda v: body(v))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose expression stays where it is.

    A filter on a plain column is pushed below it by writing the whole expression a second time into the
    filter; what comes out of a generator is never rewritten like that, so a costly ``value`` is computed
    once per row whatever is asked of the result.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


# Texts up to this many characters are sliced as they are: walking to the piece is cheaper than the
# conversion.
SHORT = 2048

# So many characters on each side of a match are its snippet.
AROUND = 20


def code_points(text: Column) -> Column:
    """What ``piece`` slices: the text, and for long texts its UTF-32 form."""
    n = F.length(text)
    return F.struct(text.alias("text"), n.alias("n"), F.when(n > SHORT, F.encode(text, "UTF-32")).alias("wide"))


def piece(points: Column, start: Column, length: Column) -> Column:
    """``length`` characters from 0-based ``start`` of a ``code_points`` value.

    The leading blank keeps a byte-order mark at the start of a piece from being swallowed.
    """
    raw = F.substring(points["wide"], start * 4 + 1, F.greatest(length, F.lit(0)) * 4)
    wide = F.substring(F.decode(F.concat(F.lit(b"\x00\x00\x00\x20"), raw), "UTF-32"), F.lit(2), length + 1)
    return F.when(points["wide"].isNull(), F.substring(points["text"], start + 1, length)).otherwise(wide)


def snippet(points: Column, n_chars: Column, start: Column, end: Column, around: int = AROUND) -> Column:
    """``...{before}[{match}]{after}...`` with at most ``around`` characters on each side."""
    left = F.greatest(start - around, F.lit(0))
    right = F.least(end + around, n_chars)
    return F.concat(
        F.lit("..."), piece(points, left, start - left),
        F.lit("["), piece(points, start, end - start),
        F.lit("]"), piece(points, end, right - end), F.lit("..."),
    )


def short_snippet(text: Column, start: Column, end: Column, around: int = AROUND) -> Column:
    """``snippet`` of a text that is sliced as it is."""
    left = F.greatest(start - around, F.lit(0))
    return F.concat(
        F.lit("..."), F.substring(text, left + 1, start - left),
        F.lit("["), F.substring(text, start + 1, end - start),
        F.lit("]"), F.substring(text, end + 1, F.lit(around)), F.lit("..."),
    )


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replaces every span of ``spans`` (sorted, disjoint, with start and end) in one pass."""

    def rewritten(points: Column) -> Column:
        def part(span: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(piece(points, begin, span["start"] - begin), replacement(span))

        last = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(
            F.array_join(F.transform(spans, part), ""),
            piece(points, last, F.length(text) - last),
        )

    return F.when(F.size(spans) == 0, text).otherwise(let(code_points(text), rewritten))


def title_case(text: Column) -> Column:
    """Upper case for the first letter of every letter run, lower case for the rest.

    Unlike ``initcap`` this treats an apostrophe or a hyphen as the end of a run: O'BRIEN-LEE becomes
    O'Brien-Lee.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))),
        "",
    )


def normalize_titled_caps(text: Column) -> Column:
    """Title-cases ``MR JANE O'BRIEN`` where a title announces a name; every other capital stays.
    The length does not change, so offsets found in the result hold in the original."""
    pattern = "(?s)" + CAPS_NAME
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def glued(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(gaps, lambda g: F.array_join(
            F.transform(g, lambda gap, i: F.concat(gap, F.coalesce(title_case(F.get(found, i)), F.lit("")))), ""))

    return let(names, lambda found: F.when(F.size(found) == 0, text).otherwise(glued(found)))
