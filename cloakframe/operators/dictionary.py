"""Known strings of a table of any size, looked for in texts: leftmost, and of those the longest.

A text is cut into units: runs of white space, runs of letters, digits and underscores, and single other characters.
A key is the same kind of units, so a match is a stretch of units that equals a key, and finding keys of many units is
a join.  What is handed to the join is small: two bit arrays of bounded size, made from the table, tell inside the row
which units can begin a key and which stretches can be one; the join with the table settles it.  More keys than the
arrays can tell apart are told by what they look like: a code of the first unit (its length, and whether it begins with a
digit), and the form of the key (``form``).  Codes and forms that few keys have stay in the arrays, key by key; for the
others the code or form alone makes a candidate, so the arrays never fill up, however large the table.  The arrays are
scalar subqueries; the table is broadcast only below a measured size, of a larger one only the keys that candidates have
are looked up (``verified``).  Of overlapping
matches a fold along the text keeps the leftmost, then the longest (``folds``).

Two styles: ``names`` ignores case and the kind and amount of white space, and does not match inside a compound
(``smith`` in ``SMITH-JONES``); ``literals`` are compared as they are.  In both a match stands free: no letter, digit
or underscore goes on before or behind it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import running_sums
from cloakframe.functions.text import AROUND
from cloakframe.operators import folds
from cloakframe.operators.lookup import BROADCAST_BYTES, lookup, measured_bytes
from cloakframe.sources.staging import staged

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
UNIT = rf"(?s){GAP}|[\p{{L}}\p{{N}}_]+|."
WORD = r"^[\p{L}\p{N}_]"
#: Characters that make one word of two, in names.
JOINERS = ("'", "’", "-", "#")

# Bits for each key: about 3 % of what is no key passes one array.
_BITS_PER_KEY, _MOST_BITS = 32, 1 << 24


@dataclass(frozen=True)
class Style:
    name: str
    exact: bool

    def normal(self, unit: Column) -> Column:
        if self.exact:
            return unit
        return F.when(F.substring(unit, 1, 1).isin(*BLANKS), F.lit(" ")).otherwise(F.lower(unit))


NAMES, LITERALS = Style("names", False), Style("literals", True)


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _bit(value: Column, bits: int) -> Column:
    return F.pmod(value, F.lit(bits))


def _has(array: Column, value: Column, bits: int) -> Column:
    at = _bit(value, bits)
    word = F.get(array, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


@dataclass(frozen=True)
class Dictionary:
    """A prepared table of keys: (key, pii_type), as often as they were given, and what tells candidates from others."""

    style: Style
    table: DataFrame
    lengths: tuple[int, ...]
    bits: int
    arrays: DataFrame
    #: Codes of first units, any of which can begin a key; and whether a form alone can make a candidate.
    head_codes: tuple[int, ...] = ()
    has_forms: bool = False


def head_code(unit: Column) -> Column:
    return F.length(unit) * 2 + F.substring(unit, 1, 1).between("0", "9").cast("int")


def form(key: Column) -> Column:
    """What a key looks like: every digit 0, every letter a.  Keys of one form have the same units."""
    return F.regexp_replace(F.regexp_replace(key, r"\p{N}", "0"), r"\p{L}", "a")


def _told(sizes: list[tuple[int, int]], most: int) -> int:
    """Of pairs (size of a group, keys in groups of that size) the largest size up to which all keys together are at most
    ``most``."""
    last, so_far = -1, 0
    for size, keys in sorted(sizes):
        so_far += keys
        if so_far > most:
            break
        last = size
    return last


def _normal_key(key: Column, style: Style) -> Column:
    trimmed = F.btrim(key, F.lit(BLANKS))
    if style.exact:
        return trimmed
    return F.array_join(F.transform(units(trimmed), style.normal), "")


def prepared(keys: DataFrame, style: Style = NAMES, key_col: str = "key", type_col: str = "pii_type") -> Dictionary:
    """Keys in the form they are compared in; null keys and those of white space alone are left out.

    The table is written once and read in two passes, added up before any shuffle: what comes out of them has a row for
    each form, code or word of an array, whatever the number of keys.  Counts are of rows or estimates of distinct values;
    they choose what is told by its form, never what is found."""
    rows = keys.select(_normal_key(F.col(key_col), style).alias("key"), F.col(type_col).alias("pii_type")).where("key <> ''")
    table = staged(rows.select("key", form(F.col("key")).alias("f"), "pii_type"), "dictionary")
    # of the form: a unit of a key is as long as that of its form
    head = F.regexp_extract("key", rf"\A(?:{UNIT})", 0)
    counted = staged(table.groupBy("f").agg(F.count("*").alias("n")), "forms")
    lengths = [r["u"] for r in counted.select(F.size(units(F.col("f"))).alias("u")).distinct().collect()]
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # of an array of the largest size one bit in eight is set at most
    most_told = _MOST_BITS >> 3
    if rows > most_told:
        rows = min(rows, math.ceil(table.agg(F.approx_count_distinct("key").alias("n")).first()["n"] * 1.1))
    bits = min(_MOST_BITS, 1 << max(12, math.ceil(math.log2(max(1, rows) * _BITS_PER_KEY))))
    marked = table.select("key", head.alias("head"))
    codes, whole, forms = (), marked, None
    if rows > most_told:
        c = head_code(F.col("head"))
        counts = marked.groupBy(c.alias("c")).agg(F.approx_count_distinct("head").alias("n")).collect()
        last = _told([(r["n"], r["n"]) for r in counts], most_told)
        codes = tuple(sorted(r["c"] for r in counts if r["n"] > last))
        # sizes by powers of two: a few dozen, whatever the number of forms
        level = F.floor(F.log2("n")).cast("int")
        last = _told([(r["level"], r["n"]) for r in counted.groupBy(level.alias("level")).agg(F.sum("n").alias("n")).collect()], most_told)
        forms = counted.where(level > last).select("f")
        few = counted.where(level <= last).select("f")
        # not more forms than keys that are told one by one
        whole = table.join(few, "f", "left_semi")

    def words(a: int, values: DataFrame, name: str) -> DataFrame:
        at = values.select(_bit(F.xxhash64(name), bits).alias("at"))
        return at.groupBy(F.lit(a).alias("a"), F.shiftright("at", 6).alias("word")).agg(F.bit_or(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))

    heads = marked.where(~head_code(F.col("head")).isin(*codes)) if codes else marked
    made = words(0, heads, "head").unionByName(words(1, whole, "key"))
    made = made.unionByName(words(2, forms, "f")) if forms is not None else made
    arrays = [[0] * (bits >> 6) for _ in "hkf"] if forms is not None else [[0] * (bits >> 6), [0] * (bits >> 6), []]
    for r in made.collect():
        arrays[r["a"]][r["word"]] = r["w"]
    row = keys.sparkSession.createDataFrame(pa.table({
        name: pa.array([array], pa.list_(pa.int64())) for name, array in zip(("_heads", "_keys", "_forms"), arrays)}))
    return Dictionary(style, table.select("key", "pii_type"), tuple(sorted(lengths)), bits, row, codes, forms is not None)


# Units of a text are counted in characters by blocks of so many.
_BLOCK = 256


def candidates(df: DataFrame, text_col: str, ids: list[str], known: Dictionary, with_context: bool = True) -> DataFrame:
    """(ids, key, value, start, end, preceding, context): the stretches that may be keys; without snippets no context.

    What can be done once for a text stands in columns; its units, and the stretches that begin at one, are then rows, so
    that the tests run in compiled code.  The arrays are scalar subqueries: a constant of a task, part of no row."""
    style, text, u = known.style, F.col("_text"), F.col("_u")
    # lower case of ASCII is lower case of each unit, and leaves the units as they are: only other texts get a second list
    even = (F.length(text) == F.octet_length(text)) & ~text.rlike(rf"[\x09-\x0D]|\x20\x20")
    given = df.select(*ids, F.col(text_col).alias("_text")).select(
        *ids, units(text).alias("_u"), *([] if style.exact else [even.alias("_even")]))
    normal = [] if style.exact else ["_even", F.when(~F.col("_even"), F.transform("_u", style.normal)).alias("_k")]
    own = u if style.exact else F.when(F.col("_even"), u).otherwise(F.transform("_u", style.normal))
    shapes = [F.transform(own, form).alias("_f")] if known.has_forms else []
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(u) - 1) / _BLOCK).cast("int")), lambda b: F.length(
        F.array_join(F.slice(u, b * _BLOCK + 1, _BLOCK), "")))
    ends = F.when(F.size(u) > _BLOCK, running_sums(blocks)).alias("_ends")
    given = given.select(*ids, "_u", ends, *normal, *shapes)

    def normalised(as_written: Column, other: Callable[[Column], Column]) -> Column:
        return as_written if style.exact else F.when(F.col("_even"), F.lower(as_written)).otherwise(other(F.col("_k")))

    heads, keys, forms = (known.arrays.select(a).scalar() for a in ("_heads", "_keys", "_forms"))
    i = F.col("_i")
    carried = [*ids, "_u", "_ends"]
    at = given.select("*", F.posexplode_outer("_u").alias("_i", "_unit")).where(F.col("_unit").isNotNull())
    unit = normalised(F.col("_unit"), lambda k: F.get(k, i))
    listed = _has(heads, F.xxhash64(unit), known.bits)
    at = at.where(head_code(unit).isin(*known.head_codes) | listed if known.head_codes else listed)

    n = F.col("_n")
    lengths = F.array(*map(F.lit, known.lengths)) if known.lengths else F.array().cast("array<int>")
    each = at.select(*at.columns, F.explode_outer(lengths).alias("_n")).where(n.isNotNull() & (i + n <= F.size("_u")))

    def stretch(us: Column) -> Column:
        return F.array_join(F.slice(us, i + 1, n), "")

    # in a generator, so that they are made once
    keyed = [normalised(stretch(u), stretch).alias("key"), *[stretch(F.col("_f")).alias("form")] * known.has_forms]
    each = each.select(*carried, "_i", "_n", F.explode_outer(F.array(F.struct(*keyed))).alias("_s"))
    can_be = _has(keys, F.xxhash64("_s.key"), known.bits)
    if known.has_forms:
        can_be = can_be | _has(forms, F.xxhash64("_s.form"), known.bits)
    found = each.where(can_be).where(_free(u, i, n, style))
    # characters before the unit i: of whole blocks of units, and of those in its block
    whole = F.floor(i / _BLOCK).cast("int")
    start = F.coalesce(F.get("_ends", whole - 1), F.lit(0)) + F.length(F.array_join(F.slice(u, whole * _BLOCK + 1, i % _BLOCK), ""))

    # a unit is a character or more, so that many units are enough for so many characters around
    def joined(first: Column, count: Column | int) -> Column:
        return F.array_join(F.slice(u, first, count), "")

    def ahead(chars: int) -> Column:
        return F.right(joined(F.greatest(i - chars, F.lit(0)) + 1, F.least(i, F.lit(chars))), F.lit(chars))

    found = found.select(
        *ids, F.col("_s.key").alias("key"), joined(i + 1, n).alias("value"), start.cast("int").alias("start"),
        ahead(10).alias("preceding"), ahead(AROUND).alias("_before"), F.substring(joined(i + n + 1, AROUND), 1, AROUND).alias("_behind"))
    context = F.concat(F.lit("..."), "_before", F.lit("["), "value", F.lit("]"), "_behind", F.lit("...")).alias("context")
    return found.select(*ids, "key", "value", "start", (F.col("start") + F.length("value")).alias("end"), "preceding",
                        *[context] * with_context)


def _free(u: Column, i: Column, n: Column, style: Style) -> Column:
    """Nothing that belongs to a word goes on before or behind the units i to i + n - 1."""
    before, behind = F.get(u, i - 1), F.get(u, i + n)
    word = lambda x: F.coalesce(x.rlike(WORD), F.lit(False))
    # beside a word there is none: runs are whole
    out = ~(word(before) & ~word(F.get(u, i))) & ~(word(behind) & ~word(F.get(u, i + n - 1)))
    if not style.exact:
        joined = lambda x, y: F.coalesce(x.isin(*JOINERS), F.lit(False)) & word(y)
        out = out & ~joined(before, F.get(u, i - 2)) & ~joined(behind, F.get(u, i + n + 1))
    return out


def matches(df: DataFrame, text_col: str, ids: list[str], known: Dictionary, score: float = 0.85,
            detector: str = "dictionary", ord_: int = 1_000_000, with_context: bool = True) -> DataFrame:
    """Findings, and ``preceding``, the ten characters before each: leftmost, then longest, disjoint in a text.  A key
    of several types counts as the first of them."""
    found = verified(candidates(df, text_col, ids, known, with_context), known).select(
        *ids, "pii_type", "value", "start", "end", F.lit(score).alias("confidence"), *["context"] * with_context,
        F.lit(detector).alias("detector"), F.lit("known_" + known.style.name).alias("shape"), F.lit(ord_).alias("ord"), "preceding")
    return folds.folded(found, ids, folds.first, ("start", "-end", "pii_type"))


def verified(found: DataFrame, known: Dictionary) -> DataFrame:
    """Candidates that are keys, with the type of the key.

    A table of a size that is broadcast is joined as it is.  Of a larger one only the keys that some candidate has are
    looked up: where these are few, they are broadcast and the table is read past them, without a shuffle of it."""
    typed = known.table.groupBy("key").agg(F.min("pii_type").alias("pii_type"))
    if known.has_forms or measured_bytes(typed) > BROADCAST_BYTES:
        found = staged(found, "candidates")
        asked = staged(found.select("key").distinct(), "asked")
        if measured_bytes(asked) <= BROADCAST_BYTES:
            asked = F.broadcast(asked)
        typed = known.table.join(asked, "key", "left_semi").groupBy("key").agg(F.min("pii_type").alias("pii_type"))
    return lookup(found, staged(typed, "known"), ["key"], "inner")
