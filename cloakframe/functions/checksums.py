"""Public check-digit rules as Column expressions over a matched value.

Each returns true (certain), false (not this kind of number).  Weights are fixed values published by
the issuing bodies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.text import let

# Fixed values.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(digits: Column, i: int) -> Column:
    return F.substring(digits, i + 1, 1).try_cast("int")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digit times weight over the first ``len(weights)`` digits; null if there are fewer."""
    numbers = F.expr(f"array{weights}")
    products = F.zip_with(F.split(F.substring(digits, 1, len(weights)), ""), numbers, lambda d, w: d.try_cast("int") * w)
    return F.aggregate(products, F.lit(0), lambda a, p: a + p)


def luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        n = F.length(digits)
        chars = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
        doubled = F.transform(
            chars,
            lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
        )
        return (n.between(13, 19)) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)

    return let(only_digits(value), lambda d: F.when(d == "", F.lit(False)).otherwise(total(d)))


def card(value: Column) -> Column:
    """Luhn, without bare 13-digit numbers that start with 1 (millisecond timestamps)."""
    return luhn(value) & ~value.rlike("^1[0-9]{12}$")


def ssn(value: Column) -> Column:
    def valid(d: Column) -> Column:
        area = F.substring(d, 1, 3)
        return (
            (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900")
            & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
        )

    return let(only_digits(value), valid)


def tfn(value: Column) -> Column:
    return let(only_digits(value), lambda d: (F.length(d) == 9) & (_weighted(d, TFN_WEIGHTS) % 11 == 0))


def medicare(value: Column) -> Column:
    return let(
        only_digits(value),
        lambda d: (F.length(d) == 10) & F.substring(d, 1, 1).between("2", "6")
        & (_weighted(d, MEDICARE_WEIGHTS) % 10 == _digit(d, 8)),
    )


def abn(value: Column) -> Column:
    return let(
        only_digits(value),
        lambda d: (F.length(d) == 11) & ((_weighted(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0),
    )


def acn(value: Column) -> Column:
    return let(
        only_digits(value),
        lambda d: (F.length(d) == 9) & ((10 - _weighted(d, ACN_WEIGHTS) % 10) % 10 == _digit(d, 8)),
    )


def nhs(value: Column) -> Column:
    return let(
        only_digits(value),
        lambda d: (F.length(d) == 10) & ((11 - _weighted(d, NHS_WEIGHTS) % 11) % 11 == _digit(d, 9)),
    )


def iban(value: Column) -> Column:
    """Moves the first four characters to the end, reads letters as 10..35 and takes mod 97."""

    def remainder(v: Column) -> Column:
        turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        values = F.transform(
            F.split(turned, ""),
            lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55),
        )
        return F.aggregate(
            values, F.lit(0), lambda a, d: F.when(d > 9, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97)
        )

    return let(F.upper(F.regexp_replace(value, " ", "")), lambda v: remainder(v) == 1)


def email_tld(value: Column) -> Column:
    """The last dotted part of the domain is at least two letters."""
    domain = F.element_at(F.split(value, "@"), -1)
    return F.contains(domain, F.lit(".")) & domain.rlike(r"\.\p{L}{2,}$")


CHECKS = {
    "card": card, "ssn": ssn, "tfn": tfn, "medicare": medicare, "abn": abn, "acn": acn, "nhs": nhs, "iban": iban,
}
