"""Finding -> replacement text, as Column expressions over (pii_type, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.checksums import only_digits
from cloakframe.functions.text import let
from cloakframe.policy import Hash, Mask, Policy, Redact, Replace

Rewriter = Callable[[Column, Column], Column]

# ---- redact ----------------------------------------------------------------------------------


def redact(pii_type: Column, value: Column, o: Redact = Redact()) -> Column:
    return F.concat(F.lit("["), pii_type, F.lit("_REDACTED]")) if o.type_specific else F.lit(o.token)


# ---- mask ------------------------------------------------------------------------------------
# Both the short and the long name of a type are masked alike.
EMAIL_TYPES = ("EMAIL", "EMAIL_ADDRESS")
PHONE_TYPES = ("PHONE", "PHONE_NUMBER")
SSN_TYPES = ("SSN", "US_SSN")
CARD_TYPES = ("CREDIT_CARD", "CREDIT_CARD_NUMBER")
IP_TYPES = ("IP_ADDRESS", "IP")
NAME_TYPES = ("NAME", "PERSON")
PLACE_TYPES = ("ADDRESS", "LOCATION", "AU_ADDRESS")


def _times(char: str, n: Column) -> Column:
    return F.repeat(F.lit(char), n.cast("int"))


def mask_generic(value: Column, o: Mask = Mask()) -> Column:
    return F.when(F.length(value) <= 1, F.lit(o.mask_char)).otherwise(
        F.concat(F.substring(value, 1, 1), _times(o.mask_char, F.length(value) - 1)))


def mask_email(value: Column, o: Mask = Mask()) -> Column:
    at = F.locate("@", value)
    local = F.substring(value, F.lit(1), at - 1)
    n = o.email_visible_chars
    return F.when(at == 0, mask_generic(value, o)).otherwise(F.concat(
        F.substring(local, 1, n), _times(o.mask_char, F.greatest(F.length(local) - n, F.lit(1))),
        F.substring(value, at, F.length(value))))


def mask_phone(value: Column, o: Mask = Mask()) -> Column:
    c, n = o.mask_char, o.phone_visible_chars

    def shaped(digits: Column) -> Column:
        shown = F.substring(digits, 1, n)
        return (
            F.when(F.length(digits) < n, _times(c, F.length(value)))
            .when(F.contains(value, F.lit("(")), F.concat(F.lit("("), shown, F.lit(f") {c * 3}-{c * 4}")))
            .when(F.contains(value, F.lit("-")), F.concat(shown, F.lit(f"-{c * 3}-{c * 4}")))
            .when(F.contains(value, F.lit(".")), F.concat(shown, F.lit(f".{c * 3}.{c * 4}")))
            .otherwise(F.concat(shown, _times(c, F.length(digits) - n)))
        )

    return let(only_digits(value), shaped)


def _tail(digits: Column, n: int) -> Column:
    """The last ``n`` characters; none for zero, so a mask of everything shows nothing."""
    return F.lit("") if n <= 0 else F.right(digits, F.lit(n))


def mask_ssn(value: Column, o: Mask = Mask()) -> Column:
    c, n = o.mask_char, o.ssn_visible_chars

    def shaped(digits: Column) -> Column:
        return (
            F.when(F.length(digits) != 9, mask_generic(value, o))
            .when(F.contains(value, F.lit("-")), F.concat(F.lit(f"{c * 3}-{c * 2}-"), _tail(digits, n)))
            .when(F.contains(value, F.lit(" ")), F.concat(F.lit(f"{c * 3} {c * 2} "), _tail(digits, n)))
            .otherwise(F.concat(F.lit(c * max(9 - n, 0)), _tail(digits, n)))
        )

    return let(only_digits(value), shaped)


def mask_credit_card(value: Column, o: Mask = Mask()) -> Column:
    c, n = o.mask_char, o.credit_card_visible_chars

    def shaped(digits: Column) -> Column:
        return (
            F.when(F.length(digits) < 13, mask_generic(value, o))
            .when(F.contains(value, F.lit("-")), F.concat(F.lit(f"{c * 4}-" * 3), _tail(digits, n)))
            .when(F.contains(value, F.lit(" ")), F.concat(F.lit(f"{c * 4} " * 3), _tail(digits, n)))
            .otherwise(F.concat(_times(c, F.length(digits) - n), _tail(digits, n)))
        )

    return let(only_digits(value), shaped)


def mask_ip(value: Column, o: Mask = Mask()) -> Column:
    c = o.mask_char

    def v6(parts: Column) -> Column:
        middle = F.array_repeat(F.lit(c * 4), F.size(parts) - 4)
        return F.when(F.size(parts) > 4, F.array_join(
            F.concat(F.slice(parts, 1, 2), middle, F.slice(parts, F.size(parts) - 1, F.lit(2))), ":"))

    def v4(parts: Column) -> Column:
        return F.when(F.size(parts) == 4, F.concat_ws(
            ".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.lit(c * 3), F.lit(c * 3)))

    shaped = F.when(F.contains(value, F.lit(":")), let(F.split(value, ":", -1), v6)).otherwise(
        let(F.split(value, r"\.", -1), v4))
    return F.coalesce(shaped, mask_generic(value, o))


def mask(pii_type: Column, value: Column, o: Mask = Mask()) -> Column:
    return (
        F.when(pii_type.isin(*EMAIL_TYPES), mask_email(value, o))
        .when(pii_type.isin(*PHONE_TYPES, *["AU_PHONE_NUMBER"] * o.au_phones), mask_phone(value, o))
        .when(pii_type.isin(*SSN_TYPES), mask_ssn(value, o))
        .when(pii_type.isin(*CARD_TYPES), mask_credit_card(value, o))
        .when(pii_type.isin(*IP_TYPES), mask_ip(value, o))
        .otherwise(mask_generic(value, o))
    )


# ---- hash ------------------------------------------------------------------------------------

def hash_token(pii_type: Column, value: Column, o: Hash = Hash()) -> Column:
    salted = F.concat(F.lit(o.salt), value)
    digest = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[o.algorithm](salted)
    if o.truncate:
        digest = F.substring(digest, 1, o.truncate)
    return F.concat(pii_type, F.lit("_"), digest) if o.prefix else digest


# ---- replace ---------------------------------------------------------------------------------
# A replacement is a function of (type, value, secret seed) alone: every task, batch and run agrees on it without
# sharing state, and distinct values get distinct replacements.  Numbers are permuted: digits of a value of n digits by
# a keyed Feistel network on n digits, so the form stays and no two meet; addresses of IP version 4 on 32 bits.  Names,
# places and words are made of syllables that spell 64 bits of a keyed digest.

ROUNDS = 8
#: So many digits fit into two halves of a 64-bit number; a longer number becomes a word.
MOST_DIGITS = 36
CONSONANTS = "bdfghjklmnprstvz"
VOWELS = ("a", "e", "i", "o", "u", "ai", "au", "ea", "ei", "eu", "ia", "ie", "io", "oa", "oi", "ui")
_NUMBER = r"^[-0-9 ()+./]*[0-9][-0-9 ()+./]*$"
_OCTET = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def keyed(seed: str, *parts: Column) -> Column:
    """Hex digest that nobody can make without the seed."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)


def permuted(a: Column, b: Column, most_a: Column, most_b: Column, key: Callable[[Column, Column], Column]) -> Column:
    """struct(a, b), a permutation of the pairs of numbers below ``most_a`` and ``most_b``; ``key`` makes a hex digest
    of the round and a number."""
    def step(s: Column, i: Column) -> Column:
        most = F.when(i % 2 == 0, most_a).otherwise(most_b)
        f = F.conv(F.substring(key(i, s["b"]), 1, 15), 16, 10).cast("bigint")
        return F.struct(s["b"].alias("a"), ((s["a"] + f) % most).alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, pii_type: Column, seed: str) -> Column:
    """As many digits; a permutation of the strings of that length."""
    def power(n: Column) -> Column:
        return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")

    def number(s: Column) -> Column:
        return F.concat(F.lit("0"), s).cast("bigint")

    def of(n: Column) -> Column:
        u = F.floor(n / 2).cast("int")
        halves = permuted(number(F.substring(digits, F.lit(1), u)), number(F.substring(digits, u + 1, n - u)), power(u), power(n - u),
                          lambda i, b: keyed(seed, pii_type, n, i, b))
        return let(halves, lambda h: F.concat(
            F.when(u > 0, F.lpad(h["a"].cast("string"), u, F.lit("0"))).otherwise(""), F.lpad(h["b"].cast("string"), n - u, F.lit("0"))))

    return let(F.length(digits), of)


def _in_place(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one by one."""
    gaps = F.split(value, "[0-9]", -1)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)))
    return F.array_join(F.zip_with(gaps, each, lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _luhn_digit(digits: Column) -> Column:
    """The check digit that follows ``digits``, as a number."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return (10 - F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10) % 10


def _card_digits(digits: Column, pii_type: Column, seed: str) -> Column:
    """A permutation that keeps a right check digit right, and a wrong one as wrong as it was."""
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    off = F.right(digits, F.lit(1)).cast("int") - _luhn_digit(head)
    return let(permuted_digits(head, pii_type, seed), lambda h: F.concat(
        h, F.pmod(_luhn_digit(h) + off, F.lit(10)).cast("string")))


def _ipv4(value: Column, pii_type: Column, seed: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    both = let(o, lambda x: permuted(F.get(x, F.lit(0)) * 256 + F.get(x, F.lit(1)), F.get(x, F.lit(2)) * 256 + F.get(x, F.lit(3)),
                                     F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"),
                                     lambda i, b: keyed(seed, pii_type, F.lit("v4"), i, b)))
    return let(both, lambda h: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(h["a"] / 256), h["a"] % 256, F.floor(h["b"] / 256), h["b"] % 256)]))


def syllables(digest: Column, at: int, n: int) -> Column:
    """``n`` syllables that spell the hex digits of the digest from ``at``, two each: a consonant and a vowel."""
    def code(place: Column) -> Column:
        return F.conv(F.substring(digest, place, F.lit(1)), 16, 10).cast("int")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(
        F.substring(F.lit(CONSONANTS), code(k * 2 + at) + 1, F.lit(1)),
        F.get(F.array(*[F.lit(v) for v in VOWELS]), code(k * 2 + at + 1)))), "")


def replace_pseudonym(pii_type: Column, value: Column, o: Replace = Replace()) -> Column:
    if not o.available:
        return F.concat(F.lit("["), pii_type, F.lit("_FAKE]"))
    if not o.seed:
        raise ValueError("replacement needs a secret seed: Replace(seed=...)")

    def made(h: Column, digits: Column) -> Column:
        first, last = syllables(h, 1, 3), syllables(h, 7, 5)
        domain = F.lit("example.org")
        if o.preserve_format:
            domain = F.coalesce(F.get(F.split(value, "@", -1), F.lit(1)), domain)
        n = F.length(digits)
        return (
            F.when(pii_type.isin(*EMAIL_TYPES), F.concat(first, F.lit("."), last, F.lit("@"), domain))
            .when(pii_type.isin(*NAME_TYPES), F.initcap(F.concat_ws(" ", first, last)))
            .when(pii_type.isin(*PLACE_TYPES), F.initcap(syllables(h, 1, 8)))
            .when(pii_type.isin(*IP_TYPES) & value.rlike(_IPV4), _ipv4(value, pii_type, o.seed))
            .when(pii_type.isin(*IP_TYPES) & F.contains(value, F.lit(":")),
                  F.concat_ws(":", *[F.substring(h, 1 + 4 * i, 4) for i in range(8)]))
            .when(pii_type.isin(*CARD_TYPES) & n.between(13, 19) & value.rlike(_NUMBER), _in_place(value, _card_digits(digits, pii_type, o.seed)))
            .when(value.rlike(_NUMBER) & (n <= MOST_DIGITS), _in_place(value, permuted_digits(digits, pii_type, o.seed)))
            .otherwise(syllables(h, 1, 8))
        )

    both = F.struct(keyed(o.seed, pii_type, value).alias("h"), only_digits(value).alias("d"))
    return let(both, lambda x: made(x["h"], x["d"]))


# ---- dispatch --------------------------------------------------------------------------------

_EXTRA: dict[str, Rewriter] = {}


def register_strategy(name: str, rewriter: Rewriter) -> None:
    """Adds a strategy: a function from the type and value columns to the replacement column."""
    _EXTRA[name] = rewriter


def is_own(policy: Policy) -> bool:
    """Whether the strategy was added by the caller, who may have no replacement for some value."""
    return policy.strategy in _EXTRA


def strategy_name(policy: Policy) -> str:
    """The strategy that is used: an unknown one means redaction."""
    known = {"redact", "mask", "replace", "hash", *_EXTRA}
    return policy.strategy if policy.strategy in known else "redact"


def rewriter(policy: Policy) -> Rewriter:
    name = strategy_name(policy)
    if name != policy.strategy:
        import warnings

        warnings.warn(f"unknown strategy {policy.strategy!r}, using redact", stacklevel=2)
    if name == "hash" and policy.hash.salt == Hash.salt:
        import warnings

        warnings.warn("the default salt is published: set Hash(salt=...)", stacklevel=2)
    built_in = {
        "redact": lambda t, v: redact(t, v, policy.redact),
        "mask": lambda t, v: mask(t, v, policy.mask),
        "hash": lambda t, v: hash_token(t, v, policy.hash),
        "replace": lambda t, v: replace_pseudonym(t, v, policy.replace_with),
    }
    return _EXTRA.get(name) or built_in[name]
