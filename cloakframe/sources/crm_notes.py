"""Synthetic call-centre notes with known spans: one per input row, the same id giving the same note on any
number of executors.

A note is a chain of clauses.  Each clause draws one entity type, one way to introduce it and one valid value of
it; the value's place is part of the output, so what a detector ought to find is known.  All draws come from hashes
of the row's id, in SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

CLAUSES = 5
_DIGITS = 31


def _with_check(stem: str, check: Callable[[list[int]], int | None]) -> str | None:
    d = check([int(c) for c in stem])
    return None if d is None else f"{stem}{d}"


def _luhn(d: list[int]) -> int:
    doubled = [x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))]
    return -sum(doubled) % 10


def _weighted(weights: tuple[int, ...], modulus: int) -> Callable[[list[int]], int | None]:
    def check(d: list[int]) -> int | None:
        r = sum(w * x for w, x in zip(weights, d)) % modulus
        return r if r < 10 else None

    return check


def _grown(stems: list[str], make: Callable[[str], str | None], n: int = 8) -> list[str]:
    return [v for v in map(make, stems) if v][:n]


def _stems(length: int, lead: str = "") -> list[str]:
    """Digit strings of one length from a fixed linear rule."""
    out, x = [], 20_240_229 + length
    for _ in range(24):
        s = ""
        while len(s) < length - len(lead):
            x = (x * 1_103_515_245 + 12_345) % (1 << 31)
            s += str(x % 1_000_000).zfill(6)
        out.append(lead + s[:length - len(lead)])
    return out


def _groups(value: str, *sizes: int, by: str = " ") -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(value[at:at + n])
        at += n
    return by.join([*parts, value[at:]] if at < len(value) else parts)


class _Draw:
    """SQL of the draws of one clause from its digit stream."""

    def __init__(self, stream: str) -> None:
        self.stream, self.at = stream, 1

    def digits(self, n: int) -> str:
        if self.at + n > _DIGITS:
            self.at = 3
        out = f"substr({self.stream}, {self.at}, {n})"
        self.at += n
        return out

    def below(self, n: int) -> str:
        return f"(cast({self.digits(4)} as int) % {n})"

    def one(self, options: list[str]) -> str:
        cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
        return options[0] if len(options) == 1 else f"CASE {self.below(len(options))} {cases} END"

    def listed(self, values: list[str]) -> str:
        return self.one([_quoted(v) for v in values])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _two(number: str) -> str:
    return f"lpad(cast({number} as string), 2, '0')"


_TOWNS = ["Ballarat VIC 3350", "Dubbo NSW 2830", "Cairns QLD 4870", "Whyalla SA 5600", "Albany WA 6330"]
_ROADS = ["Quarry Road", "Lantern Street", "Heron Lane", "Orchard Avenue", "Signal Drive"]


def _entities() -> list[tuple[str, list[str], Callable[[_Draw], str]]]:
    """(entity type, introductions, maker of a valid value)."""
    tfn = _grown(_stems(8), lambda s: _with_check(s, _weighted((1, 4, 3, 7, 5, 8, 6, 9), 11)))
    care = _grown(_stems(8, "4"), lambda s: (v := _with_check(s, _weighted((1, 3, 7, 9, 1, 3, 7, 9), 10))) and v + "2")
    cards = _grown(_stems(15, "47"), lambda s: _with_check(s, _luhn)) + _grown(
        _stems(15, "2345"), lambda s: _with_check(s, _luhn))
    imei = _grown(_stems(14, "35"), lambda s: _with_check(s, _luhn))
    return [
        ("AU_PHONE_NUMBER", ["rings back from", "left the number", "prefers a text to"], lambda d: d.one([
            _cat("'04'", d.digits(2), "' '", d.digits(3), "' '", d.digits(3)), _cat("'04'", d.digits(8)),
            _cat("'(07) '", d.digits(4), "' '", d.digits(4))])),
        ("EMAIL_ADDRESS", ["writes as", "copies in", "wants it sent to"], lambda d: _cat(
            d.listed(["quill", "marsh.lark", "o-reed", "tansy_fen"]), d.digits(3), "'@'",
            d.listed(["parcel.test", "harbour.test", "kiln.test"]))),
        ("DATE_OF_BIRTH", ["gives a birthday, DOB:", "date of birth:"], lambda d: _cat(
            _two(f"1 + {d.below(28)}"), "'/'", _two(f"1 + {d.below(12)}"), "'/'", f"cast(1950 + {d.below(50)} as string)")),
        ("AU_ADDRESS", ["now lives at", "moved out of"], lambda d: _cat(
            f"cast(1 + {d.below(300)} as string)", "' '", d.listed(_ROADS), "', '", d.listed(_TOWNS))),
        ("AU_TFN", ["reads out the TFN", "tax file number"], lambda d: d.listed([_groups(v, 3, 3, 3) for v in tfn])),
        ("AU_MEDICARE", ["shows Medicare", "medicare card"], lambda d: d.listed([_groups(v, 4, 5, 1) for v in care])),
        ("CREDIT_CARD", ["pays by credit card", "card on file"], lambda d: d.listed(
            [_groups(v, 4, 4, 4, 4) for v in cards[:8]] + cards[8:])),
        ("IMEI", ["reads from the box IMEI:", "handset IMEI:"], lambda d: d.listed(imei)),
        ("AU_NBN_LOC_ID", ["premises is", "connection point"], lambda d: _cat("'LOC'", d.digits(12))),
        ("AU_NBN_SERVICE_ID", ["circuit shows", "service is"], lambda d: _cat("'AVC'", d.digits(12))),
        ("AU_CENTRELINK_CRN", ["holds a pension, CRN", "concession under CRN"], lambda d: _cat(
            d.digits(9), d.listed(["A", "H", "T"]))),
        ("AU_PO_BOX", ["collects mail at", "return it to"], lambda d: _cat("'PO Box '", d.digits(3))),
        ("IP_ADDRESS", ["modem answers on", "logged in from ip"], lambda d: _cat(
            "'10.'", f"cast({d.below(250)} as string)", "'.'", f"cast({d.below(250)} as string)", "'.7'")),
    ]


_JOINS = ["; ", ". ", ", then "]


def _levels() -> list[list[str]]:
    """Select lists from the innermost to the outermost."""
    streams = [f"translate(md5(concat('note ', cast(id as string), ' clause {i}')), 'abcdef', '314159') AS d{i}"
               for i in range(CLAUSES + 1)]
    kinds = _entities()
    kept = [f"d{i}" for i in range(CLAUSES + 1)]
    # clauses of a note draw from types a fixed stride apart, so that none comes twice
    pick = ["id", *kept, *(f"(cast(substr(d0, 1, 4) as int) + {i * 3}) % {len(kinds)} AS k{i}" for i in range(CLAUSES))]
    out = []
    for i in range(CLAUSES):
        leads, values, types = [], [], []
        for name, intros, make in kinds:
            draw = _Draw(f"d{i + 1}")
            leads.append(draw.listed(intros))
            values.append(make(draw))
            types.append(_quoted(name))
        for column, options in (("lead", leads), ("value", values), ("type", types)):
            cases = " ".join(f"WHEN {j} THEN {o}" for j, o in enumerate(options))
            out.append(f"CASE k{i} {cases} END AS {column}{i}")
    out += ["d0", "id"]
    pieces = ["'Note '", "substr(d0, 5, 3)", "': '"]
    for i in range(CLAUSES):
        join = "'.'" if i == CLAUSES - 1 else _quoted(_JOINS[i % len(_JOINS)])
        pieces += [f"lead{i}", "' '", f"value{i}", join]
    day = f"concat(cast(2021 + cast(substr(d0, 8, 2) as int) % 4 as string), '-', {_two('1 + cast(substr(d0, 10, 2) as int) % 12')}, '-', {_two('1 + cast(substr(d0, 12, 2) as int) % 28')})"
    last = [f"concat(cast(1 + cast(substr(d0, 14, 1) as int) % 9 as string), substr(d0, 15, 6)) AS CaseNumber",
            f"{day} AS CreatedDate", f"{_cat(*pieces)} AS CommentBody"]
    return [["id", *streams], pick, out, last]


def synth_crm_notes(ids: DataFrame, id_col: str) -> DataFrame:
    """(CaseNumber, CreatedDate, CommentBody), all strings, for every row of ``ids``."""
    out = ids.selectExpr(f"{id_col} AS id")
    for level in _levels():
        out = out.selectExpr(*level)
    return out


def known_values(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, CommentBody, pii_type, value): what each note holds, five rows for each of ``ids``."""
    *inner, last = _levels()
    out = ids.selectExpr(f"{id_col} AS id")
    for level in inner:
        out = out.selectExpr(*level)
    held = ", ".join(f"struct(type{i} AS pii_type, value{i} AS value)" for i in range(CLAUSES))
    return out.selectExpr("id", last[-1], f"inline(array({held}))")


def synth_sql(source: str, id_col: str) -> str:
    """The DuckDB statement of ``synth_crm_notes``."""
    out = f"(SELECT {id_col} AS id FROM {source})"
    for level in _levels():
        out = f"(SELECT {', '.join(level)} FROM {out})"
    return out[1:-1]
