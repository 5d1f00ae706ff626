"""Call-centre style notes derived from ``orders``: one note per order, made of its keys and dates.

The expression is valid in Spark and DuckDB and gives the same text in both, so every shape of the
entity table can be looked for at the size of the table.
"""

from __future__ import annotations

import re


def _pad(col: str, n: int, fill: str = "0") -> str:
    return f"lpad(cast({col} as string), {n}, '{fill}')"


O9, O8, O7, O6, O5 = (_pad("o_orderkey", n) for n in (9, 8, 7, 6, 5))
C3, C4 = _pad("(o_custkey % 1000)", 3), _pad("(o_custkey % 10000)", 4)
O2, O3, O4 = _pad("(o_orderkey % 100)", 2), _pad("(o_orderkey % 1000)", 3), _pad("(o_orderkey % 10000)", 4)
C2 = _pad("(o_custkey % 100)", 2)
DAY, MONTH = _pad("day(o_orderdate)", 2), _pad("month(o_orderdate)", 2)
YEAR = "cast(year(o_orderdate) as string)"

WHO = """CASE o_custkey % 5 WHEN 0 THEN 'MR JOHN O''BRIEN' WHEN 1 THEN 'Ms Jane Smith' WHEN 2 THEN 'DR SMITH-JONES'
 WHEN 3 THEN 'Miss UPLOAD SPEED' ELSE 'Telstra Sydney' END"""

VARIANTS = {
    0: f"concat('call (02) ', {C4}, ' ', {O4}, ' or +61 2 ', {C4}, '-', {O4}, ' or +61 4', {O2}, ' ', {C3}, ' ', {O3})",
    1: f"concat('hotline 1300 ', {C3}, ' ', {O3}, ', 1800-', {O3}, '-', {C3}, ', 13 ', {O2}, ' ', {C2}, ', partial 04', {O2}, ' ', {C2}, ' ', {O3})",
    2: f"concat('lives at ', cast(o_custkey % 500 + 1 as string), ' Smith Street, Sydney NSW 2', {O3}, ' before at 7 King Avenue Brisbane')",
    3: f"concat('P.O. Box ', cast(o_custkey as string), ', GPO Box ', cast(o_orderkey % 1000 as string), ', Melbourne VIC 3', {C3}, ', Locked Bag ', {C3}, ', Private Bag ', {O2}, ' RMB ', {O3})",
    4: f"concat('IMEI: ', {_pad('o_orderkey', 15, '3')}, ' handset 35', {O6}, {C3}, '000', '12 and 35-', {O6}, '-', {_pad('o_custkey', 6)}, '-7')",
    5: f"concat('SIM card: 8961', {_pad('o_orderkey', 15)}, ' other 8964', {_pad('o_custkey', 16)})",
    6: f"concat('NTD-AB', {O8}, ' NOKA', {O9}, ' ALCL', {O9}, ' 2M', {O9}, ' nbn device: 3M', {O9})",
    7: f"concat('license vic ', {O9}, ', DL: ', {O8}, ', nsw licence ', {C4}, {O4}, ', S', {O5}, ', v', {O8}, ', driver licence no ', {O7})",
    8: f"concat('passport no PA', {O7}, ', N', {O7}, ' and xy', {C3}, {O4}, ' travel document E', {O7})",
    9: f"concat('centrelink CRN ', {O9}, 'A, pension card ', {C4}, '12345B, ref ', {O9}, 'c')",
    10: f"concat('TFN ', {O3}, ' ', {C3}, ' ', {O3}, ' tfn ', {O9}, ' medicare 2', {O3}, ' ', {O5}, ' ', cast(o_custkey % 10 as string), ' or 3', {O9})",
    11: f"concat('ABN 51 ', {O3}, ' ', {C3}, ' ', {O3}, ', abn 12', {O9}, ', ACN ', {C3}, '-', {O3}, '-', {C3})",
    12: f"concat('ssn ', {C3}, '-', {O2}, '-', {O4}, ' itin 9', {O2}, '-7', cast(o_custkey % 10 as string), '-', {C4}, ' bank account ', {O8}, '77 us passport ', {O9}, ' or C', {O8}, ' card 4', {O3}, '-', {C4}, '-', {O4}, '-1234')",
    13: f"concat('ip 10.', cast(o_custkey % 256 as string), '.', cast(o_orderkey % 300 as string), '.7 and fe80:0:0:0:', {C4}, ':', {O4}, ':1:2 or 2001:db8::', {O3}, ' see https://shop.example.com/o/', cast(o_orderkey as string))",
    14: f"concat('nhs ', {C3}, ' ', {O3}, ' ', {O4}, ' nric S', {O7}, 'D iban GB', {O2}, ' WEST ', {C4}, ' ', {O4}, ' ', {C4}, ' 32 wallet 1BoatSLRHtKNngkdXEeobR76b53L', {_pad('(o_orderkey % 1000)', 3, '1')}, 'tp')",
    15: f"concat('born ', {DAY}, ' March ', {YEAR}, ', met ', {YEAR}, '-', {MONTH}, '-', {DAY}, ', birthday ', {DAY}, '-', {MONTH}, '-', {YEAR}, ', seen 3rd May ', {YEAR}, ' call (', {C3}, ') ', {O3}, '-', {C4}, ', 555-', {O3}, '-', {C4}, ', +44 20 ', {C4}, ' ', {O4})",
}

TEXT = (
    f"concat('Called ', {WHO}, ' on 04', {C2}, ' ', {O3}, ' ', {C3}, ' AVC', {_pad('o_orderkey', 12)}, ' LOC', {_pad('o_custkey', 12)}, "
    f"' DOB: ', {DAY}, '/', {MONTH}, '/', {YEAR}, ' PO Box ', cast(o_custkey as string), ' mail cust', cast(o_custkey as string), "
    "case when o_custkey % 3 = 0 then '@example.com' else '@corp.test' end, ' CVC-', " + O7 + ", ' POI-3SYD', " + O2 + ", ' SC', " + C2 + ", '; ', "
    + "case o_orderkey % 16 " + " ".join(f"when {k} then {v}" for k, v in VARIANTS.items()) + " end)"
)



def _line(template: str) -> str:
    """A concatenation from text with the names of the expressions above in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(globals()[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts)) + ")"


# Cards beside other digits: an expiry date, a code, a number before, two cards in a run, numbers of another kind.
_CARD_LINES = [
    "paid by card 4{O3} {C4} {O4} {C4} {O2}/27 code {C3}",
    "{C2} 5{O3}-{C4}-{O4}-1111 {C3} done",
    "4{C3} {O4} {C4} 1111 5{O3} {C4} {O4} 2222",
    "2 4111 {C4} {O4} {C4} 9",
    "visa 4{C3}{O9}{O3} {O3}, 3{C3} {O6} {O5} 12",
    "ref 12-4{C3}-{C4}-{O4}-{C4}-9, account 123-{O6}-{O4}-7",
    "6011{O4}{C4}{O4}{C3} or 4{O3} {O3} {C3} {O4} {C2} {O2}",
]
CARD_LINE = (f"case o_orderkey % {len(_CARD_LINES)} " + " ".join(f"when {k} then {_line(v)}" for k, v in enumerate(_CARD_LINES)) + " end")
CARD_LINES = f"SELECT o_orderkey AS id, {CARD_LINE} AS text FROM orders"

NOTES = f"SELECT o_orderkey AS id, {TEXT} AS text FROM orders"
DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
PAGES = "SELECT page_id AS id, html AS text FROM pages"

# A note with names of the tables in it: its customer, the customer's nation and region, and a part.
_PART = ("CASE o_orderkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', concat(chr(10), ' ')) "
         "ELSE concat('x-', p_name) END")
LETTER = (f"concat({TEXT}, ' for ', c_name, CASE WHEN o_orderkey % 3 = 0 THEN ', Dr ' ELSE ' of ' END, r_name, ' (', n_name, '): ', "
          f"{_PART}, CASE WHEN o_orderkey % 5 = 0 THEN '-like ' ELSE '. ' END, lower(r_name), ' ', p_name, ' ', p_name)")
_FROM = """orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = o_custkey"""
LETTERS = f"SELECT o_orderkey AS id, {LETTER} AS text FROM {_FROM}"
#: Names of several words and their types.
GAZETTEER = """SELECT c_name AS key, 'PERSON' AS pii_type FROM customer UNION ALL SELECT n_name, 'LOCATION' FROM nation
UNION ALL SELECT r_name, 'LOCATION' FROM region UNION ALL SELECT p_name, 'ORGANIZATION' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT concat(r_name, ' ', p_name), 'ORGANIZATION' FROM part JOIN region ON r_regionkey = p_partkey % 5"""
