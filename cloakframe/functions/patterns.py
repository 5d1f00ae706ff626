"""The entity table: which shapes are looked for, how sure each one is, and what a text must hold
before the regex is worth running.

``needs`` is a conjunction of groups; a text is only handed to the regex when every group has at
least one member present.  A member is a literal looked for in the lower-cased text (in the text as
written for case-sensitive shapes), or one of the digit classes below.  Every group is a *necessary* condition of the regex next to it (tests check
this), so the guard changes cost, never results.

    #1   any digit
    #6   six digits with at most four separators between neighbours
    #8   eight digits, same rule
    #13  thirteen digits with at most one space or dash between neighbours

A member that starts with ``|`` is looked for in the row's digit runs: ``12 March 1985, 0412 345`` has
the runs ``|2|4|4|3|``.  It fits shapes whose digits are whole runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column

DIGIT_CLASSES = {
    "#1": r"[0-9]",
    "#6": r"[0-9](?:[-\s.()]{0,4}[0-9]){5}",
    "#8": r"[0-9](?:[-\s.()]{0,4}[0-9]){7}",
    "#13": r"[0-9](?:[- ]?[0-9]){12}",
}


def runs(*groups: int | tuple[int, ...]) -> tuple[str, ...]:
    """Every sequence of digit runs that groups of these sizes can make when the separator between two
    groups may be missing: ``runs(4, 3)`` is ``|4|3|`` and ``|7|``."""
    made = set()
    for sizes in product(*[g if isinstance(g, tuple) else (g,) for g in groups]):
        for cuts in product((True, False), repeat=len(sizes) - 1):
            seq = [sizes[0]]
            for size, cut in zip(sizes[1:], cuts):
                if cut:
                    seq.append(size)
                else:
                    seq[-1] += size
            made.add("|" + "|".join(map(str, seq)) + "|")
    return tuple(sorted(made))


def one_run(*lengths: int) -> tuple[str, ...]:
    return tuple(f"|{n}|" for n in lengths)


#: The name of a rule of ``checksums``, or a caller's function from the value column to a boolean column.
Check = str | Callable[[Column], Column] | None


@dataclass(frozen=True)
class Shape:
    name: str
    regex: str
    score: float
    needs: tuple[tuple[str, ...], ...] = ()
    case_sensitive: bool = False
    # characters of a run that a match always takes whole
    run: str = ""
    # characters that a match begins with, one of them always
    lead: str = ""

    def anchored(self) -> str:
        """``flagged`` for the JVM: a match is only tried where a run begins or the last match ended, and at a character
        that it can begin with.  Leftmost matches begin there anyway; a long run without a match is then not tried again
        at each of its characters, and a test of one character is cheaper than one for a word boundary."""
        flags = self.flagged()[:-len(self.regex)]
        lead = f"(?=[{self.lead}])" if self.lead else ""
        run = f"(?:(?<![{self.run}])|\\G)" if self.run else ""
        return f"{flags}{lead}{run}{self.regex}"

    def flagged(self) -> str:
        """The regex with its flags in front: dot matches newline, multi-line anchors, and case
        folding unless the shape is about capitals."""
        flags = "(?sm)" if self.case_sensitive else "(?ism)"
        return flags + self.regex


@dataclass(frozen=True)
class Entity:
    pii_type: str
    shapes: tuple[Shape, ...]
    context: tuple[str, ...] = ()
    # name of a check in functions.checksums; True raises the score to 1, False drops the match
    check: Check = None
    on_by_default: bool = True


# --------------------------------------------------------------------------------------------
# Telecom, address and identity-document shapes.  Regexes, scores and context words
# must equal the published ones for results to agree; only ``needs`` is ours.
# --------------------------------------------------------------------------------------------

_STREET = (
    r"(Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Boulevard|Blvd|Circuit|Cct|Court|Ct|Place|Pl|Way|Crescent|Cres)"
)
_STREET_NEEDS = (
    ("#1",),
    ("st", "road", "rd", "ave", "dr", "lane", "ln", "boulevard", "blvd", "circuit", "cct", "court", "ct", "pl",
     "way", "cres"),
)
_STATES = ("nsw", "vic", "qld", "wa", "sa", "tas", "act", "nt")

AU_ENTITIES = (
    Entity(
        "AU_ADDRESS",
        (
            Shape("australian_street_address",
                  r"\b\d{1,3}\s+(?:[A-Za-z]+\s+){1,5}" + _STREET
                  + r"\b,?\s*(?:[A-Za-z]+\s+){1,3}(NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\s+\d{4}\b",
                  0.95, _STREET_NEEDS + (_STATES,)),
            Shape("australian_street_with_suburb",
                  r"\b\d{1,3}\s+(?:[A-Za-z]+\s+){1,5}" + _STREET + r"\b,?\s+[A-Za-z]+(?:\s+[A-Za-z]+){0,2}\b",
                  0.8, _STREET_NEEDS),
            Shape("australian_street_simple",
                  r"\b\d{1,3}\s+(?:[A-Za-z]+\s+){1,5}" + _STREET + r"\b",
                  0.7, _STREET_NEEDS),
        ),
    ),
    Entity(
        "AU_PHONE_NUMBER",
        (
            Shape("au_landline", r"\b\(?0[2-9]\)?[-\s]?\d{4}[-\s]?\d{4}\b", 0.85, (("#8",), runs(2, 4, 4), ("0",))),
            Shape("au_mobile", r"\b04\d{2}[-\s.]?\d{3}[-\s.]?\d{3}\b", 0.9, (("#8",), ("04",), runs(4, 3, 3))),
            Shape("au_international", r"\b\+?61[-\s]?\(?0?\)?[-\s]?[2-9][-\s]?\d{4}[-\s]?\d{4}\b", 0.95,
                  (("#8",), ("61",))),
            Shape("au_international_mobile", r"\b\+?61[-\s]?4\d{2}[-\s]?\d{3}[-\s]?\d{3}\b", 0.95,
                  (("#8",), ("61",))),
            Shape("au_mobile_partial", r"\b04\d{2}[-\s]?\d{2,3}[-\s]?\d{2,3}\b", 0.6, (("#8",), ("04",), runs(4, (2, 3), (2, 3)))),
        ),
        context=("phone", "mobile", "cell", "number", "call", "contact", "tel", "ph"),
    ),
    Entity(
        "DATE_OF_BIRTH",
        (
            Shape("dob_with_prefix",
                  r"(?:dob|d\.o\.b\.?|date\s*of\s*birth|birth\s*date|born)[:\s]+"
                  r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})",
                  0.95, (("#1",), ("dob", "d.o.b", "birth", "born"))),
            Shape("dob_written_with_prefix",
                  r"(?:dob|d\.o\.b\.?|date\s*of\s*birth|birth\s*date|born)[:\s]+(\d{1,2})(?:st|nd|rd|th)?\s+"
                  r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
                  r"|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{2,4}",
                  0.95, (("#1",), ("dob", "d.o.b", "birth", "born"))),
            Shape("dob_ddmmyyyy_slash", r"\b(0?[1-9]|[12][0-9]|3[01])\/(0?[1-9]|1[0-2])\/(19|20)\d{2}\b", 0.3,
                  (("/19", "/20"),)),
            Shape("dob_ddmmyyyy_dash", r"\b(0?[1-9]|[12][0-9]|3[01])-(0?[1-9]|1[0-2])-(19|20)\d{2}\b", 0.3,
                  (("-19", "-20"),)),
            Shape("dob_iso_format", r"\b(19|20)\d{2}-(0?[1-9]|1[0-2])-(0?[1-9]|[12][0-9]|3[01])\b", 0.3,
                  (("#6",), ("19", "20"), ("|4|1|1|", "|4|1|2|", "|4|2|1|", "|4|2|2|"))),
            Shape("dob_written_long",
                  r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(January|February|March|April|May|June|July|August|September"
                  r"|October|November|December)\s+(19|20)\d{2}\b",
                  0.3, (("19", "20"), ("january", "february", "march", "april", "may", "june", "july", "august",
                                       "september", "october", "november", "december"))),
        ),
        context=("date of birth", "dob", "d.o.b", "birthdate", "born", "birthday", "age"),
    ),
    Entity(
        "AU_NBN_LOC_ID",
        (
            Shape("nbn_loc_id_standard", r"\bLOC[-\s]?([A-Z0-9]{10,12})\b", 0.9, (("loc",),)),
            Shape("nbn_loc_id_with_context",
                  r"(?:location\s*id|loc\s*id|nbn\s*location)[:\s#]*(LOC)?[-\s]?([A-Z0-9]{10,12})", 0.95,
                  (("loc",),)),
        ),
        context=("location id", "loc id", "nbn location", "premises", "nbn address", "service address"),
    ),
    Entity(
        "AU_NBN_SERVICE_ID",
        (
            Shape("nbn_avc_id", r"\bAVC[-\s]?([A-Z0-9]{10,12})\b", 0.9, (("avc",),)),
            Shape("nbn_cvc_id", r"\bCVC[-\s]?([A-Z0-9]{6,12})\b", 0.9, (("cvc",),)),
            Shape("nbn_poi_id", r"\bPOI[-:\s]?([A-Z0-9]{3,15})\b", 0.8, (("poi",),)),
            Shape("nbn_service_class", r"\b(?:Service\s*Class|SC)[-\s]?([0-9]{1,2})\b", 0.7,
                  (("#1",), ("sc", "class"))),
        ),
        context=("avc", "cvc", "virtual circuit", "nbn service", "access circuit", "poi", "service class"),
    ),
    Entity(
        "AU_SPECIAL_PHONE",
        (
            Shape("au_1300_number", r"\b1300[-\s]?\d{3}[-\s]?\d{3}\b", 0.9, (("1300",), runs(4, 3, 3))),
            Shape("au_1800_number", r"\b1800[-\s]?\d{3}[-\s]?\d{3}\b", 0.9, (("1800",), runs(4, 3, 3))),
            Shape("au_13_number", r"\b13[-\s]?\d{2}[-\s]?\d{2}\b", 0.85, (("#6",), ("13",), runs(2, 2, 2))),
        ),
        context=("phone", "call", "contact", "helpline", "support", "hotline", "number"),
    ),
    Entity(
        "AU_PO_BOX",
        (
            Shape("po_box_standard", r"\bP\.?\s*O\.?\s*Box\s+\d{1,6}\b", 0.85, (("box",),)),
            Shape("gpo_box", r"\bGPO\s*Box\s+\d{1,6}\b", 0.85, (("gpo",),)),
            Shape("locked_bag", r"\bLocked\s+Bag\s+\d{1,6}\b", 0.85, (("locked",),)),
            Shape("private_bag", r"\bPrivate\s+Bag\s+\d{1,6}\b", 0.85, (("private",),)),
            Shape("po_box_full_address",
                  r"\b(?:P\.?\s*O\.?\s*Box|GPO\s*Box)\s+\d{1,6}\s*,?\s*[A-Za-z][A-Za-z\s]{2,25}\s+"
                  r"(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\s+\d{4}\b",
                  0.95, (("box",), _STATES)),
            Shape("cmb_rmb_rural", r"\b(?:CMB|RMB|RSD|MS)\s*\.?\s*\d{1,6}\b", 0.8,
                  (("#1",), ("cmb", "rmb", "rsd", "ms"))),
        ),
        context=("postal", "mail", "correspondence", "send to", "address", "post"),
    ),
    Entity(
        "IMEI",
        (
            Shape("imei_with_context", r"(?:imei|device\s*id|handset)[:\s#]*(\d{15,17})", 0.95,
                  (("#8",), ("imei", "device", "handset"))),
            Shape("imei_15_digit", r"\b\d{15}\b", 0.4, (one_run(15),)),
            Shape("imei_formatted", r"\b\d{2}[-\s]?\d{6}[-\s]?\d{6}[-\s]?\d{1}\b", 0.7, (("#13",), runs(2, 6, 6, 1))),
        ),
        context=("imei", "device id", "handset", "phone serial", "mobile device", "device"),
    ),
    Entity(
        "ICCID",
        (
            Shape("iccid_with_context", r"(?:iccid|sim|sim\s*card|sim\s*number)[:\s#]*(89\d{17,19})", 0.95,
                  (("#8",), ("iccid", "sim"), ("89",))),
            Shape("iccid_generic", r"\b89\d{17,19}\b", 0.85, (("#13",), ("89",), one_run(19, 20, 21))),
        ),
        context=("iccid", "sim", "sim card", "sim number", "icc", "sim serial"),
    ),
    Entity(
        "AU_NTD_SERIAL",
        (
            Shape("ntd_prefixed", r"\bNTD[-\s]?([A-Z0-9]{8,16})\b", 0.9, (("ntd",),)),
            Shape("ntd_nokia", r"\bNOKA[A-Z0-9]{8,14}\b", 0.85, (("noka",),)),
            Shape("ntd_alcatel", r"\bALCL[A-Z0-9]{8,14}\b", 0.85, (("alcl",),)),
            Shape("ntd_hfc_modem", r"\b[23]M[A-Z0-9]{8,12}\b", 0.8, (("2m", "3m"),)),
            Shape("ntd_with_context",
                  r"(?:ntd|network\s*termination|connection\s*box|nbn\s*device)[:\s#]*([A-Z0-9]{8,16})", 0.95,
                  (("ntd", "termination", "connection", "nbn"),)),
        ),
        context=("ntd", "network termination", "connection box", "nbn device", "nbn equipment", "modem serial"),
    ),
    Entity(
        "AU_DRIVER_LICENSE",
        (
            Shape("au_dl_with_context",
                  r"(?:driver[']?s?\s*licen[cs]e|DL|licen[cs]e\s*(?:no|number|num|#))[:\s#]*([A-Za-z]?\d{6,9})",
                  0.9, (("#6",), ("licen", "dl"))),
            Shape("au_dl_number_prefix", r"(?:licen[cs]e|DL)[:\s#]*([A-Za-z0-9]{6,10})", 0.85, (("licen", "dl"),)),
            Shape("au_dl_state_prefix",
                  r"(?:licen[cs]e|lic\.?)\s+(?:vic|nsw|qld|sa|wa|tas|nt|act)\s+(\d{6,10})\b", 0.9,
                  (("#6",), ("lic",))),
            Shape("au_dl_license_state",
                  r"\b(?:vic|nsw|qld|sa|wa|tas|nt|act)\s+(?:licen[cs]e|lic\.?)\s*[:\-#]?\s*(\d{6,10})\b", 0.9,
                  (("#6",), ("lic",))),
            Shape("au_dl_vic_alpha", r"\b[A-Za-z]\d{8}\b", 0.5, (one_run(8),)),
            Shape("au_dl_sa", r"\b[A-Za-z]\d{5}\b", 0.4, (one_run(5),)),
            Shape("au_dl_8digit", r"\b\d{8}\b", 0.01, (one_run(8),)),
            Shape("au_dl_9digit", r"\b\d{9}\b", 0.01, (one_run(9),)),
        ),
        context=("driver license", "driver licence", "drivers license", "drivers licence", "driving license",
                 "driving licence", "DL", "licence number", "license number", "licence no", "license no",
                 "lic", "drv", "d/l", "dl#"),
    ),
    Entity(
        "AU_PASSPORT",
        (
            Shape("au_passport_standard", r"\b[PNE][A-Za-z]\d{7}\b", 0.7, (one_run(7),)),
            Shape("au_passport_single_letter", r"\b[PNELM]\d{7}\b", 0.65, (one_run(7),)),
            Shape("au_passport_generic", r"\b[A-Za-z]{2}\d{7}\b", 0.5, (one_run(7),)),
            Shape("au_passport_with_context",
                  r"(?:passport|passport\s*(?:no|number|num|#)|travel\s*document)[:\s#]*([A-Za-z]{1,2}\d{7})",
                  0.95, (("#6",), ("passport", "document"))),
        ),
        context=("passport", "passport number", "travel document", "passport no", "australian passport",
                 "au passport"),
    ),
    Entity(
        "AU_CENTRELINK_CRN",
        (
            Shape("au_crn_standard", r"\b\d{9}[A-Za-z]\b", 0.75, (one_run(9),)),
            Shape("au_crn_with_context",
                  r"(?:centrelink|CRN|customer\s*reference\s*(?:no|number|num)?|reference\s*(?:no|number|num))"
                  r"[:\s#]*(\d{9}[A-Za-z])",
                  0.95, (("#8",), ("centrelink", "crn", "reference"))),
            Shape("au_crn_pension",
                  r"(?:pension|concession|health\s*care|seniors)[\s]*(?:card)?[:\s#]*(\d{9}[A-Za-z])",
                  0.9, (("#8",), ("pension", "concession", "health", "seniors"))),
        ),
        context=("centrelink", "CRN", "customer reference number", "reference number", "pension", "concession",
                 "health care card", "seniors card"),
    ),
    Entity(
        "GENERIC_NUMBER",
        (
            Shape("any_digit_sequence", r"\b\d{4,16}\b", 0.4, (("#1",),)),
            Shape("formatted_numbers", r"\b\d{1,3}(,\d{3})+\b", 0.65, (("#1",), (",",))),
            Shape("decimal_numbers", r"\b\d+\.\d+\b", 0.65, (("#1",), (".",))),
        ),
        context=("number", "digit", "id", "member", "account"),
        on_by_default=False,
    ),
)

# --------------------------------------------------------------------------------------------
# General identifiers.  The published tool takes these from a separate library, so the shapes and
# scores here are our own choices from public formats and public check-digit rules (README).
# --------------------------------------------------------------------------------------------

GENERAL_ENTITIES = (
    Entity(
        "EMAIL_ADDRESS",
        (Shape("email", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", 1.0, (("@",),),
               run=r"\p{L}\p{N}._%+-"),),
    ),
    Entity(
        "PHONE_NUMBER",
        (
            Shape("phone_international", r"\+\d{1,3}[-\s.]?\(?\d{2,4}\)?(?:[-\s.]?\d{2,4}){2,3}\b", 0.75,
                  (("+",), ("#6",))),
            Shape("phone_area_in_brackets", r"\(\d{3}\)\s?\d{3}[-\s.]\d{4}\b", 0.6, (("(",), ("|3|3|4|",))),
            Shape("phone_separated", r"\b\d{3}[-.]\d{3}[-.]\d{4}\b", 0.4, (("|3|3|4|",),)),
        ),
        context=("phone", "number", "telephone", "cell", "cellphone", "mobile", "call"),
    ),
    Entity(
        "CREDIT_CARD",
        # 13 to 19 digits in any grouping; the check digit decides
        (Shape("card_number", r"\b[1-6](?:[- ]?\d){12,18}\b", 0.3, (("#13",),)),),
        context=("credit", "card", "visa", "mastercard", "amex", "discover", "jcb", "diners", "maestro"),
        check="card",
    ),
    Entity(
        "IP_ADDRESS",
        (
            Shape("ipv4",
                  r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", 0.6,
                  (("#1",), (".",))),
            Shape("ipv6", r"\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b", 0.6, ((":",),)),
            Shape("ipv6_shortened",
                  r"\b[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?\b", 0.6,
                  (("::",),)),
        ),
        context=("ip", "ipv4", "ipv6"),
    ),
    Entity(
        "US_SSN",
        (Shape("ssn_separated", r"\b\d{3}[- .]\d{2}[- .]\d{4}\b", 0.5, (("|3|2|4|",),)),),
        context=("social", "security", "ssn", "ssns", "ssid"),
        check="ssn",
    ),
    Entity(
        "US_BANK_NUMBER",
        (Shape("us_bank_digits", r"\b\d{8,17}\b", 0.05, (one_run(*range(8, 18)),)),),
        context=("bank", "check", "account", "acct", "save", "debit"),
    ),
    Entity(
        "US_DRIVER_LICENSE",
        (Shape("us_dl_letter_digits", r"\b[A-Z]\d{6,8}\b", 0.3, (one_run(6, 7, 8),)),),
        context=("driver", "license", "permit", "lic", "identification", "dls", "cdls"),
    ),
    Entity(
        "US_ITIN",
        (Shape("itin_separated", r"\b9\d{2}[- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b", 0.5,
               (("|3|2|4|",),)),),
        context=("individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin"),
    ),
    Entity(
        "US_PASSPORT",
        (
            Shape("us_passport_digits", r"\b\d{9}\b", 0.05, (one_run(9),)),
            Shape("us_passport_letter", r"\b[A-Z]\d{8}\b", 0.1, (one_run(8),)),
        ),
        context=("us", "united", "states", "passport", "travel", "document"),
    ),
    Entity(
        "UK_NHS",
        (Shape("nhs_grouped", r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b", 0.5, (runs(3, 3, 4),)),),
        context=("national health service", "nhs", "health services authority", "health authority"),
        check="nhs",
    ),
    Entity(
        "SG_NRIC_FIN",
        (
            Shape("nric_prefixed", r"\b[STFGM]\d{7}[A-Z]\b", 0.5, (one_run(7),)),
            Shape("nric_any_letter", r"\b[A-Z]\d{7}[A-Z]\b", 0.3, (one_run(7),)),
        ),
        context=("fin", "fin#", "nric", "nric#"),
    ),
    Entity(
        "IBAN_CODE",
        (Shape("iban", r"\b[A-Z]{2}\d{2}[ ]?[A-Z0-9]{4}(?:[ ]?[A-Z0-9]{4}){1,6}(?:[ ]?[A-Z0-9]{1,3})?\b", 0.5,
               (("#1",),)),),
        context=("iban", "bank", "transaction"),
        check="iban",
    ),
    Entity(
        "CRYPTO",
        (Shape("base58_address", r"\b(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", 0.5,
               (("#1",),), case_sensitive=True),),
        context=("wallet", "btc", "bitcoin", "crypto"),
    ),
    Entity(
        "URL",
        (Shape("http_url", r"\bhttps?://[^\s<>\x22']+", 0.6, (("http",),)),),
        context=("url", "website", "link"),
    ),
    Entity(
        "AU_TFN",
        (
            Shape("tfn_grouped", r"\b\d{3}[\s-]\d{3}[\s-]\d{3}\b", 0.1, (("|3|3|3|",),)),
            Shape("tfn_compact", r"\b\d{9}\b", 0.01, (one_run(9),)),
        ),
        context=("tax file number", "tfn"),
        check="tfn",
    ),
    Entity(
        "AU_MEDICARE",
        (
            Shape("medicare_grouped", r"\b[2-6]\d{3}[\s-]\d{5}[\s-]\d\b", 0.1, (("|4|5|1|",),)),
            Shape("medicare_compact", r"\b[2-6]\d{9}\b", 0.01, (one_run(10),)),
        ),
        context=("medicare",),
        check="medicare",
    ),
    Entity(
        "AU_ABN",
        (
            Shape("abn_grouped", r"\b\d{2}[\s-]\d{3}[\s-]\d{3}[\s-]\d{3}\b", 0.1, (("|2|3|3|3|",),)),
            Shape("abn_compact", r"\b\d{11}\b", 0.01, (one_run(11),)),
        ),
        context=("australian business number", "abn"),
        check="abn",
    ),
    Entity(
        "AU_ACN",
        (
            Shape("acn_grouped", r"\b\d{3}[\s-]\d{3}[\s-]\d{3}\b", 0.1, (("|3|3|3|",),)),
            Shape("acn_compact", r"\b\d{9}\b", 0.01, (one_run(9),)),
        ),
        context=("australian company number", "acn"),
        check="acn",
    ),
)

# Titles that announce a name (fixed values).
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "rev", "sir", "dame", "lord", "lady")

_TITLES_AS_WRITTEN = tuple(t.upper() for t in TITLES) + tuple(t.capitalize() for t in TITLES)
_CAPS_TITLE = "|".join(t.upper() for t in TITLES)
_ANY_TITLE = "|".join(_TITLES_AS_WRITTEN)
# One word of an all-capitals name: O'BRIEN, SMITH or SMITH-JONES (fixed values).
CAPS_NAME_WORD = r"(?:[A-Z]+'[A-Z]+|[A-Z]{2,}(?:-[A-Z]+)*)"
CAPS_NAME = rf"\b(?:{_CAPS_TITLE})\s+{CAPS_NAME_WORD}(?:\s+{CAPS_NAME_WORD}){{0,2}}\b"
# One word of a name in ordinary writing: Smith, O'Brien, Mary-Jane.
_TITLE_NAME_WORD = r"[A-Z](?:'[A-Z])?[a-z]+(?:-[A-Z][a-z]+)*"
# The part of a person match that is the title, not the name.
TITLE_LEAD = rf"^(?:{_ANY_TITLE})\.?\s+"

PERSON = Entity(
    "PERSON",
    (
        # no ``needs``: one pass of these regexes costs less than a search for each of the titles
        Shape("titled_capitals", CAPS_NAME, 0.85, case_sensitive=True),
        Shape("titled_name",
              rf"\b(?:{_ANY_TITLE})\.?[ ]{_TITLE_NAME_WORD}(?:[ ]{_TITLE_NAME_WORD}){{0,2}}\b", 0.85,
              case_sensitive=True),
    ),
)

# The characters that a match of a shape begins with; shapes that ignore case take either case of a letter.
_LEADS = {
    "0-9": "australian_street_address australian_street_with_suburb australian_street_simple dob_ddmmyyyy_slash "
           "dob_ddmmyyyy_dash dob_written_long imei_15_digit imei_formatted au_dl_8digit au_dl_9digit au_crn_standard "
           "any_digit_sequence formatted_numbers decimal_numbers phone_separated ipv4 ssn_separated us_bank_digits "
           "us_passport_digits nhs_grouped tfn_grouped tfn_compact abn_grouped abn_compact acn_grouped acn_compact",
    "(0": "au_landline",
    "0": "au_mobile au_mobile_partial",
    "+6": "au_international au_international_mobile",
    "db": "dob_with_prefix dob_written_with_prefix",
    "12": "dob_iso_format",
    "l": "nbn_loc_id_standard locked_bag au_dl_state_prefix",
    "ln": "nbn_loc_id_with_context",
    "a": "nbn_avc_id ntd_alcatel",
    "c": "nbn_cvc_id",
    "p": "nbn_poi_id po_box_standard private_bag",
    "s": "nbn_service_class",
    "1": "au_1300_number au_1800_number au_13_number",
    "g": "gpo_box",
    "pg": "po_box_full_address",
    "crm": "cmb_rmb_rural",
    "idh": "imei_with_context",
    "is": "iccid_with_context",
    "8": "iccid_generic",
    "n": "ntd_prefixed ntd_nokia",
    "23": "ntd_hfc_modem",
    "nc": "ntd_with_context",
    "dl": "au_dl_with_context au_dl_number_prefix",
    "vnqswta": "au_dl_license_state",
    "a-z": "au_dl_vic_alpha au_dl_sa au_passport_generic us_dl_letter_digits us_passport_letter nric_any_letter iban",
    "pne": "au_passport_standard",
    "pnelm": "au_passport_single_letter",
    "pt": "au_passport_with_context",
    "cr": "au_crn_with_context",
    "pchs": "au_crn_pension",
    "1-6": "card_number",
    "0-9a-f": "ipv6 ipv6_shortened",
    "9": "itin_separated",
    "stfgm": "nric_prefixed",
    "b13": "base58_address",
    "h": "http_url",
    "2-6": "medicare_grouped medicare_compact",
    "MDPRSL": "titled_capitals titled_name",
}
_LEAD_OF = {name: lead for lead, names in _LEADS.items() for name in names.split()}


def _led(e: Entity) -> Entity:
    return replace(e, shapes=tuple(replace(s, lead=_LEAD_OF.get(s.name, "")) for s in e.shapes))


ENTITIES: tuple[Entity, ...] = tuple(map(_led, GENERAL_ENTITIES + AU_ENTITIES + (PERSON,)))
BY_TYPE: dict[str, Entity] = {e.pii_type: e for e in ENTITIES}
DEFAULT_TYPES: tuple[str, ...] = tuple(e.pii_type for e in ENTITIES if e.on_by_default)
