"""Lines with one or more known shapes each, for the tests; all values are made up here, check digits included."""

LINES = [
    # no shape, and shapes among letters of other scripts
    "the lantern is out", "Łąka 😀 tansy@fen.test 😀 0481 222 733", "ü0481 222 733",
    # places to write to
    "ring first, then 7 Quarry Road, Dubbo NSW 2830", "12/88 Heron Avenue Cairns QLD 4870", "GPO Box 4411",
    "Locked Bag 27", "PO Box 3318, Albany WA 6330", "P.O. Box 92", "Private Bag 640", "RMB 77",
    # machines and lines
    "handset says IMEI: 351234567890124", "35-123456-789012-4", "ICCID: 8961555566667777888", "SIM: 89619988776655443322",
    "ALCL246813579024", "NOKA97531864209753", "NTD-7C3F22B0D9E1", "2M7766554433", "nbn device: 3MFEDCBA9876",
    "LOC445566778899", "Location ID: LOC220033004400", "LOC-110022003300", "AVC880088008800 CVC765432 AVC-770077007700",
    "Service Class: SC34", "POI-5ADL07", "host 172.16.40.9 and fe80:0:0:0:9:8:7:6 and 2001:db8::b2", "https://kiln.test/q?k=v",
    # numbers of persons and firms
    "ACN 010 749 961", "ABN: 83 914 571 673", "TFN 876 543 210 and tfn 135792468", "Medicare: 4000 12345 1",
    "card 6011 0009 9013 9424", "5105-1051-0510-5100", "2223 0000 4841 0010", "IBAN NL91 ABNA 0417 1643 00",
    "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bank 998877665544", "itin 934-71-5678", "nhs 401 023 2137", "nric T7654321J",
    "ssn 219-09-9999", "CRN 204306918H", "pension card 771188225T", "passport no PB7654321", "M7654321 kl7654321",
    "licence nsw 55443322", "license vic 071829304", "vic licence 918273645", "DL: 55667788", "w87654321 and T54321",
    # dates
    "1991-11-30", "Born 9 October 1967", "born: 3 Feb 1974", "D.O.B: 07-08-1969", "DOB: 21/06/1988",
    "Date of birth: 11.12.1955", "seen 04/05/1996 or 04-05-1996 or 2nd June 1982",
    # telephones
    "(07) 5550 1234", "+44 161 496 0752", "+61 (0)7 5550 1234", "+61 481 222 733", "+61 7 5550 1234", "04 8122 2733",
    "0481 22 733", "0481-222-733", "0481 222 733", "0481.222.733", "07 5550 1234", "61 481 222 733",
    "1300 555 019, 1800 700 444, 1300700444, 13 77 66", "ask (202) 555-0143 or 202-555-0178",
    # persons, and numbers of no kind
    "Mrs Lark met DR TESS O'REED and PROF REED-MARSH, also Mr Lark", "8,765,432 and 56.78",
]
