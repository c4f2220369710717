from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.fixed import PATTERNS, V16
from quillon.functions.names import contradiction, name_facts, rivalry
from quillon.functions.text import is_null_like, normalize_name, normalize_value, signature, tidy, truncated
from quillon.functions.validators import validator
from quillon.operators.scan import match_rows, match_spans

AS_OF = date(2025, 1, 1)

VALID = {
    "Credit Card Number": ("4111 1111 1111 1111", "4111-1111-1111-1112", "0000000000000000"),
    "Aadhaar Number": ("2341 2341 2346", "2341 2341 2347", "1341 2341 2346"),
    "IBAN": ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "GB82"),
    "UK NHS Number": ("943 476 5919", "9434765918", "943476591"),
    "IP Address": ("10.0.0.1", "10.0.0.256", "10.01.0.1"),
    "PAN Number": ("abcde1234f", "ABCD1234F", "ABCDE12345"),
    "IFSC Code": ("SBIN0001234", "SBIN1001234", "SBIN000123"),
    "MAC Address": ("0a:1b-2c:3d:4e:5f", "0a:1b:2c:3d:4e", "0g:1b:2c:3d:4e:5f"),
    "Email Address": ("a.b+c@d-e.org", "a@b", "a b@c.org"),
    "Social Security Number": ("123-45-6789", "666-45-6789", "123-00-6789"),
    "National Insurance Number": ("AB 12 34 56 C", "BG123456C", "AB123456E"),
    "Tax Identification Number": ("912-88-1234", "912-89-1234", "812-70-1234"),
    "Phone Number": ("+4915112345678", "0123456789", "911234567890"),
    "Date of Birth": ("31/12/1990", "2025-01-02", "1900-01-01"),
}


@pytest.mark.parametrize("entity", VALID)
def test_validators(spark, entity):
    rows = spark.createDataFrame([(v,) for v in VALID[entity]], "v string").select(validator(entity, F.col("v"), AS_OF).alias("ok")).collect()
    assert [r.ok for r in rows] == [True, False, False]


def test_more_addresses(spark):
    cases = {"::1": True, "1::2:3": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7::": True, "1:2:3:4:5:6:7:8::": False, "1::2::3": False, "::ffff:1.2.3.4": True, "1:2:3": False}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", validator("IP Address", F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == cases


def test_no_validator():
    assert validator("Voter ID", None) is None


def test_text(spark):
    assert [normalize_value(v) for v in (" ａ１ \xa0b–c ", "x\ty", "N/A", "\x1c a\x85\xa0b\u3000")] == ["a1 b-c", "x y", "N/A", "a b"]
    values = ["a \x1c\x1d b", " x\u2028y–z\x85", "\xa0\xa0", "plain", "é\u2028è"]  # no compatibility forms but blanks, so both ways agree
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", tidy(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [normalize_value(r.v) for r in rows]
    assert [r[0] for r in spark.createDataFrame([("NaN",), ("<NA>",), ("0",)], "v string").select(is_null_like(F.col("v"))).collect()] == [True, True, False]


def test_signature(spark):
    rows = spark.createDataFrame([("AB-1234 xyz",), ("",), ("Éa" * 60,)], "v string").select(signature(F.col("v")).alias("s")).collect()
    assert rows[0].s == "AA-9{4} a{3}" and rows[1].s == "" and rows[2].s == "Aa" * 50


@pytest.mark.parametrize("n", [11_999, 12_000, 12_001])
def test_truncation(spark, n):
    row = spark.createDataFrame([("a" * (n - 1) + "b",)], "v string").select(truncated(F.col("v"), V16.cut_mark).alias("t")).first()
    assert len(row.t) == (n if n <= 12_000 else 12_000 + len(V16.cut_mark)) and row.t.endswith("b")


def test_names():
    assert normalize_name("customerName_ID-x.y") == "customer name id x y"
    assert name_facts("email").scores["Email Address"] == 1.0
    assert name_facts("my_email_x").scores["Email Address"] == 0.9
    assert name_facts("emial").scores["Email Address"] == 0.48
    facts = name_facts("phone_number")
    assert facts.scores["Passport Number"] == 0.55 and facts.scores["Phone Number"] == 0.9
    assert contradiction("Phone Number", facts.scores) == pytest.approx(0.165)
    assert name_facts("order_id").negatives >= {"Phone Number", "Bank Account Number"}
    assert name_facts("id").generic and name_facts("city").coarse_place and not name_facts("city_address").coarse_place
    assert rivalry("Aadhaar Number", {"Bank Account Number": 0.9, "Aadhaar Number": 0.2}) == pytest.approx(0.7)
    assert not name_facts("emial", fuzzy=False).scores


SAMPLES = {
    "pan_strict": "ABCDE1234F", "aadhaar": "2341 2341-2346", "email": "a.b@c.org", "ssn_dashes": "123-45-6789", "ssn_compact": "123456789", "ipv4": "10.20.30.40",
    "ipv6_full": "1:2:3:4:5:6:7:8", "cc_groups": "4111 1111 1111 1111", "phone_intl": "+4915112345678", "phone_in_mobile": "9876543210", "phone_us": "743-555-3824",
    "passport_in": "A1234567", "passport_generic": "AB123456", "dl_in": "KA01 12345678901", "dl_us": "D1234567", "voter_id": "ABC1234567", "iban": "GB82WEST12345698765432",
    "ifsc": "SBIN0001234", "bank_acc": "123456789012", "mac_colon": "0a:1b:2c:3d:4e:5f", "mac_hyphen": "0a-1b-2c-3d-4e-5f", "btc_legacy": "1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "eth": "0x" + "ab" * 20, "dob_iso": "1990-02/03", "dob_dmy": "03/02-1990", "nhs": "943 476 5919", "uk_ni": "AB123456C", "us_itin": "912-78-1234",
    "employee_id": "EMP-12AB", "customer_id": "CUSTOMER_123", "user_id": "USR 123", "contract_number": "CTR/AB-12_3", "device_serial": "SN-12345",
}


def test_patterns(spark):
    rows = [(n, f"x {s} y") for n, s in SAMPLES.items()] + [(n, f"é{s}é") for n, s in SAMPLES.items()]
    df = spark.createDataFrame(rows, "own string, value string")
    found = {(r.own, r.pattern, r.span) for r in match_rows(df).collect() if r.value.startswith("x")}
    assert {(n, n, s) for n, s in SAMPLES.items()} <= found and set(SAMPLES) == {p.name for p in PATTERNS}
    # A letter beyond ASCII is part of a word, so no pattern with a word edge matches; both ways of scanning agree.
    beside = {(r.own, r.pattern, r.span) for r in match_rows(df).collect() if r.value.startswith("é")}
    python = {(r.own, r.pattern, r.span) for r in match_spans(df).collect() if r.value.startswith("é")}
    assert beside == python and not any(own == pattern for own, pattern, _ in beside if own not in ("phone_intl",))


def test_guards_spare_no_match(spark):
    """Patterns behind their guards find what the plain patterns find, on texts put together from parts of matches."""
    import random
    import re

    rng = random.Random(3)
    parts = [c for s in SAMPLES.values() for c in (s, s[: len(s) // 2], s[len(s) // 2 :])] + [" ", " ", "x", "-", ".", "é", "٣٤٥", "\n", "@", "0"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 6)))) for i in range(4000)]
    got = {}
    for r in match_rows(spark.createDataFrame(rows, "id long, value string")).collect():
        got.setdefault(r.id, []).append((r.pattern, r.span))
    for i, text in rows:
        assert got.get(i, []) == [(p.name, m.group()) for p in V16.patterns for m in re.finditer(p.regex, text)], text
