"""Validators of spans as Column expressions; each gives true or false, and entities without one give null."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.fixed import V16, Profile
from quillon.functions.text import compact_alnum, constants, digits_only

# Ages in years that a date of birth may give.
YOUNGEST, OLDEST = 0, 120


def _at(text: Column, place: int, size: int = 1) -> Column:
    return F.substring(text, place + 1, size)


def _fully(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def luhn(value: Column) -> Column:
    digits = digits_only(value)
    return F.length(digits).between(13, 19) & ~digits.rlike(r"\A(.)\1*\z") & F.call_function("luhn_check", digits)


def _dihedral() -> tuple[list[int], list[int]]:
    """Products of the symmetries of the pentagon (5 * ... + ...), and powers of the digit permutation, both flat."""
    product = [((a % 5 + b % 5) % 5 if a < 5 else (a % 5 - b % 5) % 5) + 5 * ((a < 5) != (b < 5)) for a in range(10) for b in range(10)]
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed values: the permutation of the check's second place
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[d] for d in powers[-1]])
    return product, [d for row in powers for d in row]


def verhoeff(value: Column) -> Column:
    product, powers = map(constants, _dihedral())
    digits = digits_only(value)
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    check = F.aggregate(places, F.lit(0), lambda c, p: F.get(product, c * 10 + F.get(powers, (p["i"] % 8) * 10 + p["d"])))
    return _fully(digits, "[2-9][0-9]{11}") & (check == 0)


def iban(value: Column) -> Column:
    text = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    moved = F.split(F.concat(F.substring(text, 5, 34), F.left(text, F.lit(4))), "")
    # A letter stands for two digits, so it moves what came before by a hundred.
    rest = F.aggregate(moved, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97)
    return F.length(text).between(15, 34) & _fully(text, r"[A-Z]{2}[0-9]{2}[A-Z0-9]+") & (rest == 1)


def nhs(value: Column) -> Column:
    digits = digits_only(value)
    total = sum((_at(digits, i).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check = (11 - total % 11) % 11
    return _fully(digits, "[0-9]{10}") & (check == _at(digits, 9).cast("int"))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def ip(value: Column) -> Column:
    """IPv4 without leading zeros; IPv6 whole, with one gap, or with an IPv4 tail."""
    text = F.trim(value)
    group = "[0-9A-Fa-f]{1,4}"
    whole = rf"(?:{group}:){{7}}{group}|(?:{group}:){{6}}{_V4}"
    short = rf"(?:{group}(?::{group})*)?::(?:{group}(?::{group})*(?::{_V4})?|{_V4})?"
    groups = F.size(F.filter(F.split(F.regexp_replace(text, _V4, "0:0"), ":"), lambda g: g != ""))
    return _fully(text, f"{_V4}|{whole}") | (_fully(text, short) & (groups <= 7))


def pan(value: Column) -> Column:
    return _fully(F.upper(F.trim(value)), "[A-Z]{5}[0-9]{4}[A-Z]")


def ifsc(value: Column) -> Column:
    return _fully(F.upper(F.trim(value)), "[A-Z]{4}0[A-Z0-9]{6}")


def mac(value: Column) -> Column:
    return _fully(F.trim(value), "(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")


def email(value: Column) -> Column:
    return _fully(F.trim(value), r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")


def ssn(value: Column) -> Column:
    return _fully(digits_only(value), "(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}")


def national_insurance(value: Column) -> Column:
    return _fully(F.upper(compact_alnum(value)), "(?!BG|GB|KN|NK|NT|TN|ZZ)[A-Z&&[^DFIQUV]]{2}[0-9]{6}[A-D]")


def itin(value: Column) -> Column:
    return _fully(digits_only(value), "9[0-9]{2}(?:7[0-9]|8[0-8])[0-9]{4}")


def phone(value: Column) -> Column:
    raw, digits = F.trim(value), digits_only(value)
    return F.when(raw.startswith("+"), _fully(raw, r"\+[1-9][0-9]{6,14}")).otherwise(_fully(digits, "[1-9][0-9]{9}|91[6-9][0-9]{9}"))


def birth_date(value: Column, as_of: date | None = None, formats: tuple[str, ...] = V16.date_formats) -> Column:
    """Whether the first format that fits gives a date not after ``as_of`` (today if None) and no older than OLDEST years."""
    text = F.trim(value)
    day = F.coalesce(*[F.when(_fully(text, f.replace("yyyy", "[0-9]{4}").replace("M", "[0-9]{1,2}").replace("d", "[0-9]{1,2}").replace(".", r"\.")), F.try_to_date(text, f)) for f in formats])
    today = F.lit(as_of) if as_of else F.current_date()
    age = F.datediff(today, day) / 365.2425
    return F.coalesce((day <= today) & (age >= YOUNGEST) & (age <= OLDEST), F.lit(False))


_BY_ENTITY = {
    "Credit Card Number": luhn, "Aadhaar Number": verhoeff, "IBAN": iban, "UK NHS Number": nhs, "IP Address": ip, "PAN Number": pan, "IFSC Code": ifsc,
    "MAC Address": mac, "Email Address": email, "Social Security Number": ssn, "National Insurance Number": national_insurance,
    "Tax Identification Number": itin, "Phone Number": phone,
}


def validator(entity: str, value: Column, as_of: date | None = None, profile: Profile = V16) -> Column | None:
    """The verdict of an entity's validator on a span, or None if it has none."""
    if entity not in profile.validators:
        return None
    if entity == "Date of Birth":
        return birth_date(value, as_of, profile.date_formats)
    return _BY_ENTITY[entity](value)


def verdict(entity: Column, value: Column, as_of: date | None = None, profile: Profile = V16) -> Column:
    """The same where the entity is itself a column."""
    out = F.lit(None).cast("boolean")
    for name in profile.validators:
        out = F.when(entity == name, validator(name, value, as_of, profile)).otherwise(out)
    return out
