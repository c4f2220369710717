"""Patterns, reliabilities, word lists, thresholds and labels on which results depend.

Everything here is data that results must agree on; nothing here decides anything.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    entity: str
    regex: str
    score: float
    reliability: float
    grade: str  # strict, moderate or broad


# The patterns in order of scanning.
PATTERNS = (
    Pattern("pan_strict", "PAN Number", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.85, 0.99, "strict"),
    Pattern("aadhaar", "Aadhaar Number", r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.80, 0.92, "moderate"),
    Pattern("email", "Email Address", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.95, 0.99, "strict"),
    Pattern("ssn_dashes", "Social Security Number", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.90, 0.98, "strict"),
    Pattern("ssn_compact", "Social Security Number", r"\b(?!000|666|9\d{2})(?!000000000)\d{9}\b", 0.55, 0.55, "broad"),
    Pattern("ipv4", "IP Address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.85, 0.98, "strict"),
    Pattern("ipv6_full", "IP Address", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", 0.85, 0.98, "strict"),
    Pattern("cc_groups", "Credit Card Number", r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{3,4}\b", 0.82, 0.96, "strict"),
    Pattern("phone_intl", "Phone Number", r"\+[1-9]\d{6,14}\b", 0.78, 0.88, "moderate"),
    Pattern("phone_in_mobile", "Phone Number", r"\b[6-9]\d{9}\b", 0.75, 0.90, "moderate"),
    Pattern("phone_us", "Phone Number", r"\b(?:\+1[\s\-]?)?\(?\d{3}\)?[\s\-]\d{3}[\s\-]\d{4}\b", 0.72, 0.88, "moderate"),
    Pattern("passport_in", "Passport Number", r"\b[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]\b", 0.78, 0.90, "moderate"),
    Pattern("passport_generic", "Passport Number", r"\b[A-Z]{1,2}\d{6,9}\b", 0.52, 0.42, "broad"),
    Pattern("dl_in", "Driver License Number", r"\b[A-Z]{2}[0-9]{2}[\s]?[0-9]{11}\b", 0.68, 0.78, "moderate"),
    Pattern("dl_us", "Driver License Number", r"\b[A-Z][0-9]{7}\b", 0.52, 0.38, "broad"),
    Pattern("voter_id", "Voter ID", r"\b[A-Z]{3}[0-9]{7}\b", 0.70, 0.97, "strict"),
    Pattern("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})\b", 0.82, 0.99, "strict"),
    Pattern("ifsc", "IFSC Code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.88, 0.98, "strict"),
    Pattern("bank_acc", "Bank Account Number", r"\b\d{9,18}\b", 0.45, 0.28, "broad"),
    Pattern("mac_colon", "MAC Address", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.90, 0.99, "strict"),
    Pattern("mac_hyphen", "MAC Address", r"\b(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}\b", 0.90, 0.99, "strict"),
    Pattern("btc_legacy", "Crypto Wallet Address", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 0.72, 0.96, "moderate"),
    Pattern("eth", "Crypto Wallet Address", r"\b0x[a-fA-F0-9]{40}\b", 0.88, 0.99, "strict"),
    Pattern("dob_iso", "Date of Birth", r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b", 0.68, 0.92, "moderate"),
    Pattern("dob_dmy", "Date of Birth", r"\b\d{2}[-/]\d{2}[-/](?:19|20)\d{2}\b", 0.65, 0.88, "moderate"),
    Pattern("nhs", "UK NHS Number", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b", 0.70, 0.85, "moderate"),
    Pattern("uk_ni", "National Insurance Number", r"\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\d{6}[A-D]{1}\b", 0.88, 0.90, "moderate"),
    Pattern("us_itin", "Tax Identification Number", r"\b9\d{2}[\s\-]?[78]\d[\s\-]?\d{4}\b", 0.82, 0.92, "moderate"),
    Pattern("employee_id", "Employee Identifier", r"\b(?:EMP|EMPL|STAFF)[-_ ]?[A-Z0-9]{3,20}\b", 0.82, 0.93, "strict"),
    Pattern("customer_id", "Customer Identifier", r"\b(?:CUST|CUSTOMER|CLIENT)[-_ ]?[A-Z0-9]{3,24}\b", 0.82, 0.93, "strict"),
    Pattern("user_id", "User Identifier", r"\b(?:USR|USER)[-_ ]?[A-Z0-9]{3,24}\b", 0.80, 0.92, "strict"),
    Pattern("contract_number", "Contract Number", r"\b(?:CTR|CONTRACT|AGR)[-/ _]?[A-Z0-9][A-Z0-9/_-]{4,30}\b", 0.82, 0.92, "strict"),
    Pattern("device_serial", "Device Identifier", r"\b(?:SN|SERIAL|DEV|DEVICE)[-_ ]?[A-Z0-9]{5,30}\b", 0.82, 0.90, "strict"),
)

# What a match of each grade counts towards specificity.
GRADE_WEIGHT = {"strict": 1.0, "moderate": 0.72, "broad": 0.38}

# Reliability of named-entity detections; others count NER_RELIABILITY_ELSE.
NER_RELIABILITY = {
    "Email Address": 0.99, "IP Address": 0.98, "Credit Card Number": 0.96, "IBAN": 0.99, "MAC Address": 0.99,
    "Crypto Wallet Address": 0.98, "Phone Number": 0.82, "Person Name": 0.78, "Location": 0.76, "Date Time": 0.82,
    "Passport Number": 0.72, "Driver License Number": 0.45, "Bank Account Number": 0.38, "UK NHS Number": 0.85,
    "URL": 0.90, "Social Security Number": 0.95, "Tax Identification Number": 0.92, "National Insurance Number": 0.90,
}
NER_RELIABILITY_ELSE = 0.70

# Thresholds of evidence scores; others have THRESHOLD_ELSE.
THRESHOLDS = {
    "Person Name": 0.56, "Address": 0.58, "Location": 0.58, "Date of Birth": 0.56, "Aadhaar Number": 0.62, "Credit Card Number": 0.62,
    "Bank Account Number": 0.68, "Passport Number": 0.58, "Driver License Number": 0.60, "PAN Number": 0.58, "Phone Number": 0.58,
}
THRESHOLD_ELSE = 0.56

# Families of entities.
NATURAL = ("Person Name", "Address", "Location", "Organization")
IDENTIFIERS = ("Employee Identifier", "Customer Identifier", "User Identifier", "Device Identifier", "Contract Number")
OPAQUE = (
    "Aadhaar Number", "PAN Number", "Passport Number", "Driver License Number", "Voter ID", "Bank Account Number", "Credit Card Number",
    "IBAN", "IFSC Code", "Social Security Number", "IP Address", "MAC Address", "Crypto Wallet Address", "Employee Identifier",
    "Customer Identifier", "User Identifier", "Device Identifier", "Contract Number", "UK NHS Number", "Tax Identification Number",
    "National Insurance Number",
)
SPARSE = (
    "Email Address", "Credit Card Number", "Aadhaar Number", "PAN Number", "IBAN", "IFSC Code", "MAC Address", "IP Address", "Crypto Wallet Address",
)
PARENT = {"Address": "Location"}
COLLISIONS = (
    ("Phone Number", "Bank Account Number", "Driver License Number", "UK NHS Number"),
    ("Aadhaar Number", "Bank Account Number", "Driver License Number"),
    ("Passport Number", "Driver License Number", "Device Identifier"),
    ("Credit Card Number", "Bank Account Number", "Driver License Number"),
    ("IP Address", "Date Time"),
    ("PAN Number", "Passport Number", "Driver License Number"),
)
CONTRADICTIONS = {
    "Passport Number": ("Driver License Number", "Phone Number", "Bank Account Number"),
    "Driver License Number": ("Passport Number", "Phone Number", "Bank Account Number"),
    "Phone Number": ("Passport Number", "Driver License Number", "Bank Account Number"),
    "Bank Account Number": ("Phone Number", "Passport Number", "Driver License Number"),
    "Date of Birth": ("IP Address", "Phone Number"),
    "IP Address": ("Date of Birth",),
    "Person Name": ("Location",),
}

# Kind and strength of each entity's validator.
VALIDATORS = {
    "Credit Card Number": ("CHECKSUM", 1.00), "Aadhaar Number": ("CHECKSUM", 1.00), "IBAN": ("CHECKSUM", 1.00), "UK NHS Number": ("CHECKSUM", 1.00),
    "PAN Number": ("STRICT_FORMAT", 0.65), "IFSC Code": ("STRICT_FORMAT", 0.75), "MAC Address": ("STRICT_FORMAT", 0.80),
    "Email Address": ("STRICT_FORMAT", 0.85), "IP Address": ("STANDARD_PARSE", 0.70), "Date of Birth": ("PLAUSIBILITY", 0.70),
    "Phone Number": ("BASIC_STRUCTURE", 0.45), "Social Security Number": ("STRICT_FORMAT", 0.80),
    "National Insurance Number": ("STRICT_FORMAT", 0.80), "Tax Identification Number": ("STRICT_FORMAT", 0.75),
}

# Texts that count as no value, once normalised and in lower case.
NULL_LIKE = ("", "na", "n/a", "none", "null", "nil", "unknown", "not provided", "not available", "-", "--", "nan", "<na>")

# Column names that say nothing, tokens that make a name ambiguous.
GENERIC_NAMES = ("id", "identifier", "row number", "row num", "sequence", "seq", "index", "serial", "record number", "record id")
AMBIGUOUS = ("or", "maybe", "possible", "mixed", "alternate")
MEANS_GENERIC, MEANS_UNKNOWN = "generic identifier or sequence field", "unknown field semantics"

# Terms in column names that speak for an entity, and against it.
NAME_TERMS = {
    "Organization": ("organization", "organisation", "organization name", "organisation name", "company", "company name", "employer", "business name", "vendor name", "supplier name", "legal entity", "corporate name"),
    "Email Address": ("email", "email address", "mail", "e mail", "inbox"),
    "Phone Number": ("phone", "mobile", "mobile number", "contact no", "contact number", "telephone", "tel", "whatsapp"),
    "Aadhaar Number": ("aadhaar", "aadhar", "aadhaar number", "aadhar number", "uidai"),
    "PAN Number": ("pan", "pan number", "permanent account number"),
    "Passport Number": ("passport", "passport number", "travel document"),
    "Driver License Number": ("driver license", "driving license", "driving licence", "driver licence", "dl number"),
    "Voter ID": ("voter", "voter id", "epic", "election id"),
    "Bank Account Number": ("bank account", "account number", "bank account number", "acct number", "account no"),
    "Credit Card Number": ("credit card", "card number", "debit card", "payment card"),
    "IBAN": ("iban", "international bank account"),
    "IFSC Code": ("ifsc", "ifsc code", "bank branch code"),
    "Social Security Number": ("ssn", "social security", "social security number"),
    "IP Address": ("ip", "ip address", "ipv4", "ipv6", "client ip", "server ip"),
    "MAC Address": ("mac", "mac address", "hardware address"),
    "Crypto Wallet Address": ("wallet", "crypto wallet", "bitcoin address", "ethereum address", "blockchain address"),
    "Date of Birth": ("dob", "date of birth", "birth date", "birthday", "born"),
    "Person Name": ("name", "full name", "person name", "first name", "last name", "surname", "given name", "customer name", "employee name"),
    "Address": ("address", "home address", "street address", "residential address"),
    "Location": ("location", "city", "state", "district", "country", "place"),
    "Employee Identifier": ("employee id", "employee number", "emp id", "staff id"),
    "Customer Identifier": ("customer id", "customer number", "client id"),
    "User Identifier": ("user id", "username", "login id", "account id"),
    "Device Identifier": ("device id", "device identifier", "device serial", "device serial number", "serial number", "serial no", "hardware id", "imei", "meid", "asset tag", "equipment id"),
    "Contract Number": ("contract number", "contract id", "agreement number"),
    "UK NHS Number": ("nhs", "nhs number", "national health service"),
    "Tax Identification Number": ("itin", "tin", "tax id", "tax identification"),
    "National Insurance Number": ("ni number", "national insurance", "nino"),
}
NAME_NEGATIVES = {
    "Date of Birth": ("created date", "updated date", "order date", "invoice date", "transaction date", "event date", "timestamp", "date"),
    "Phone Number": ("row number", "sequence", "index", "order number", "order id", "transaction id", "invoice id", "reference id", "record id", "product id", "customer id", "employee id", "internal id", "tracking number", "shipment id", "ticket number", "case number", "account reference", "registration number", "numeric sku"),
    "Bank Account Number": ("row number", "sequence", "index", "order id", "product id", "transaction id", "invoice number"),
    "Passport Number": ("product code", "sku", "order id", "internal id"),
    "Driver License Number": ("product code", "sku", "order id", "internal id"),
    "PAN Number": ("product code", "sku", "coupon code", "coupon", "promo code", "promotion code", "voucher code", "token", "reference code", "campaign code", "internal code"),
    "IP Address": ("version", "release", "software version", "firmware version", "build version", "build number", "release version"),
}
COARSE_PLACES, EXACT_PLACES = ("city", "state", "country", "district"), ("address", "street", "home address", "residential address")

# Labels of named-entity recognisers, and of zero-shot models in lower case, by entity.
NER_LABELS = {
    "IN_PAN": "PAN Number", "IN_AADHAAR": "Aadhaar Number", "EMAIL_ADDRESS": "Email Address", "US_SSN": "Social Security Number",
    "US_SSN_CUSTOM": "Social Security Number", "IP_ADDRESS": "IP Address", "CREDIT_CARD": "Credit Card Number", "CREDIT_CARD_CUSTOM": "Credit Card Number",
    "PHONE_NUMBER": "Phone Number", "PHONE_NUMBER_CUSTOM": "Phone Number", "PASSPORT_NUMBER": "Passport Number", "IBAN": "IBAN", "MAC_ADDRESS": "MAC Address",
    "CRYPTO_WALLET": "Crypto Wallet Address", "IN_VOTER_ID": "Voter ID", "DRIVER_LICENSE": "Driver License Number", "BANK_ACCOUNT": "Bank Account Number",
    "DATE_OF_BIRTH": "Date of Birth", "DATE_TIME": "Date Time", "PERSON": "Person Name", "LOCATION": "Location", "NRP": "Nationality",
    "ORGANIZATION": "Organization", "URL": "URL", "MEDICAL_LICENSE": "Medical License", "UK_NHS": "UK NHS Number", "US_DRIVER_LICENSE": "Driver License Number",
    "US_PASSPORT": "Passport Number", "US_BANK_NUMBER": "Bank Account Number", "US_ITIN": "Tax Identification Number",
}
# Model labels that stand for a recogniser's label, and those that are left out; what a weak label's score is worth.
NER_RENAMED = {"PER": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "ORG": "ORGANIZATION"}
NER_IGNORED = ("CARDINAL", "DATE", "MONEY", "ORDINAL", "PERCENT", "QUANTITY", "TIME", "WORK_OF_ART", "EVENT", "FAC", "PRODUCT", "LANGUAGE")
NER_WEAK_FACTOR = 0.4
ZERO_SHOT_LABELS = {
    "person name": "Person Name", "email address": "Email Address", "phone number": "Phone Number", "home address": "Address", "street address": "Address",
    "location": "Location", "date of birth": "Date of Birth", "age": "Age", "aadhaar number": "Aadhaar Number", "pan number": "PAN Number",
    "passport number": "Passport Number", "driver license number": "Driver License Number", "voter id": "Voter ID", "bank account number": "Bank Account Number",
    "credit card number": "Credit Card Number", "iban": "IBAN", "ifsc code": "IFSC Code", "tax identification number": "Tax Identification Number",
    "social security number": "Social Security Number", "national insurance number": "National Insurance Number", "ip address": "IP Address",
    "mac address": "MAC Address", "vehicle registration number": "Vehicle Registration Number", "crypto wallet address": "Crypto Wallet Address",
    "employee identifier": "Employee Identifier", "customer identifier": "Customer Identifier", "user identifier": "User Identifier",
    "device identifier": "Device Identifier", "contract number": "Contract Number", "organization name": "Organization", "nhs number": "UK NHS Number",
    "national health service number": "UK NHS Number", "national insurance": "National Insurance Number", "itin": "Tax Identification Number",
}
ZERO_SHOT_PROMPTS = (
    "person name", "email address", "phone number", "home address", "street address", "location", "date of birth", "age", "aadhaar number", "PAN number",
    "passport number", "driver license number", "voter ID", "bank account number", "credit card number", "IBAN", "IFSC code", "tax identification number",
    "social security number", "national insurance number", "nhs number", "IP address", "MAC address", "vehicle registration number", "crypto wallet address",
    "employee identifier", "customer identifier", "user identifier", "device identifier", "contract number", "organization name",
)

# Zero-shot labels that confirm an entity besides its own name.
FAMILIES = {
    "Employee Identifier": ("Employee Identifier", "User Identifier"),
    "Customer Identifier": ("Customer Identifier", "User Identifier"),
    "User Identifier": ("User Identifier", "Customer Identifier", "Employee Identifier"),
}

# Encryption of cells.
CELL_PREFIX, COLUMN_SUFFIX, KEY_ROUNDS, KEY_BYTES = "AES::", " [MASKED]", 260_000, 32

# Length up to which values are scanned whole, and what is kept of longer ones on either side.
LONG_VALUE, LONG_SIDE = 12_000, 6_000


class Profile(NamedTuple):
    """What differs between the two generations of the engine that are reproduced."""

    name: str
    schema_version: str
    detector_version: str
    patterns: tuple[Pattern, ...]
    ner_reliability: dict[str, float]
    validators: dict[str, tuple[str, float]]
    date_formats: tuple[str, ...]
    fuzzy_names: bool
    samples: int
    max_samples: int | None
    zero_shot_threshold: float
    cut_mark: str
    rich_priority: bool
    capped_fill: bool


# Date formats in order of trial.
_DATES = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy", "d.M.yyyy", "yyyy.M.d")
_OLD_SCORES = {"ssn_compact": 0.60, "passport_generic": 0.58, "dl_us": 0.55}
_OLD_WITHOUT = ("nhs", "uk_ni", "us_itin")
_OLD_VALIDATORS = ("UK NHS Number", "Social Security Number", "National Insurance Number", "Tax Identification Number")

V16 = Profile("v16", "12.0", "16.0.0", PATTERNS, NER_RELIABILITY, VALIDATORS, _DATES, True, 20, None, 0.40, "\n…[TRUNCATED]…\n", False, False)
V13 = Profile(
    "v13", "9.0", "13.0.0",
    tuple(p._replace(score=_OLD_SCORES.get(p.name, p.score)) for p in PATTERNS if p.name not in _OLD_WITHOUT),
    NER_RELIABILITY | {"UK NHS Number": 0.55},
    {k: v for k, v in VALIDATORS.items() if k not in _OLD_VALIDATORS},
    _DATES[:6], False, 15, 15, 0.45, "\n...[TRUNCATED]...\n", True, True,
)
PROFILES = {p.name: p for p in (V16, V13)}
