"""The rule registry: detectors, field labels, checksum and mask, all as Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: detection patterns, labels and aliases, which must equal the specification ----
#: Blanks that a browser's \s matches; Java's \s has only the ASCII ones.
BLANK = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{BLANK}]"
SH = f"[{BLANK}-]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = rf"(?<![0-9])(?:\+91{SH}?)?(?:[0-9]{{5}}{SH}?[0-9]{{5}}|(?:[0-9]{SH}?){{10}})(?![0-9])"
AADHAAR = rf"(?<![0-9])[2-9][0-9]{{3}}{SH}?[0-9]{{4}}{SH}?[0-9]{{4}}(?!{SH}?[0-9])"
PAN = r"(?<![A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Z0-9])"
UPI = r"(?<![0-9])[0-9]{10}@[A-Za-z]{2,12}(?![A-Za-z0-9])"
VOTERID = r"(?<![A-Z0-9])[A-Z]{3}[0-9]{7}(?![A-Z0-9])"
LICENCE = r"(?<![A-Za-z0-9_])[A-Z]{2}-?[0-9]{2}-?[0-9]{4}-?[0-9]{7}(?![A-Za-z0-9_])(?!-?[0-9])"
PASSPORT = r"(?<![A-Z0-9])[A-Z][1-9][0-9]{6}(?![0-9])"
CARD = rf"(?<![0-9])[0-9]{{4}}{SH}?[0-9]{{4}}{SH}?[0-9]{{4}}{SH}?[0-9]{{4}}(?![0-9])"
ACCOUNT = r"(?<![A-Za-z0-9_])[A-Z]{2,4}-[A-Z]{1,4}[0-9]{4,}(?![A-Za-z0-9_])"

SECRET_LABELS = ("password", "passwd", "pwd", "cpassword", "confirmpassword", "retypepassword", "secret", "currentpassword", "newpassword", "cvv", "otp", "pin")
SECRET_PARTS = r"api[_-]?key|secret|token|cvv|otp"
#: Field labels by family, in the order in which they are tried.
ALIASES = (
    ("name", ("names", "fullname", "given-name", "family-name", "nickname", "name", "cardholder-name", "username", "userid")),
    ("address", ("address", "street-address", "address-line1", "address-line2", "city", "zipcode", "postal")),
    ("email", ("email", "emailaddress")),
    ("phone", ("phone", "mobile", "tel", "telephone")),
    ("aadhaar", ("aadhaar", "aadhar", "uid")),
    ("pan", ("pan",)),
    ("dob", ("dob", "birthday", "dateofbirth")),
    ("account", ("account", "accountnumber", "accountno", "acct", "iban")),
    ("ifsc", ("ifsc",)),
    ("upi", ("upi", "upiid", "upiaddress")),
    ("voterid", ("voterid", "votercard", "epic")),
    ("dl", ("dlno", "dlnumber", "drivinglicence", "drivinglicense", "licenseno", "licenceno")),
    ("passport", ("passport", "passportnumber", "passportno")),
    ("card", ("card", "cc", "cardnumber", "creditcard")),
    ("ssn", ("ssn",)),
)
# ---- end of fixed values ----

ALIAS_PAIRS = [(alias, family) for family, names in ALIASES for alias in names]


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    ocr_only: bool = False
    luhn: bool = False
    tier: str = "B"


RULES = (
    Rule("email", EMAIL),
    Rule("phone", PHONE),
    Rule("aadhaar", AADHAAR),
    Rule("pan", PAN),
    Rule("upi", UPI),
    Rule("voterid", VOTERID),
    Rule("dl", LICENCE),
    Rule("passport", PASSPORT),
    Rule("card", CARD, luhn=True),
    Rule("account", ACCOUNT, ocr_only=True),
)
BY_NAME = {r.name: r for r in RULES}

#: No rule can match a text without an @ or four digits at most one blank or hyphen apart.
GUARD = rf"@|(?:[0-9]{SH}?){{4}}"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """What ``f`` makes of a value that it names more than once but that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def may_match(text: Column) -> Column:
    """Cheap test that every detector's text passes; also account numbers have four digits in a row."""
    return text.rlike(GUARD)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(value))
    at = F.sequence(F.lit(1), F.length(d))
    twice = lambda i, x: F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + twice(i, F.substr(d, i, F.lit(1)).cast("int")))
    return F.coalesce(F.length(d).between(13, 19) & (F.when(F.length(d) > 0, total % 10) == 0), F.lit(False))


def all_values(rule: Rule, text: Column) -> Column:
    """Values that a rule finds, left to right."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    if rule.luhn:
        found = F.filter(found, luhn_valid)
    if rule.name == "phone":
        found = F.filter(found, lambda v: F.length(digits(v)) >= 10)
    return found


def count_of(name: str, text: Column) -> Column:
    """How often a rule matches; 0 for null."""
    return F.when(may_match(text), F.size(all_values(BY_NAME[name], text))).otherwise(0)


def clean_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), rf"[_\-{BLANK}]", "")


def _secret(label: Column, cleaned: Column) -> Column:
    return cleaned.isin(*SECRET_LABELS) | F.lower(label).rlike(SECRET_PARTS)


def is_secret_label(label: Column) -> Column:
    return _secret(label, clean_label(label))


def field_type(label: Column) -> Column:
    """Sensitive field type of a label, or null: secrets, then an exact alias, then the first alias inside."""
    exact = F.create_map(*[F.lit(x) for pair in reversed(dict(reversed(ALIAS_PAIRS)).items()) for x in pair])
    inside = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("type")) for a, t in ALIAS_PAIRS if "-" not in a])
    first = lambda cleaned: F.get(F.filter(inside, lambda a: cleaned.contains(a["alias"])), F.lit(0))["type"]
    told = once(clean_label(label), lambda cleaned: F.when(_secret(label, cleaned), "password").otherwise(F.coalesce(F.try_element_at(exact, cleaned), first(cleaned))))
    return F.when(F.coalesce(label, F.lit("")) != "", told)


def field_tier(label: Column) -> Column:
    return tier_of(field_type(label))


def tier_of(kind: Column) -> Column:
    """Only secrets have the type password."""
    return F.when(kind == "password", "A").when(kind.isNotNull(), "B")


def mask_value(value: Column, strict: bool = True) -> Column:
    """A display form.  Strict hides at least half of the characters; compat keeps the listed parts only."""
    local, domain = F.substring_index(value, "@", 1), F.substr(value, F.instr(value, "@"))
    short = F.rpad(F.substring(local, 1, 1), 3, "*")
    email = F.concat(F.when(F.length(local) <= 2, short).otherwise(F.concat(F.substring(local, 1, 3), F.lit("***"))), domain)
    number = F.regexp_replace(value, "[0-9](?=(?:[^0-9]*[0-9]){4})", "X")
    rest = F.concat(F.substring(value, 1, 2), F.lit("…"))
    out = F.when(F.instr(value, "@") > 0, email).when(F.length(digits(value)) >= 4, number).otherwise(rest)
    if not strict:
        return out
    shown = F.length(F.regexp_replace(out, "[X*…]", ""))
    hidden = F.concat(F.substring(value, 1, 2), F.repeat(F.lit("X"), F.greatest(F.length(value) - 2, F.lit(1))))
    return F.when((F.instr(value, "@") == 0) & (shown * 2 > F.length(value)), hidden).otherwise(out)
