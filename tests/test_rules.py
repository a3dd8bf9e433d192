import pytest
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.operators import actions, detect, tokens, urls

MATCHES = [
    ("support@invoices.example", ["email"]),
    ("+91 99887 76655", ["phone"]),
    ("ZZZPM1234Q", ["pan"]),
    ("3456 7890 1234", ["aadhaar"]),
    ("4242 4242 4242 4242", ["card", "aadhaar"]),
    ("4111 1111 1111 1111", ["card"]),
    ("9876543210@ybl", ["phone", "upi"]),
    ("9876543210@gmail.com", ["email", "phone", "upi"]),
    ("ABC1234567", ["voterid"]),
    ("MH-01-2023-4567890", ["dl"]),
    ("K1234567", ["passport"]),
    ("1298 0011 2200 4488", []),
    ("98765 43210", ["phone"]),
    ("987 654 3210 now", ["phone"]),
    ("60234567890123", []),
    ("NOVB0004123", []),
    ("K12345", []),
    ("12 MG Road, Bengaluru 560001", []),
    (None, []),
    ("", []),
]


def test_matches_with_offsets(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MATCHES)], "i int, t string")
    got = {r["i"]: [m["type"] for m in r["m"] or []] for r in df.select("i", detect.find_matches(F.col("t")).alias("m")).collect()}
    for i, (_, want) in enumerate(MATCHES):
        assert sorted(got[i]) == sorted(want), MATCHES[i]


def test_counts_agree_with_offsets(spark):
    df = spark.createDataFrame([(t,) for t, _ in MATCHES if t], "t string")
    both = df.select(detect.find_matches(F.col("t")).alias("m"), *[rules.count_of(r.name, F.col("t")).alias(r.name) for r in rules.RULES if not r.ocr_only]).collect()
    for row in both:
        for r in rules.RULES:
            if not r.ocr_only:
                assert row[r.name] == sum(m["type"] == r.name for m in row["m"] or []), (row, r.name)


def test_account_only_in_ocr_mode(spark):
    df = spark.createDataFrame([("EB-CA989766",), ("éEB-CA989766",)], "t string")
    rows = df.select(detect.find_matches(F.col("t"), ocr=True).alias("a"), detect.find_matches(F.col("t")).alias("b")).collect()
    assert [[m["type"] for m in r["a"]] for r in rows] == [["account"], ["account"]]
    assert all(not r["b"] for r in rows)


@pytest.mark.parametrize("strict,expected", [
    (False, {"9876543210@ybl": "[PHONE_1][UPI_1]", "4242 4242 4242 4242": "[CARD_1][AADHAAR_1]", "u9876543210@x.com": "[EMAIL_1][PHONE_1]@x.com", "ABC1234567@x.org": "[EMAIL_1][VOTERID_1]@x.org", "a@b.co and a@b.co": "[EMAIL_1] and [EMAIL_1]"}),
    (True, {"9876543210@ybl": "[UPI_1]", "4242 4242 4242 4242": "[CARD_1]", "9876543210@gmail.com": "[EMAIL_1]", "ABC1234567@x.org": "[EMAIL_1]"}),
])
def test_rewriting(spark, strict, expected):
    df = spark.createDataFrame(list(enumerate(expected)), "id int, t string")
    clean, _ = tokens.tokenize(df, "t", ["id"], scope=["id"], strict=strict)
    got = {r["t"]: r["clean"] for r in clean.collect()}
    assert got == expected


def test_mask(spark):
    values = ["jesse@gmail.com", "ab@x.co", "4111 1111 1111 1111", "Rahul Verma", "ABCDE1234F"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(rules.mask_value(F.col("v"), strict=False)).collect()]
    assert got == ["jes***@gmail.com", "a**@x.co", "XXXX XXXX XXXX 1111", "Ra…", "ABCDE1234F"]
    assert df.select(rules.mask_value(F.col("v"))).collect()[4][0] != "ABCDE1234F"


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4242424242424242",), ("4111111111111112",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(rules.luhn_valid(F.col("v"))).collect()] == [True, True, False, False, False]


LABELS = [("Name on card", "name"), ("account", "account"), ("OTP", "password"), ("api-key", "password"), ("Company", "pan"), ("given-name", "name"), ("hotel", "phone"), ("notes", None), ("", None), (None, None), ("cc", "card")]


def test_field_labels(spark):
    df = spark.createDataFrame([(x,) for x, _ in LABELS], "v string")
    assert [r[0] for r in df.select(rules.field_type(F.col("v"))).collect()] == [t for _, t in LABELS]


#: For each rule an address or a title that it fits, and one that only looks like it.
PAGES = [
    ("https://shop.invalid/members/sign-out", "Goodbye", False),
    ("https://shop.invalid/members/signout", "Goodbye", True),
    ("https://shop.invalid/otp?next=1", "Almost there", False),
    ("https://shop.invalid/otp/1", "Almost there", True),
    ("https://shop.invalid/potpourri", "Potpourri", False),
    ("https://shop.invalid/", "Two factor set-up", True),
    ("https://internetbanking.union.invalid/home", "Welcome", True),
    ("https://shop.invalid/payment-page/7", "Thanks", False),
    ("https://shop.invalid/paymentpage/7", "Thanks", True),
    ("https://www.venmo.invalid/", "Friends", True),
    ("https://venmore.invalid/", "Paint", False),
    ("https://kotak.invalid/branches", "Branches", True),
    ("https://vault.invalid/", "Bitwarden for teams", True),
    ("https://office.invalid/forms/passport", "Form 7", True),
    ("https://office.invalid/forms/passports", "Forms", False),
    ("https://docs.invalid/deploy/.env", "Deploying", True),
    ("https://docs.invalid/deploy/.envelope", "Deploying", False),
    ("https://docs.invalid/api_key/rotate", "Keys", True),
    ("https://river-bank.invalid/", "Walks", True),
    ("https://riverbank.invalid/", "Walks", False),
    ("https://my-wallet.wordpress.invalid/", "A blog", False),
    ("not an address", None, False),
    (None, None, False),
]


def test_sensitive_pages(spark):
    df = spark.createDataFrame(PAGES, "u string, t string, e boolean")
    assert [r[0] for r in df.select(urls.sensitive_page(F.col("u"), F.col("t")).isNotNull()).collect()] == [e for *_, e in PAGES]


def test_navigation(spark):
    cases = [("https://a.b/", True), ("/x", True), ("javascript:alert(1)", False), ("data:text/html,x", False), ("file:///etc", False), ("HTTP://a.b", True), ("mailto:a@b.c", False), ("https://", False)]
    df = spark.createDataFrame(cases, "u string, e boolean")
    assert [r[0] for r in df.select(urls.navigation_allowed(F.col("u"))).collect()] == [e for _, e in cases]
    answers = [("yes", False), ("cancel", True), (" Cancel it", True), ("", True), (None, True)]
    df = spark.createDataFrame(answers, "a string, e boolean")
    assert [r[0] for r in df.select(urls.cancelled(F.col("a"))).collect()] == [e for _, e in answers]


def times_in_plan(spark, value, name):
    df = spark.range(1).select(F.col("id").cast("string").alias("t")).select(value.alias("v"))
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(name)


def test_labels_are_cleaned_once(spark):
    assert times_in_plan(spark, rules.field_type(F.col("t")), "regexp_replace") == 1


def test_answers_are_parsed_once(spark):
    value = actions.signature(actions.action_fields(actions.parse_json(F.col("t"))))
    assert times_in_plan(spark, value, "parsejson") <= 2  # bare, else the widest object
