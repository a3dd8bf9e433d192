"""Deterministic inputs derived from the star schema; one text serves Spark and the SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.io import dealt, table

K = "c_custkey"
LETTER = "chr(cast(65 + ({0}) % 26 as int))"
PAD = "lpad(cast(({0}) % {1} as string), {2}, '0')"


def letters(n: int) -> str:
    return ", ".join(LETTER.format(f"{K} * {2 * i + 3} + {7 * i}") for i in range(n))


def pad(expr: str, digits: int) -> str:
    return PAD.format(expr, 10**digits, digits)


LABELS = "Full Name|Email-Address|mobile no|PAN|Aadhaar Number|UPI ID|Voter ID|Passport No|Card Number|Password|one time otp|Company|guest notes|account_no|Postal Code"

KYC = [
    f"{K} as c_custkey",
    "c_nationkey as c_nationkey",
    f"concat({letters(5)}, {pad(K + ' * 7919', 4)}, {LETTER.format(K)}) as pan",
    f"concat(cast(2 + {K} % 8 as string), {pad(K + ' * 31', 3)}, ' ', {pad(K + ' * 7919', 4)}, ' ', {pad(K + ' * 104729', 4)}) as aadhaar",
    f"concat('+91 ', cast(60000 + {K} % 40000 as string), ' ', {pad(K + ' * 7919', 5)}) as phone",
    f"concat(cast(6000000000 + ({K} * 7919) % 1000000000 as string), '@ybl') as upi",
    f"concat({letters(3)}, {pad(K + ' * 7919', 7)}) as voterid",
    f"concat('MH-', {pad(K, 2)}, '-', cast(2000 + {K} % 24 as string), '-', {pad(K + ' * 7919', 7)}) as dl",
    f"concat({LETTER.format(K)}, cast(1 + {K} % 9 as string), {pad(K + ' * 7919', 6)}) as passport",
    f"concat('4111 ', {pad(K + ' * 31', 4)}, ' ', {pad(K + ' * 7919', 4)}, ' ', {pad(K + ' * 104729', 4)}) as card",
    f"concat('EB-CA', {pad(K + ' * 7919', 6)}) as account",
    f"concat('user', cast({K} % 500 as string), '@mail', cast({K} % 7 as string), '.example') as email",
    f"split_part('{LABELS}', '|', cast(1 + {K} % 15 as int)) as label",
]

BOX = [
    "l_orderkey as page",
    "l_linenumber as ord",
    "cast(l_linenumber % 2 as int) as side",
    "case when l_partkey % 3 = 0 then 'face' when l_partkey % 3 = 1 then 'email' else 'card' end as cat",
    "cast((l_partkey * 37) % 400 as int) as x",
    "cast((l_suppkey * 53 + l_linenumber * 97) % 400 as int) as y",
    "cast(20 + (l_partkey * 13) % 260 as int) as w",
    "cast(20 + (l_suppkey * 17) % 280 as int) as h",
]

STEPS = [
    "user_id as run_id",
    "cast(row_number() over (partition by user_id order by ts, event_id) as int) as step",
    "event_id as event_id",
    "ts as ts",
    "event_type as sig",
    "event_type = 'error' as blocked",
    "value as ms",
    "props as props",
]

KYC_SQL = "select " + ", ".join(KYC) + " from customer"
BOX_SQL = "select " + ", ".join(BOX) + " from lineitem"
STEPS_SQL = "select " + ", ".join(STEPS) + " from events"


def kyc(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Identifiers of the customers; ``spread`` over all cores for queries that search them by Python's rules."""
    customers = table(spark, folder, "customer").select(K, "c_nationkey")
    return (dealt(customers, K) if spread else customers).selectExpr(*KYC)


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*BOX)


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*STEPS)
