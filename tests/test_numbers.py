"""Keys of different numeric types: equal numbers have one normal form."""

from __future__ import annotations

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof import key_overlap
from dataproof.functions.numbers import numeric_key


def normal(number: Decimal) -> str:
    sign, digits, exponent = number.as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    kept = digits.rstrip("0")
    return f"{'-' * sign}{kept}e{exponent + len(digits) - len(kept)}" if kept else "0"


def test_doubles(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1e17, 1e18, 2.0**60, 1e20, 1e-7, -1e-7, 0.1, 1e22, 1e23, 9.999e37, 1e38, 1.7e308, 2.0**53 + 2, -(2.0**64), 2.0**63, 2e-3]
    numbers += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1500)]
    numbers += [float(rng.getrandbits(rng.randrange(1, 126))) * rng.choice([1, -1]) for _ in range(1500)]
    numbers = [x for x in numbers if math.isfinite(x) and abs(x) > 1e-300 or x == 0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for x, (key,) in zip(numbers, df.select(numeric_key(F.col("x"), T.DoubleType())).collect()):
        whole = abs(x) < 1e38 and x == int(x)
        assert key == normal(Decimal(int(x)) if whole else Decimal(repr(x))), x
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -float("inf"), None, 5e-324, 1e-323)], "x double")
    keys = [key for (key,) in odd.select(numeric_key(F.col("x"), T.DoubleType())).collect()]
    assert keys[3] is None and len(set(keys)) == 6


def test_exact_types(spark):
    texts = ["0", "-0.10", "1000000", "123456789012345678.0000000001", "0.0000001", "-99999999999999999999999999", "1e20"]
    df = spark.createDataFrame([(Decimal(x),) for x in texts], "x decimal(38,10)")
    assert [k for (k,) in df.select(numeric_key(F.col("x"), T.DecimalType(38, 10))).collect()] == [normal(Decimal(x)) for x in texts]
    whole = [0, -1, 100, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in whole], "x bigint")
    assert [k for (k,) in df.select(numeric_key(F.col("x"), T.LongType())).collect()] == [normal(Decimal(x)) for x in whole]


@pytest.mark.parametrize(
    ("left", "right", "both"),
    [
        ("CAST(100000000000000000 AS BIGINT)", "1e17D", 1),
        ("CAST(1000000000000000000 AS BIGINT)", "1e18D", 1),
        ("CAST(1152921504606846976 AS BIGINT)", "CAST(1152921504606846976 AS DOUBLE)", 1),
        ("CAST(1152921504606846977 AS BIGINT)", "CAST(1152921504606846976 AS DOUBLE)", 0),
        ("CAST('100000000000000000000' AS DECIMAL(38,0))", "1e20D", 1),
        ("CAST('100000000000000000001' AS DECIMAL(38,0))", "1e20D", 0),
        ("CAST('0.0000001' AS DECIMAL(38,10))", "1e-7D", 1),
        ("CAST('0.1' AS DECIMAL(38,30))", "0.1D", 1),
        ("CAST(0.1 AS FLOAT)", "0.1D", 0),
        ("CAST(0.5 AS FLOAT)", "CAST('0.50' AS DECIMAL(5,2))", 1),
        ("CAST(0 AS BIGINT)", "-0.0D", 1),
        ("-0.0D", "0.0D", 1),
        ("CAST('NaN' AS DOUBLE)", "CAST('NaN' AS FLOAT)", 1),
        ("CAST('NaN' AS DOUBLE)", "CAST(0 AS BIGINT)", 0),
        ("5e-324D", "CAST(0 AS BIGINT)", 0),
        ("5e-324D", "5e-324D", 1),
        ("CAST('12345678901234567890123456789.123456789' AS DECIMAL(38,9))", "CAST('12345678901234567890123456789.1234567890' AS DECIMAL(38,9))", 1),
        ("CAST('1234567890123456789012345678901234567.1' AS DECIMAL(38,1))", "CAST('0.1234567890123456789' AS DECIMAL(38,37))", 0),
        ("CAST('1.5' AS DECIMAL(38,1))", "CAST('1.5' AS DECIMAL(38,37))", 1),
        ("CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", 1),
    ],
)
def test_pairs_of_types(spark, left, right, both):
    a, b = (spark.sql(f"SELECT {x} AS k FROM range(3)") for x in (left, right))
    for sides in ((a, b), (b, a)):
        assert tuple(key_overlap(*sides, ["k"]).drop("keys").first()) == (1, 1, both)
