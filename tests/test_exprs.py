import pytest
from pyspark.sql import functions as F

from keyloom.functions import exprs as X


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"), [("0", 0), ("-0", 0), ("007", None), ("+5", None), (" 5", None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("", None)]
)
def test_canonical_int(spark, text, want):
    assert one(spark, X.canonical_int("x"), x=text) == want


@pytest.mark.parametrize(("text", "want"), [("inf", float("inf")), ("-inf", float("-inf")), ("nan", None), ("1e3", 1000.0), (" 1", None), (".5", 0.5), ("abc", None)])
def test_parse_score(spark, text, want):
    assert one(spark, X.parse_score("x"), x=text) == want


@pytest.mark.parametrize(
    ("value", "want"), [(3.0, "3"), (1.0e7, "10000000"), (-0.0, "0"), (0.1, "0.1"), (-2.5, "-2.5"), (1.5e-7, "0.00000015"), (1.25e20, "125000000000000000000"), (float("inf"), "inf"), (123456.789, "123456.789")]
)
def test_human_double(spark, value, want):
    assert one(spark, X.human_double("x"), x=value) == want


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [("k?sta", "kasta", True), ("k*a", "ka", True), ("k[^u]rv", "kurv", False), ("k[s-v]rv", "kurv", True), ("k\\*a", "k*a", True), ("k\\*a", "kza", False), ("x.z", "xyz", False), ("sol*", "solig", True), ("sol", "solig", False), ("*", "", True), ("[]", "q", False)],
)
def test_glob(spark, pattern, text, want):
    assert one(spark, X.glob_match("x", pattern), x=text) is want


@pytest.mark.parametrize(("start", "stop", "want"), [(0, -1, (0, 4)), (-3, -2, (2, 3)), (3, 1, None), (-100, 100, (0, 4)), (5, 9, None), (0, -9, None)])
def test_resolve_range(spark, start, stop, want):
    lo, hi = X.resolve_range(start, stop, "n")
    got = one(spark, F.struct(F.lit(lo) if isinstance(lo, int) else lo, hi), n=5)
    assert (tuple(got) if got[0] <= got[1] else None) == want


def test_slots(spark):
    assert one(spark, X.crc16("x"), x="123456789") == 0x31C3  # the check value of the published algorithm
    assert one(spark, X.key_slot("x"), x="{cart9}:lines") == one(spark, X.key_slot("x"), x="total:{cart9}") == one(spark, X.key_slot("x"), x="cart9")
    assert one(spark, X.hash_tag("x"), x="a{}{b}") == "a{}{b}"
    assert one(spark, X.hash_tag("x"), x="a{{b}}c") == "{b"
    assert one(spark, X.key_slot("x"), x="") == 0
    assert one(spark, X.fnv1a("x"), x="") == 0xCBF29CE484222325 - 2**64 and one(spark, X.fnv1a("x"), x="a") == 0xAF63DC4C8601EC8C - 2**64


def test_murmur():
    assert X.murmur64(b"") == X.murmur64(b"") and X.murmur64(b"a") != X.murmur64(b"b")
    assert X.murmur64(b"12345678", 0) != X.murmur64(b"1234567", 0)
