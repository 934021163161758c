"""The XPath and type libraries, value by value."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.functions import xpath as xp

NAN = float("nan")
INF = float("inf")


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(**columns):
        return one.select(*[c.alias(k) for k, c in columns.items()]).first().asDict()

    return get


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def check(value, table):
    got = value(**{f"x{i}": c for i, (c, _) in enumerate(table)})
    for i, (_, want) in enumerate(table):
        assert same(got[f"x{i}"], want), (i, got[f"x{i}"], want)


L = F.lit


def test_numbers(value):
    check(
        value,
        [
            (xp.round_(L(-6.5)), -6.0),
            (xp.round_(L(2.5)), 3.0),
            (xp.round_(L(NAN)), NAN),
            (xp.floor(L(-INF)), -INF),
            (xp.ceiling(L(2.1)), 3.0),
            (xp.modulo(L(-5.0), L(2.0)), -1.0),
            (xp.modulo(L(5.0), L(-2.0)), 1.0),
            (xp.modulo(L(5.0), L(0.0)), NAN),
            (xp.divide(L(1.0), L(0.0)), INF),
            (xp.divide(L(-1.0), L(0.0)), -INF),
            (xp.divide(L(0.0), L(0.0)), NAN),
            (xp.divide(L(7.0), L(2.0)), 3.5),
            (xp.sum_(F.array(L(1.5), L(2.5))), 4.0),
            (xp.sum_(L(None).cast("array<double>")), 0.0),
            (xp.count(L(None).cast("array<string>")), 0.0),
        ],
    )


def test_conversions(value):
    check(
        value,
        [
            (xp.number_of_string(L(" 12.50 ")), 12.5),
            (xp.number_of_string(L("1e3")), NAN),
            (xp.number_of_string(L("inf")), NAN),
            (xp.number_of_string(L("")), NAN),
            (xp.number_of_string(L(None).cast("string")), NAN),
            (xp.string_of_number(L(3.0)), "3"),
            (xp.string_of_number(L(-0.0)), "0"),
            (xp.string_of_number(L(2.5)), "2.5"),
            (xp.string_of_number(L(NAN)), "NaN"),
            (xp.string_of_number(L(-INF)), "-Infinity"),
            (xp.string_of_boolean(L(True)), "true"),
            (xp.boolean_of_number(L(NAN)), False),
            (xp.boolean_of_string(L("")), False),
            (xp.boolean_of_string(L("false")), True),
            (xp.string_of_nodes(F.array().cast("array<string>")), ""),
            (xp.number_of_nodes(F.array().cast("array<double>")), NAN),
            (xp.not_(L(None).cast("boolean")), True),
        ],
    )


def test_strings(value):
    check(
        value,
        [
            (xp.substring(L("12345"), L(2.0), L(3.0)), "234"),
            (xp.substring(L("12345"), L(1.5), L(2.6)), "234"),
            (xp.substring(L("12345"), L(0.0), L(3.0)), "12"),
            (xp.substring(L("12345"), L(-42.0), L(INF)), "12345"),
            (xp.substring(L("12345"), L(NAN), L(3.0)), ""),
            (xp.substring(L("12345"), L(4.0)), "45"),
            (xp.substring_before(L("1999/04/01"), L("/")), "1999"),
            (xp.substring_after(L("1999/04/01"), L("/")), "04/01"),
            (xp.substring_after(L("abc"), L("x")), ""),
            (xp.translate(L("--abcd--"), "abc-", "ABC"), "ABCd"),
            (xp.normalize_space(L("  a \t b\n")), "a b"),
            (xp.string_length(L("a😀")), 2.0),
            (xp.re_match(L("a-1"), r"[a-z-[b]]-\d"), True),
            (xp.re_match(L("b-1"), r"[a-z-[b]]-\d"), False),
            (xp.re_match(L("ab\n"), "ab"), False),
            (xp.re_match(L("x^y"), "x^y"), True),
        ],
    )


def test_node_sets(value):
    nums, none = F.array(L(1.0), L(5.0)), F.array().cast("array<double>")
    check(
        value,
        [
            (xp.any_equal(nums, L(5.0)), True),
            (xp.any_unequal(nums, L(5.0)), True),
            (xp.any_unequal(none, L(5.0)), False),
            (xp.any_less(nums, L(2.0)), True),
            (xp.any_greater(none, L(2.0)), False),
            (xp.sets_less(nums, F.array(L(0.0), L(2.0))), True),
            (xp.sets_unequal(F.array(L(1.0)), F.array(L(1.0))), False),
            (xp.sets_equal(nums, F.array(L(5.0))), True),
            (F.size(xp.at_position(nums, 3)), 0),
            (F.size(xp.preceding(nums, 2)), 1),
            (xp.bit_is_set(F.array(L("a")), "b"), False),
            (xp.enum_value(L("x"), {"y": 1}), NAN),
            (xp.derived_from(L("leaf"), "root", {"leaf": {"mid", "root"}, "mid": {"root"}, "root": set()}), True),
            (xp.derived_from(L("root"), "root", {"leaf": {"root"}, "root": set()}), False),
            (xp.derived_from(L("root"), "root", {"root": set()}, or_self=True), True),
        ],
    )
    with pytest.raises(TypeError):
        xp.concat(L("a"))


def raw(text):
    return F.parse_json(L(text))


def test_types(value):
    T = ty.Type
    dec = T("decimal64", digits=2)
    flags = T("bits", bits=ty.bits("un", "dos", ("cuatro", 3)))
    either = T("union", members=(T("uint8", ranges=((0, 50),)), T("boolean")))
    check(
        value,
        [
            (ty.decode(raw("300"), T("int8")), Decimal(300)),
            (ty.valid(ty.decode(raw("300"), T("int8")), T("int8")), False),
            (ty.decode(raw("1e2"), T("int32")), None),
            (ty.decode(raw("true"), T("int32")), None),
            (ty.decode(raw('"5"'), T("int32")), None),
            (ty.decode(raw('"18446744073709551615"'), T("uint64")), Decimal(2**64 - 1)),
            (ty.valid(ty.decode(raw('"18446744073709551616"'), T("uint64")), T("uint64")), False),
            (ty.decode(raw("5"), T("int64")), None),
            (ty.canon(ty.parse(L("-0.00"), dec), dec), "0.0"),
            (ty.canon(ty.parse(L("1.50"), dec), dec), "1.5"),
            (ty.canon(ty.parse(L("7"), dec), dec), "7.0"),
            (ty.canon(ty.parse(L("0.125"), dec), dec), "0.12"),
            (ty.parse(L("yes"), T("boolean")), None),
            (ty.decode(raw("[null]"), T("empty")), True),
            (ty.valid(L("abc"), T("string", ranges=((1, 2), (4, None)))), False),
            (ty.valid(L("abc"), T("string", patterns=("[a-c]*",), not_patterns=("abc",))), False),
            (ty.valid(L(None).cast("string"), T("string")), False),
            (ty.canon(ty.parse(L(" cuatro  dos "), flags), flags), "dos cuatro"),
            (ty.bits_value(ty.parse(L("dos cuatro"), flags), flags), 10),
            (ty.valid(ty.parse(L("dos tres"), flags), flags), False),
            (ty.decode(raw("51"), either), None),
            (ty.decode(raw("true"), either), "true"),
            (ty.identity_ref(L("x"), "m"), "m:x"),
            (ty.canon(ty.parse(L("aGk="), T("binary")), T("binary")), "aGk="),
            (ty.parse(L("a*"), T("binary")), None),
        ],
    )
    assert ty.enums("a", ("b", 100), "c") == (("a", 0), ("b", 100), ("c", 101))
    with pytest.raises(ValueError):
        ty.restrict(ty.enums("a"), {"z"})
    up = ty.closure({"a": [], "b": ["a"], "c": ["b"], "d": ["a", "c"]})
    assert up["d"] == {"a", "b", "c"} and ty.derived_from_all(["a", "c"], up) == {"d"}
