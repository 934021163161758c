"""The XPath 1.0 function library with its data-model extensions, as ``Column`` builders.

Node-sets local to a row are arrays in document order; numbers are doubles, strings strings, booleans booleans.
Every conversion is total: no function returns NULL for an empty node-set, where XPath has NaN, '' or false.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
_NUMBER = r"\A[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*\z"


# conversions


def number_of_string(s: Column) -> Column:
    """number(): the XPath lexical form only, NaN for anything else (and for no node)."""
    return F.when(F.regexp_like(s, F.lit(_NUMBER)), F.trim(F.translate(s, "\t\r\n", "   ")).cast("double")).otherwise(F.lit(NAN))


def number_of_boolean(b: Column) -> Column:
    return F.coalesce(b.cast("int").cast("double"), F.lit(0.0))


def string_of_number(x: Column) -> Column:
    """string(): whole numbers without a point, no exponents, NaN and ±Infinity by name."""
    x = x.cast("double")
    finite = F.abs(x) < float("inf")
    small = F.when(finite & (F.abs(x) < 1e15), x)
    whole = small == F.floor(small)
    # the digits that Spark's shortest form has, with its exponent carried out
    shown = F.when(finite & ~F.coalesce(whole, F.lit(False)), F.abs(x).cast("string"))
    mantissa, power = F.split_part(shown, F.lit("E"), F.lit(1)), F.coalesce(F.try_to_number(F.nullif(F.split_part(shown, F.lit("E"), F.lit(2)), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    head, tail = F.split_part(mantissa, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), r"0+\z", "")
    digits = F.concat(head, tail)
    point = F.length(head) + power
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, F.lit("0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    return (
        F.when(x.isNull(), "")
        .when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when(whole, small.cast("bigint").cast("string"))
        .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), moved))
    )


def string_of_boolean(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


def string_of_nodes(nodes: Column) -> Column:
    """string() of a node-set: its first node, '' where it is empty."""
    return F.coalesce(F.get(nodes, F.lit(0)), F.lit(""))


def number_of_nodes(nodes: Column) -> Column:
    """number() of a node-set of numbers: its first node, NaN where it is empty."""
    return F.coalesce(F.get(nodes, F.lit(0)).cast("double"), F.lit(NAN))


def boolean_of_number(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x != 0), F.lit(False))


def boolean_of_string(s: Column) -> Column:
    return F.coalesce(F.length(s) > 0, F.lit(False))


def boolean_of_nodes(nodes: Column) -> Column:
    return F.coalesce(F.size(nodes) > 0, F.lit(False))


# logic


def or_(*terms: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in terms])


def and_(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in terms])


def not_(b: Column) -> Column:
    return ~F.coalesce(b, F.lit(False))


# comparison of node-sets: true where some node (or pair) satisfies it


def any_equal(nodes: Column, value: Column) -> Column:
    return F.coalesce(F.exists(nodes, lambda n: F.coalesce(n == value, F.lit(False))), F.lit(False))


def any_unequal(nodes: Column, value: Column) -> Column:
    """Not the negation of ``any_equal``: an empty set is neither."""
    return F.coalesce(F.exists(nodes, lambda n: F.coalesce(n != value, F.lit(False))), F.lit(False))


def any_less(nodes: Column, value: Column) -> Column:
    return F.coalesce(F.array_min(nodes) < value, F.lit(False))


def any_greater(nodes: Column, value: Column) -> Column:
    return F.coalesce(F.array_max(nodes) > value, F.lit(False))


def sets_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def sets_unequal(a: Column, b: Column) -> Column:
    """Some pair differs: both are non-empty and together hold two values."""
    return boolean_of_nodes(a) & boolean_of_nodes(b) & (F.size(F.array_union(a, b)) > 1)


def sets_less(a: Column, b: Column) -> Column:
    """Some pair is in order: the least of one against the greatest of the other."""
    return F.coalesce(F.array_min(a) < F.array_max(b), F.lit(False))


# numbers


def divide(a: Column, b: Column) -> Column:
    """IEEE division: ±Infinity or NaN where ANSI SQL would raise."""
    signed = F.when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(signed)).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def _finite(x: Column, use) -> Column:
    # from 2**53 on every double is whole
    ok = ~F.isnan(x) & (F.abs(x) < float(1 << 53))
    return F.when(ok, use(F.when(ok, x)).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return _finite(x, F.floor)


def ceiling(x: Column) -> Column:
    return _finite(x, F.ceil)


def round_(x: Column) -> Column:
    """Halves go up: -6.5 becomes -6."""
    return _finite(x, lambda v: F.floor(v + 0.5))


def count(nodes: Column) -> Column:
    return F.coalesce(F.size(nodes), F.lit(0)).cast("double")


def sum_(nodes: Column) -> Column:
    return F.aggregate(F.coalesce(nodes, F.array().cast("array<double>")), F.lit(0.0), lambda acc, n: acc + n)


# strings


def _text(s: Column) -> Column:
    """No node is the empty string."""
    return F.coalesce(s, F.lit(""))


def concat(*parts: Column) -> Column:
    if len(parts) < 2:
        raise TypeError("concat() takes two arguments at least")
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def contains(s: Column, part: Column) -> Column:
    return F.contains(_text(s), _text(part))


def starts_with(s: Column, part: Column) -> Column:
    return F.startswith(_text(s), _text(part))


def string_length(s: Column) -> Column:
    return F.length(F.coalesce(s, F.lit(""))).cast("double")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions p with round(start) <= p < round(start) + round(length)."""
    s = _text(s)
    begin = F.rint(start)
    end = begin + F.rint(length) if length is not None else F.lit(float("inf"))
    bad = F.isnan(begin) | F.isnan(end) | (begin == float("inf"))
    n = F.length(s).cast("double")
    first = F.greatest(begin, F.lit(1.0))
    last = F.least(end, n + 1)
    ok = ~bad & (last > first)
    at = F.when(ok, first).cast("int")
    return F.when(ok, F.substr(s, at, F.when(ok, last - first).cast("int"))).otherwise("")


def substring_before(s: Column, part: Column) -> Column:
    s, part = _text(s), _text(part)
    at = F.call_function("instr", s, part)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise("")


def substring_after(s: Column, part: Column) -> Column:
    s, part = _text(s), _text(part)
    at = F.call_function("instr", s, part)
    return F.when(at > 0, F.substr(s, at + F.length(part))).otherwise("")


def translate(s: Column, source: str, target: str) -> Column:
    """Characters of ``source`` become those of ``target``; the surplus ones are deleted."""
    return F.translate(_text(s), source, target)


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(_text(s), r"[ \t\r\n]+", " "))


#: Characters of XML names, beside ASCII letters, ``_`` and ``:``; and those that may follow the first.
NAME_START = (
    r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}"
    r"\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME_REST = r"\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
CLASSES = {"i": f"_:A-Za-z{NAME_START}", "c": rf"\-._:A-Za-z0-9{NAME_START}{NAME_REST}", "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{S}", "s": r" \t\n\r"}


class InvalidPattern(ValueError):
    """A pattern that is no XSD regular expression."""


def xsd_pattern(pattern: str) -> str:
    """An XSD pattern as an anchored Java one.

    ``.`` excludes line ends only; ``\\i``, ``\\c``, ``\\d``, ``\\w``, ``\\s`` and their negations are the classes of XML;
    ``\\p{Is...}`` names a block of Unicode.
    """
    out, in_class, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in "pP" and pattern[i + 2 : i + 5] == "{Is":
                out.append(f"\\{n}{{In")
                i += 5
                continue
            if n.lower() in CLASSES:
                chars = CLASSES[n.lower()]
                out.append(f"[^{chars}]" if n.isupper() else chars if in_class else f"[{chars}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]":
            in_class -= 1
        if in_class and c == "-" and pattern[i + 1 : i + 2] == "[":  # subtraction
            out.append("&&[^")
            in_class += 1
            # what is taken away may itself be a negated class
            negated = pattern[i + 2 : i + 3] == "^"
            if negated:
                out[-1] = "&&["
            i += 3 if negated else 2
            continue
        if c == "." and not in_class:
            out.append(r"[^\n\r]")
        elif c in "^$" and not in_class:
            out.append("\\" + c)
        elif c == "&" and in_class:
            out.append(r"\&")
        else:
            out.append(c)
        i += 1
    return rf"\A(?:{''.join(out)})\z"


def re_match(s: Column, pattern: str) -> Column:
    """Whether a string matches an XSD pattern as a whole; one that is no pattern raises ``InvalidPattern`` here."""
    own = xsd_pattern(pattern)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(own)
        except Exception as e:
            raise InvalidPattern(pattern) from e
    return F.coalesce(F.regexp_like(s, F.lit(own)), F.lit(False))


# extensions of the data model


def bit_is_set(bits: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(bits, name), F.lit(False))


def enum_value(label: Column, values: dict[str, int]) -> Column:
    """The number of an enum label; NaN for anything else."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, label), F.lit(NAN))


def derived_from(identity: Column, base: str, closure: dict[str, set[str]], or_self: bool = False) -> Column:
    """Whether an identity is derived from ``base``; ``closure`` maps each identity to all its ancestors."""
    below = sorted(k for k, up in closure.items() if base in up) + ([base] if or_self else [])
    return F.coalesce(identity.isin(*below), F.lit(False)) if below else F.lit(False)


# positions in a node-set


def at_position(nodes: Column, n: int) -> Column:
    """``nodes[n]``: one node or none."""
    return F.slice(nodes, n, 1) if n > 0 else F.slice(nodes, 1, 0)


def last(nodes: Column) -> Column:
    return F.slice(nodes, -1, 1)


def preceding(nodes: Column, n: int) -> Column:
    """Siblings before the n-th, nearest first."""
    return F.reverse(F.slice(nodes, 1, max(0, n - 1)))


def following(nodes: Column, n: int) -> Column:
    return F.slice(nodes, n + 1, F.greatest(F.size(nodes) - n, F.lit(0)))


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)
