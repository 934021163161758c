"""Scalar types of the data model: decode from VARIANT, check, canonical form and encode, all as Columns.

``decode`` gives NULL for values of the wrong JSON kind; ``valid`` judges decoded values; ``canon`` is the canonical
string.  Integers are decoded wide, so a number out of range is a type error, not a decode error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import xpath

#: Bounds of the integer types.
BOUNDS = {
    **{f"int{b}": (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64)},
    **{f"uint{b}": (0, 2**b - 1) for b in (8, 16, 32, 64)},
}


@dataclass(frozen=True)
class Type:
    """A built-in type with its restrictions."""

    base: str
    ranges: tuple[tuple, ...] = ()  # of numbers, or of lengths for string and binary
    patterns: tuple[str, ...] = ()
    not_patterns: tuple[str, ...] = ()
    digits: int = 2
    enums: tuple[tuple[str, int], ...] = ()
    bits: tuple[tuple[str, int], ...] = ()
    identities: tuple[str, ...] = ()
    members: tuple[Type, ...] = ()
    error_tag: str = "invalid-type"
    error_message: str | None = None
    default: object = None
    name: str | None = None

    def derive(self, name: str, **restrictions) -> Type:
        """A type of its own name with further restrictions; ranges and patterns may be given, labels only be taken away."""
        for kind in ("enums", "bits"):
            if kind in restrictions:
                restrictions[kind] = restrict(getattr(self, kind), {k if isinstance(k, str) else k[0] for k in restrictions[kind]})
        if "patterns" in restrictions:
            restrictions["patterns"] = self.patterns + tuple(restrictions["patterns"])
        if isinstance(restrictions.get("ranges"), str):
            restrictions["ranges"] = intervals(restrictions["ranges"], self)
        return replace(self, name=name, **restrictions)

    def digest(self) -> dict:
        """What a client needs to know of the type."""
        out: dict = {"base": self.base}
        if self.name:
            out["derived"] = self.name
        if self.base == "decimal64":
            out["fraction-digits"] = self.digits
        for key, value in (("range" if self.base in BOUNDS or self.base == "decimal64" else "length", [[None if x is None else str(x) for x in r] for r in self.ranges]), ("patterns", list(self.patterns)), ("neg-patterns", list(self.not_patterns))):
            if value:
                out[key] = value
        for key, pairs in (("enums", self.enums), ("bits", self.bits)):
            if pairs:
                out[key] = [k for k, _ in by_number(pairs)]
        if self.members:
            out["union"] = [m.digest() for m in self.members]
        return out

    def sql(self) -> str:
        """The Spark type of decoded values."""
        if self.base in BOUNDS:
            return "decimal(38,0)"
        kinds = {"decimal64": f"decimal(38,{self.digits})", "binary": "binary", "boolean": "boolean", "bits": "array<string>", "empty": "boolean"}
        return kinds.get(self.base, "string")


def enums(*labels: str | tuple[str, int]) -> tuple[tuple[str, int], ...]:
    """Labels with their numbers: a stated one, or one more than the highest so far."""
    out: list[tuple[str, int]] = []
    for x in labels:
        name, value = x if isinstance(x, tuple) else (x, max([v for _, v in out], default=-1) + 1)
        out.append((name, value))
    return tuple(out)


bits = enums


def by_number(pairs: tuple[tuple[str, int], ...]) -> list[tuple[str, int]]:
    """Enum labels or bits in the order of their numbers."""
    return sorted(pairs, key=lambda p: p[1])


def intervals(text: str, kind: Type) -> tuple[tuple, ...]:
    """``"1..4 | 10 | 20..max"`` as ranges; ``min`` and ``max`` are the bounds of the type, or of its own ranges."""
    low, high = (kind.ranges[0][0], kind.ranges[-1][1]) if kind.ranges else BOUNDS.get(kind.base, (0 if kind.base in ("string", "binary") else None, None))

    def bound(s: str):
        s = s.strip()
        if s in ("min", "max"):
            return low if s == "min" else high
        return Decimal(s) if kind.base == "decimal64" else int(s, 0)

    out = []
    for part in text.split("|"):
        ends = part.split("..")
        out.append((bound(ends[0]), bound(ends[-1])))
    if any(b is not None and c is not None and b >= c for (_, b), (c, _) in zip(out, out[1:], strict=False)):
        raise ValueError(f"intervals overlap or are out of order: {text}")
    return tuple(out)


def default_integer(text: str) -> int:
    """An integer as a model writes defaults: decimal, ``0x`` hexadecimal or octal with a leading 0."""
    sign, digits = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if digits[:2].lower() == "0x":
        return sign * int(digits, 16)
    return sign * int(digits, 8 if len(digits) > 1 and digits[0] == "0" else 10)


def restrict(base: tuple[tuple[str, int], ...], keep: set[str]) -> tuple[tuple[str, int], ...]:
    """The labels of a derived enumeration or bits type; values stay."""
    if unknown := keep - {k for k, _ in base}:
        raise ValueError(f"not in the base type: {sorted(unknown)}")
    return tuple((k, v) for k, v in base if k in keep)


def within(x: Column, ranges: tuple[tuple, ...]) -> Column:
    """Whether x is in one of the intervals; None is an open end."""
    bound = lambda n: F.lit(Decimal(n) if isinstance(n, int) else n)
    one = lambda lo, hi: (F.lit(True) if lo is None else x >= bound(lo)) & (F.lit(True) if hi is None else x <= bound(hi))
    return reduce(lambda a, b: a | b, [one(lo, hi) for lo, hi in ranges])


def decode(v: Column, t: Type) -> Column:
    """A VARIANT as a value of the type; NULL for another JSON kind."""
    kind = F.schema_of_variant(v)
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    if t.base in ("int64", "uint64"):
        return parse(text, t)
    if t.base in BOUNDS:
        whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
        return F.when(whole, F.try_variant_get(v, "$", "decimal(38,0)"))
    if t.base == "boolean":
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    if t.base == "empty":
        return F.when(F.to_json(v) == "[null]", F.lit(True))
    if t.base == "union":
        return F.coalesce(*[F.when(valid(decode(v, m), m), canon(decode(v, m), m)) for m in t.members])
    return parse(text, t)


def parse(s: Column, t: Type) -> Column:
    """A lexical value (XML text, key, default) as a value of the type; NULL where it has no such form."""
    if t.base in BOUNDS:
        return F.when(F.regexp_like(s, F.lit(r"\A[+-]?[0-9]{1,38}\z")), s.try_cast("decimal(38,0)"))
    if t.base == "decimal64":
        return F.when(F.regexp_like(s, F.lit(r"\A[+-]?[0-9]+(\.[0-9]+)?\z")), F.bround(s.try_cast(f"decimal(38,{min(18, t.digits + 6)})"), t.digits).cast(f"decimal(38,{t.digits})"))
    if t.base == "binary":
        return F.try_to_binary(s, F.lit("base64"))
    if t.base == "boolean":
        return F.when(s == "true", True).when(s == "false", False)
    if t.base == "bits":
        return F.filter(F.split(F.trim(s), r"\s+"), lambda b: b != "")
    if t.base == "empty":
        return F.when(s == "", True)
    if t.base == "instance-identifier":
        return canonical_instance_id(s)
    if t.base == "union":
        return F.coalesce(*[F.when(valid(parse(s, m), m), canon(parse(s, m), m)) for m in t.members])
    return s


def canonical_instance_id(text: Column) -> Column:
    """An instance identifier with single quotes and without blanks, as ``entry_path`` writes it; NULL where it is none."""
    name = r"(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*"
    pick = rf"""\[\s*(?:[0-9]+|(?:\.|{name})\s*=\s*(?:'[^']*'|"(?:[^"\\]|\\.)*"))\s*\]"""
    sound = F.regexp_like(text, F.lit(rf"\A(?:/{name}(?:{pick})*)+\z"))
    bare = F.regexp_replace(F.regexp_replace(text, r"\[\s+", "["), r"""(?<=['"0-9])\s+\]""", "]")
    bare = F.regexp_replace(bare, rf"""\[(\.|{name})\s*=\s*(['"])""", "[$1=$2")
    return F.when(sound, F.regexp_replace(bare, r"""="([^'"\\]*)"\]""", "='$1']"))


def normal_instance_id(text: Column, own: str = "") -> Column:
    """A canonical identifier as paths of nodes are written: a step names its module where that is not its parent's, keys name none.

    ``own`` is the module of the document's root.
    """
    step = r"""/(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*(?:\[[^'"\]]*(?:'[^']*'|"(?:[^"\\]|\\.)*")?\])*"""
    steps = F.regexp_extract_all(text, F.lit(f"({step})"), 1)
    start = F.struct(F.lit(own).alias("ns"), F.lit("").alias("out"))
    pick = r"""\[(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*|\.)=('[^']*'|"(?:[^"\\]|\\.)*")\]"""

    def add(acc: Column, one: Column) -> Column:
        ns = F.regexp_extract(one, r"^/([A-Za-z_][\w.-]*):", 1)
        bare = F.regexp_replace(F.regexp_replace(one, r"^/[A-Za-z_][\w.-]*:", "/"), pick, "[$1=$2]")
        kept = F.when((ns == "") | (ns == acc["ns"]), bare).otherwise(F.concat(F.lit("/"), ns, F.lit(":"), F.substr(bare, F.lit(2))))
        return F.struct(F.when(ns == "", acc["ns"]).otherwise(ns).alias("ns"), F.concat(acc["out"], kept).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(steps, start, add)["out"])


def valid(x: Column, t: Type) -> Column:
    """Whether a decoded value is in the type; never NULL."""
    if t.base in BOUNDS or t.base == "decimal64":
        ok = within(x, (BOUNDS[t.base],)) if t.base in BOUNDS else F.abs(x) < F.lit(Decimal(10 ** (19 - t.digits))).cast("decimal(38,0)")
        ok = ok & within(x, t.ranges) if t.ranges else ok
    elif t.base in ("string", "binary"):
        size = F.length(x) if t.base == "string" else F.octet_length(x)
        ok = within(size, t.ranges) if t.ranges else x.isNotNull()
        for p in t.patterns:
            ok = ok & xpath.re_match(x, p)
        for p in t.not_patterns:
            ok = ok & ~xpath.re_match(x, p)
    elif t.base == "enumeration":
        ok = x.isin(*[k for k, _ in t.enums])
    elif t.base == "bits":
        ok = F.forall(x, lambda b: b.isin(*[k for k, _ in t.bits])) & (F.size(F.array_distinct(x)) == F.size(x))
    elif t.base == "identityref":
        ok = x.isin(*t.identities) if t.identities else F.lit(False)
    else:
        ok = x.isNotNull()
    return F.coalesce(ok, F.lit(False))


def canon(x: Column, t: Type) -> Column:
    """The canonical string of a decoded value."""
    if t.base == "decimal64":
        plain = F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(F.when(F.instr(x.cast("string"), ".") > 0, plain).otherwise(F.concat(x.cast("string"), F.lit(".0"))), r"\.$", ".0")
    if t.base == "binary":
        return F.base64(x)
    if t.base == "boolean":
        return F.when(x, "true").when(~x, "false")
    if t.base == "bits":
        in_order = [F.when(F.array_contains(x, k), F.lit(k)) for k, _ in sorted(t.bits, key=lambda b: b[1])]
        return F.when(x.isNotNull(), F.array_join(F.array_compact(F.array(*in_order)), " "))
    if t.base == "empty":
        return F.when(x, "")
    return x.cast("string")


def bits_value(x: Column, t: Type) -> Column:
    """Bits as a number: the sum of two to the power of each position."""
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(x, k), F.lit(1 << p)).otherwise(F.lit(0)).cast("bigint") for k, p in t.bits])


def encode(x: Column, t: Type) -> Column:
    """A decoded value as its raw JSON kind: numbers up to 32 bits, booleans, otherwise strings."""
    if t.base in BOUNDS and t.base not in ("int64", "uint64"):
        return x.cast("bigint")
    if t.base == "boolean":
        return x
    if t.base == "empty":
        return F.when(x, F.array(F.lit(None).cast("string")))
    if t.base == "union":  # in the encoding of the first member that holds the value
        return F.coalesce(*[F.when(valid(parse(x, m), m), encode(parse(x, m), m).cast("variant")) for m in t.members])
    return canon(x, t)


def resolve_name(text: str, prefixes: dict[str, str], own: str) -> tuple[str, str]:
    """(module, name) of ``prefix:name``, or of a name of one's own module."""
    prefix, _, name = text.rpartition(":")
    if prefix and prefix not in prefixes:
        raise KeyError(f"unknown prefix in {text}")
    return (prefixes[prefix] if prefix else own), name


def identity_ref(s: Column, default_ns: str) -> Column:
    """The canonical ``module:name`` of an identity reference."""
    return F.when(F.instr(s, ":") > 0, s).otherwise(F.concat(F.lit(default_ns + ":"), s))


def closure(bases: dict[str, list[str]]) -> dict[str, set[str]]:
    """All ancestors of each identity; the graph is metadata of the model."""
    out: dict[str, set[str]] = {}

    def up(name: str) -> set[str]:
        if name not in out:
            out[name] = set()
            out[name] = set(bases.get(name, ())).union(*[up(b) for b in bases.get(name, ())])
        return out[name]

    for name in bases:
        up(name)
    return out


def derived_from_all(bases: list[str], up: dict[str, set[str]]) -> set[str]:
    """Identities derived from every one of ``bases``: the values of an identityref."""
    return {k for k, v in up.items() if set(bases) <= v}
