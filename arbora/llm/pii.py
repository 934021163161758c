"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

``find_pii(df)`` adds ``spans``, an array of (kind, start, end, score) in code points.

* ``email``, ``ip``, ``card`` and ``phone`` are base kinds: leftmost and non-overlapping per kind, candidates that
  fail their check (octets, Luhn, number of digits) are dropped and not tried again.  They always stay; context
  only moves their score.
* ``iban`` (mod-97) and ``ssn`` (needs a context word) are added by the method where the score reaches
  ``min_score``.

Nulls and empty texts have no spans.  Repeated rows and rows with equal ids are handled one by one; empty tables
give empty results; other columns pass through, and a column of the input that is called as the result (``into``) is
replaced.  Context words count as whole words only, within ``CONTEXT_CHARS`` characters on either side.
Every pattern runs in linear time, so very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in their fixed order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

# A run of address characters without a domain is consumed too, so no start inside it is tried again.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?", re.ASCII)
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?", re.ASCII)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++", re.ASCII)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]", re.ASCII)
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)
_SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
_DIGIT = re.compile("[0-9]")

#: Context words: fixed values.
CONTEXT = {
    "email": ("email", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
_CONTEXT = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.IGNORECASE | re.ASCII) for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind and then by start."""
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if "@" in m[0]:
                yield "email", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if "." in m[0] and all(map(_octet, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def has_context(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a context word of the kind stands, as a word, near the span."""
    # one character more on each side shows whether a word goes on beyond the window
    first = max(0, start - CONTEXT_CHARS - 1)
    if _CONTEXT[kind].search(text[first:start], 1 if start > CONTEXT_CHARS else 0):
        return True
    return any(m.end() <= CONTEXT_CHARS for m in _CONTEXT[kind].finditer(text[end : end + CONTEXT_CHARS + 1]))


def score_span(text: str, kind: str, start: int, end: int) -> float:
    return min(1.0, PRIOR[kind] + CONTEXT_BONUS * has_context(text, kind, start, end))


def spans_of(text: str | None, min_score: float = 0.5) -> list[dict]:
    """Spans of one text; a null has none."""
    found = []
    for kind, start, end in _proposals(text or ""):
        score = score_span(text, kind, start, end)
        if kind in BASE_KINDS or score >= min_score:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


def find_pii(df: DataFrame, text: str = "text", min_score: float = 0.5, into: str = "spans") -> DataFrame:
    """``df`` with the spans of each text."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t, min_score) for t in texts], index=texts.index, dtype=object)

    return df.withColumn(into, spans(F.col(text)))


def digest_spans(df: DataFrame) -> DataFrame:
    """doc_id with counts, ``base_sha256`` and ``spans`` as text, from the output of ``find_pii``."""

    def joined(keep):
        parts = F.transform(F.filter("spans", keep) if keep else F.col("spans"), lambda s: F.concat_ws(":", s.kind, s.start, s.end))
        return F.array_join(parts, ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return df.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(lambda s: s.kind.isin(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(None).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Replace each span of ``text`` by ``[KIND]``; overlapping spans become one, named after the first.  Null stays null."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(t):
            found = spans_of(t, min_score) if t else []
            if not found:
                return t
            out, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return texts.map(one)

    return df.withColumn(text, cleaned(F.col(text)))


def reference_digest(text: str | None) -> tuple:
    """Brute force with the plain patterns, for tests: counts and hash of the base spans."""
    text = text or ""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out: dict[str, list[str]] = {}
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind](m, digits)
            if ok:
                out.setdefault(kind, []).append(f"{kind}:{m.start()}:{m.end()}")
    joined = ",".join(x for k in BASE_KINDS for x in out.get(k, []))
    return (*[len(out.get(k, [])) for k in BASE_KINDS], hashlib.sha256(joined.encode()).hexdigest())


def _sql() -> str:
    """The same rows by plain patterns: pieces between matches give their places."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": _IBAN.pattern,
        "ssn": _SSN.pattern,
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[-i] AS INT) WHEN CAST({digits}[-i] AS INT) > 4 THEN 2 * CAST({digits}[-i] AS INT) - 9 ELSE 2 * CAST({digits}[-i] AS INT) END))"
    iban = "replace(m, ' ', '')"
    values = f"list_transform(string_split({iban}[5:] || {iban}[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    rest = f"list_reduce(list_prepend(0, {values}), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
    words = "|".join(CONTEXT["ssn"])
    near = rf"""regexp_matches(x[greatest(1, beg - {CONTEXT_CHARS}):beg], CASE WHEN beg > {CONTEXT_CHARS} THEN '(?is)^.+?\b(?:{words})\b' ELSE '(?is)\b(?:{words})\b' END)
      OR regexp_matches(x[beg + len(m) + 1:beg + len(m) + {CONTEXT_CHARS + 1}], CASE WHEN len(x) > beg + len(m) + {CONTEXT_CHARS} THEN '(?is)\b(?:{words})\b.+$' ELSE '(?is)\b(?:{words})\b' END)"""
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"{rest} = 1",
        "ssn": near,
    }
    found = " UNION ALL ".join(
        f"""SELECT r, {n} AS k, '{kind}' AS kind, beg, beg + len(m) AS until FROM (SELECT r, x, m, CAST(list_sum(list_transform(list_slice(s, 1, i), lambda p: len(p))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda p: len(p))), 0) AS BIGINT) AS beg
  FROM (SELECT r, x, ms, s, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT r, x, regexp_extract_all(x, '{patterns[kind]}') AS ms, string_split_regex(x, '{patterns[kind]}') AS s FROM d))) WHERE {checks[kind]}"""
        for n, kind in enumerate(KINDS)
    )
    text = "string_agg(kind || ':' || beg || ':' || until, ',' ORDER BY k, beg)"
    base = len(BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE_KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), f AS ({found}),
g AS (SELECT r, {counts}, {text} FILTER (k < {base}) AS own, {text} AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in BASE_KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


ORACLE_SQL = _sql()
