"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score.

Every pattern is written so that a scan is linear in the text: runs are entered at their
start only and never given back. Card numbers are confirmed by the Luhn sum, account
numbers by mod-97. Words within some characters of a span raise or lower its score. The
base kinds always stay; the added kinds need a score of ``LEAST``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base kinds in their order, then the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "shortcard", "ssn", "localphone")
KINDS = BASE + ADDED
# An added span needs this score, of 100.
LEAST = 50
# Code points before and after a span in which context words count.
BEFORE, AFTER = 40, 20

# Lengths of account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    each = (rf"(?:{'|'.join(names)})[0-9][0-9](?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by_length.items()))
    return "|".join(each)


# Patterns of the proposals, without look-around, as other engines read them too.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
    "localphone": r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
}


@dataclass(frozen=True)
class Rule:
    """Score of a span, what its checksum adds, and what words nearby add or take away."""

    score: int
    checksum: int
    raised: int
    words: str
    lowered: int
    against: str


RULES = {
    "email": Rule(80, 0, 15, "mail|email|contact|kontakt|correo|courriel", 30, "noreply|sample"),
    "ip": Rule(50, 0, 30, "ip|host|server|address|adresse|login|client", 30, "version|release|build|update|section"),
    "card": Rule(40, 40, 20, "card|visa|mastercard|credit|karte|carte|tarjeta", 30, "isbn|order|tracking|serial"),
    "phone": Rule(60, 0, 30, "tel|phone|call|fax|mobile|telefon|mobil|appel|llame", 30, "isbn|order|serial"),
    "iban": Rule(20, 60, 20, "iban|bic|bank|account|konto|compte|cuenta", 0, ""),
    "shortcard": Rule(0, 30, 40, "card|visa|amex|diners|credit|karte|carte|tarjeta", 30, "isbn|order|tracking|serial"),
    "ssn": Rule(20, 0, 60, "ssn|social|security|taxpayer", 30, "part|serial|order"),
    "localphone": Rule(20, 0, 50, "tel|phone|call|fax|mobile|telefon|mobil|appel|llame", 30, "isbn|order|serial"),
}


def words_pattern(words: str) -> str:
    """Any of the words, in either case, between characters that are no ASCII letters."""
    each = ("".join(f"[{c.upper()}{c}]" for c in word) for word in words.split("|"))
    return f"[^A-Za-z](?:{'|'.join(each)})[^A-Za-z]"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: int


_WORDS = {k: tuple(re.compile(words_pattern(w)) if w else None for w in (r.words, r.against)) for k, r in RULES.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run that fails from its start fails from each later place in it too, so it is entered once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
_OTHERS = {k: re.compile(PATTERNS[k]) for k in ("phone", "iban", "ssn", "localphone")}
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of ASCII digits is a multiple of ten."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, its first four characters moved to the end, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterable[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", match.end() if match else at + 1)


def _proposals(text: str) -> Iterable[tuple[str, int, int]]:
    """Spans that their patterns and checksums pass, base kinds first."""
    yield from (("email", a, b) for a, b in _emails(text))
    if not any(d in text for d in "0123456789"):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    short = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            if len(digits) >= 16:
                yield "card", *m.span()
            else:
                short.append(("shortcard", *m.span()))
    if "+" in text:
        for m in _OTHERS["phone"].finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in _OTHERS["iban"].finditer(text):
        if _alone(text, *m.span()) and mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    yield from short
    for m in _OTHERS["ssn"].finditer(text):
        area, group, serial = m[0].split("-")
        if _alone(text, *m.span()) and area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield "ssn", *m.span()
    for m in _OTHERS["localphone"].finditer(text):
        if _alone(text, *m.span()) and 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 12:
            yield "localphone", *m.span()


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no ASCII letter, digit, sign or point stands directly beside the span."""
    return not any(c.isascii() and (c.isalnum() or c in "+.-") for c in text[max(start - 1, 0) : start] + text[end : end + 1])


def _score(padded: str, kind: str, start: int, end: int) -> int:
    """``padded`` is the text with a blank at either end."""
    rule, (words, against) = RULES[kind], _WORDS[kind]
    near = padded[max(0, start + 1 - BEFORE) : start + 1] + "\n" + padded[end + 1 : end + 1 + AFTER]
    score = rule.score + rule.checksum
    score += rule.raised if words.search(near) else 0
    score -= rule.lowered if against and against.search(near) else 0
    return max(0, min(100, score))


def spans_of(text: str) -> list[Span]:
    """All spans of a text by kind as listed, then start, in code points."""
    found = list(_proposals(text))
    if not found:
        return []
    padded = f" {text} "
    base = [Span(*p, _score(padded, *p)) for p in found if p[0] in BASE]
    # Base spans by start, and how far the ones before reach, tell an overlap in one pass.
    taken = sorted((s.start, s.end) for s in base)
    added, at, reach = [], 0, 0
    for p in sorted((p for p in found if p[0] not in BASE), key=lambda p: p[1]):
        while at < len(taken) and taken[at][0] <= p[1]:
            reach = max(reach, taken[at][1])
            at += 1
        covered = reach > p[1] or (at < len(taken) and taken[at][0] < p[2])
        if not covered and (score := _score(padded, *p)) >= LEAST:
            added.append(Span(*p, score))
    return sorted(base + added, key=lambda s: (KINDS.index(s.kind), s.start))


FOUND = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.LongType())
    .add("end", T.LongType())
    .add("score", T.IntegerType())
)


@F.arrow_udf(FOUND)
def find_spans(text: pa.Array) -> pa.Array:
    offsets, flat = [0], []
    for value in text:
        flat += spans_of(value.as_py() or "")
        offsets.append(len(flat))
    kinds, starts, ends, scores = zip(*flat, strict=True) if flat else ((), (), (), ())
    fields = [pa.array(kinds, pa.string()), *(pa.array(x, pa.int64()) for x in (starts, ends)), pa.array(scores, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "score"]))


@F.arrow_udf(T.StringType())
def hide_spans(text: pa.Array, least: pa.Array) -> pa.Array:
    """Spans of at least that score become their kind in angle brackets; overlapping ones the first one's."""
    out = []
    for value, low in zip(text, least.to_pylist(), strict=True):
        body, parts, reach = value.as_py(), [], 0
        for s in sorted((s for s in spans_of(body or "") if s.score >= low), key=lambda s: (s.start, -s.end)):
            if s.start >= reach:
                parts += [body[reach : s.start], f"<{s.kind.upper()}>"]
            reach = max(reach, s.end)
        out.append(body if not parts else "".join([*parts, body[reach:]]))
    return pa.array(out, pa.string())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (all its columns as one struct) and ``found``, its spans with scores.

    Spans are ordered by kind as listed in ``KINDS``, then start, in code points, ends
    exclusive. Null and empty texts have none. Texts may be of any length and are read
    whole, one at a time; equal rows get equal spans; other columns are untouched and
    nothing is shuffled. Spans of different base kinds may overlap; an added span that
    overlaps a base one is left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("body")).select("row", find_spans("body").alias("found"))


def joined(found: Column, base: bool = False) -> Column:
    """kind:start:end of all spans, or of the base ones."""
    kept = F.filter(found, lambda x: x["kind"].isin(*BASE)) if base else found
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def number_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with spans of at least that score replaced; all rows, other columns and null texts stay."""
    return docs.select(
        *(hide_spans(F.col(c).cast("string"), F.lit(least)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns)
    )
