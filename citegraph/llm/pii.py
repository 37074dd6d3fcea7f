"""Personal data: detection in plain and in disguised form, with spans in the source text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import add_fields, table

KINDS = ("email", "ip", "card", "phone")

# --- identifiers --------------------------------------------------------------------------------------
# The four patterns of the contract (fixed values), written so that no position is scanned twice: the part
# before "@" is taken backwards from it, and runs of digits are entered at their first digit only.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = regex.compile(r"(?r)[A-Za-z0-9._%+-]+")
_IP = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        # The part before the sign may not reach into the match before.
        local = _LOCAL.match(text, free, m.start()) if m.start() > free else None
        if local:
            found.append((local.start(), m.end()))
            free = m.end()
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]


def identifiers(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every identifier; leftmost and non-overlapping within a kind."""
    found = []
    if "@" in text:
        found += [(a, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(a, "ip", b) for a, b in _ips(text)]
        found += [(a, "card", b) for a, b in _cards(text)]
        if "+" in text:
            found += [(a, "phone", b) for a, b in _phones(text)]
    return found


# --- transducers --------------------------------------------------------------------------------------
class Rewritten:
    """A text after some replacements, and the way back from its offsets."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        """``changes``: (start, end, new text) in order, not overlapping."""
        parts, self.at, self.source, self.changed = [], [], [], []
        length = here = 0

        def add(start: int, end: int, new: str | None) -> None:
            nonlocal length
            part = text[start:end] if new is None else new
            if part:
                parts.append(part)
                self.at.append(length)
                self.source.append((start, end))
                self.changed.append(new is not None)
                length += len(part)

        for start, end, new in changes:
            add(here, start, None)
            add(start, end, new)
            here = end
        add(here, len(text), None)
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the new text."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.source[i], self.source[j]
        return (
            first[0] if self.changed[i] else first[0] + start - self.at[i],
            last[1] if self.changed[j] else last[0] + end - self.at[j],
        )


# Letters of other scripts that look like Latin ones (fixed values); compatibility forms, digits of other
# scripts, dashes, spaces and invisible characters are found by rule.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "aeopcyxijsdqwhABEKMHOPCTYXIJSABEZHIKMNOPTYXoavpi"))
_INVISIBLE = "­​‌‍⁠﻿"


def plain_character(c: str) -> str:
    """The ASCII character that ``c`` passes for, nothing for an invisible one, or ``c`` itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _INVISIBLE:
        return ""
    category = unicodedata.category(c)
    if category == "Nd":
        return str(unicodedata.decimal(c))
    if category == "Zs":
        return " "
    if category == "Pd":
        return "-"
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else c


_PLAIN: dict[str, str] = {}
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def plain_characters(text: str) -> list[tuple[int, int, str]]:
    changes = []
    if not text.isascii():
        for c in set(text):
            if c not in _PLAIN and not c.isascii():
                _PLAIN[c] = plain_character(c)
        if any(_PLAIN.get(c, c) != c for c in set(text)):
            changes = [(m.start(), m.end(), _PLAIN[m[0]]) for m in _NOT_ASCII.finditer(text) if _PLAIN[m[0]] != m[0]]
    # Letters that pass for digits between digits.
    changes += [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGIT.finditer(text)]
    return sorted(changes)


_LETTER_DIGIT = re.compile(r"(?<=[0-9][.\x20-])[OolI](?=[0-9.])|(?<=[0-9])[OolI](?=[0-9]|[.\x20-][0-9])")

# Spelled digits (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_GAP = r"(?:[\x20\t]*[-,][\x20\t]*|[\x20\t]+)"
# Spelled digits in a row, among them written ones; a leading "plus" belongs to them.  Any such run is rewritten: whether
# it is an identifier is for its length and check digit to say.
_SPELLED = regex.compile(
    rf"(?i)\b(?P<plus>plus{_GAP})?(?P<digit>{_WORD}|[0-9]+)(?:{_GAP}(?P<digit>{_WORD}|[0-9]+))++\b"
)
_SPELLED_HINT = re.compile(rf"(?i)\b{_WORD}{_GAP}(?:{_WORD}|[0-9])|[0-9]{_GAP}{_WORD}\b")
# Spelled points and dashes between spelled digits: "one dot two dot ..."
_SPELLED_IP = regex.compile(
    rf"(?i)\b(?P<part>{_WORD}(?:{_GAP}{_WORD})*+|[0-9]+)(?:(?P<dot>[\x20\t]+(?:dot|point)[\x20\t]+|\.)(?P<part>{_WORD}(?:{_GAP}{_WORD})*+|[0-9]+)){{3}}+\b"
)
_SPELLED_IP_HINT = re.compile(rf"(?i)\b{_WORD}[\x20\t]+(?:dot|point)\b|\b(?:dot|point)[\x20\t]+{_WORD}\b")
_EACH_WORD = re.compile(rf"(?i){_WORD}|[0-9]+")


def _spell(text: str) -> str:
    return "".join(DIGIT_WORDS.get(w.lower(), w) for w in _EACH_WORD.findall(text))


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    changes = []
    if _SPELLED_IP_HINT.search(text):
        changes = [(m.start(), m.end(), ".".join(map(_spell, m.captures("part")))) for m in _SPELLED_IP.finditer(text)]
    if _SPELLED_HINT.search(text):
        addresses = [(a, b) for a, b, _ in changes]
        ends = [b for _, b in addresses]
        for m in _SPELLED.finditer(text):
            nearest = bisect_right(ends, m.start())
            if nearest < len(addresses) and addresses[nearest][0] < m.end():
                continue  # read as an address
            if any(not d[0].isdigit() for d in m.captures("digit")):
                plus = m["plus"] or ""
                changes.append((m.start(), m.end(), ("+" if plus else "") + _spell(m[0][len(plus):])))
    return sorted(changes)


_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_AT = rf"\s{{0,3}}{_OPEN}(?:at|@){_CLOSE}\s{{0,3}}"
_DOT = rf"\s{{0,3}}{_OPEN}(?:dot|\.){_CLOSE}\s{{0,3}}"
_DISGUISE_HINT = re.compile(rf"(?i){_OPEN}(?:at|@|dot|\.){_CLOSE}|\bdot\b")
_NAME, _LABEL = r"[A-Za-z0-9_%+-]", r"[A-Za-z0-9-]"
# The sign is found first; then the host is read forwards and the name backwards.  Host names have at most 127
# labels and names are at most 64 characters long by their standards, which also bounds the work per sign.
_SIGN = re.compile(rf"(?i){_AT}|\s{{1,3}}at\s{{1,3}}|@")
_HOST = regex.compile(rf"(?i){_LABEL}++(?:(?P<dot>{_DOT}|\s{{1,3}}dot\s{{1,3}}|\.){_LABEL}++){{1,126}}+")
_BEFORE = regex.compile(rf"(?ir)(?<![A-Za-z0-9._%+-]){_NAME}{{1,64}}(?:(?P<dot>{_DOT}|\.|[\x20]dot[\x20]){_NAME}{{1,64}}){{0,31}}")


def disguised_addresses(text: str) -> list[tuple[int, int, str]]:
    """Changes for "name (at) host (dot) tld" and the like.

    A bare "at" counts only together with a disguised dot behind it, as "look at host.tld" is ordinary prose.
    """
    changes: list[tuple[int, int, str]] = []
    if not _DISGUISE_HINT.search(text):
        return changes
    free = 0
    for sign in _SIGN.finditer(text):
        host = _HOST.match(text, sign.end())
        if not host:
            continue
        hidden = any(text[a:b] != "." for a, b in host.spans("dot"))
        if (sign[0] == "@" or sign[0].strip().lower() == "at") and not hidden:
            continue
        name = _BEFORE.match(text, free, sign.start())
        if name:
            free = host.end()
            dots = name.spans("dot") + host.spans("dot")
            changes += [(*sign.span(), "@")] if sign[0] != "@" else []
            changes += [(a, b, ".") for a, b in dots if text[a:b] != "."]
    return sorted(changes)


TRANSDUCERS = (plain_characters, spelled_digits, disguised_addresses)


def personal_data(text: str | None) -> tuple[list, list]:
    """(base spans, further spans that only appear after normalisation) as sorted (start, kind number, end)."""
    if not text:
        return [], []
    number = {kind: i for i, kind in enumerate(KINDS)}
    base = sorted((a, number[kind], b) for a, kind, b in identifiers(text))
    steps, now, found = [], text, []
    for transducer in TRANSDUCERS:
        changes = transducer(now)
        if not changes:
            continue
        steps.append(Rewritten(now, changes))
        now = steps[-1].text
        # Each step is asked, as the next one may join what it has uncovered with what lies beside it.
        for start, kind, end in identifiers(now):
            a, b = start, end
            for step in reversed(steps):
                a, b = step.back(a, b)
            # What reads the same in the source has been judged there.
            if text[a:b] != now[start:end]:
                found.append((a, number[kind], b))
    # Only what another span of its kind covers wholly is left out: the plain part of an identifier is not all of it.
    more: list[tuple[int, int, int]] = []
    covered = [0] * len(KINDS)
    for a, minus_b, is_found, kind in sorted([(a, -b, 0, k) for a, k, b in base] + [(a, -b, 1, k) for a, k, b in found]):
        if -minus_b > covered[kind]:
            if is_found:
                more.append((a, kind, -minus_b))
            covered[kind] = -minus_b
    return base, sorted(more)


SPANS = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the spans of personal data of each whole text.

    ``into`` is a list of (kind, start, end, disguised) by start, then kind in the order of ``KINDS``; offsets count
    code points of the source text, the end is exclusive.  Spans that only show after normalisation are marked as
    disguised; one may overlap a plain span, which is then a part of it only.  Null and empty texts have an empty list; a column called ``into`` is
    replaced, all others and repeated rows stay.  Work is linear in the text.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base, more = personal_data(text)
            every = sorted([(*s, False) for s in base] + [(*s, True) for s in more])
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "disguised": d} for a, k, b, d in every])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return add_fields(docs, F.struct(spans(F.col(text)).alias(into)), [into])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        kept = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.concat(state["done"], kept, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.when(inside, state["done"]).otherwise(new).alias("done"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substr(text, (state["at"] + 1).cast("int")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = find_personal_data(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    plain = F.filter("pii", lambda s: ~s["disguised"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_listed(plain), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(plain)).cast("long").alias("n_disguised"),
    )
