"""License notices: exact phrases, and short notices with a bounded number of errors."""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Remembered, add_fields, once_per_worker, table

# The phrases of the contract and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening or defining words of well-known notices, normalised to words and single spaces (fixed values).
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "licensed under a creative commons": "cc",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

# Bytes to normalised bytes: A-Z to a-z, all that is no word character to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def allowed_errors(notice: str, share: float) -> int:
    return int(len(notice) * share)


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 2 consecutive parts with their offsets: with that many errors at least two parts are intact."""
    n, parts = len(notice), errors + 2
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeFinder:
    def __init__(self, notices: dict[str, str], share: float):
        self.notices = []
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            k = allowed_errors(notice, share)
            self.notices.append((notice, label, k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            for offset, part in seeds(notice, k):
                owners.setdefault(part, []).append((number, offset))
        for part, places in owners.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()
        self.remembered = Remembered(self.verify, 100_000)

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(notice number, start) of the places where two intact parts let a notice stand.

        Both parts shift the notice alike but for the errors between them, so they must agree up to ``k``.
        """
        shifts: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                shifts.setdefault(number, []).append((last - length + 1 - offset, offset))
        found = []
        for number, seen in shifts.items():
            k = self.notices[number][2]
            seen.sort()
            for (begin, part), (other, other_part) in zip(seen, seen[1:]):
                if other - begin <= k and part != other_part:
                    found.append((number, begin))
        return sorted(set(found))

    def verify(self, key: tuple[int, str]) -> tuple[int, int, int] | None:
        """(start, end, errors) of the best place of a notice inside a short stretch."""
        m = self.notices[key[0]][3].search(key[1])
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None

    def find(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, errors, likeness) of the verified places, sorted; offsets in the normalised text.

        Every candidate is verified in a stretch of its own that is little longer than the notice, so the work grows
        with the number of candidates only, and stretches that have been seen before are looked up.  Of places of the
        same notice that overlap the one with fewest errors counts, then the first.
        """
        best: dict[int, list[tuple[int, int, int]]] = {}
        for number, begin in self.candidates(text):
            notice, _, k, _ = self.notices[number]
            a = max(0, begin - k)
            if not (found := self.remembered[number, text[a : max(0, begin + len(notice) + 2 * k)]]):
                continue
            place = (a + found[0], a + found[1], found[2])
            places = best.setdefault(number, [])
            if places and place[0] < places[-1][1]:
                if place[2] < places[-1][2]:
                    places[-1] = place
            else:
                places.append(place)
        return sorted(
            {
                (a, b, self.notices[number][1], errors, 1.0 - errors / len(self.notices[number][0]))
                for number, places in best.items()
                for a, b, errors in places
            }
        )


class Scanner:
    """All that is said about one text."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], share: float):
        self.finder = NoticeFinder(notices, share)
        self.phrases = [
            (label, re.compile(rb"(?<![^ ])" + rb" +".join(map(re.escape, p.encode().split())) + rb"(?![^ ])"))
            for p, label in phrases.items()
        ]

    def scan(self, text: str | None) -> dict:
        data = (text or "").encode().translate(_WORD_BYTES)
        words = data.split()
        starts, base = [], set()
        for label, pattern in self.phrases:
            for m in pattern.finditer(data):
                starts.append(m.start())
                base.add(label)
        row = {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": len(data[: min(starts)].split()) if starts else None,
            "last_word": len(data[: max(starts)].split()) if starts else None,
            "base_labels": sorted(base),
        }
        joined = b" ".join(words).decode()
        hits = self.finder.find(joined)
        row["labels"] = sorted(base | {h[2] for h in hits})
        row["score"] = max([1.0] * bool(starts) + [h[4] for h in hits], default=0.0)
        row["spans"] = self._spans(text or "", joined, hits)
        return row

    @staticmethod
    def _spans(text: str, joined: str, hits: list) -> list[dict]:
        """The hits with offsets in the source text: the n-th word character of one is that of the other."""
        if not hits:
            return []
        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        at, source = 0, []  # (start in the normalised text, start in the source) of each word
        for m in word.finditer(text):
            source.append((at, m.start()))
            at += m.end() - m.start() + 1
        begins = [s[0] for s in source]

        def back(place: int) -> int:
            i = bisect_right(begins, place) - 1
            return source[i][1] + place - begins[i]

        return [
            {"start": back(a), "end": back(b - 1) + 1, "label": label, "errors": errors}
            for a, b, label, errors, _ in hits
            if b > a
        ]


FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "array<string>",
    "labels": "array<string>", "score": "double",
    "license_spans": "array<struct<start:long,end:long,label:string,errors:long>>",
}


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    error_share: float = 0.12,
) -> DataFrame:
    """``docs`` with the license phrases and notices of each whole text.

    Phrases must stand word for word; ``n_base`` counts their places, ``first_word`` and ``last_word`` are the first and
    last word they start at.  Notices may differ by insertions, deletions and replacements of characters up to
    ``error_share`` of their length: two of the k + 2 parts of a notice with k errors are intact, so its exact parts
    (found by one automaton) lead to every candidate, which the pattern library then verifies.  ``license_spans`` are code
    points of the source text, ends exclusive; ``score`` is the likeness of the best hit, 0 without one.
    Null and empty texts have no words and no hits.  Columns of these names are replaced; all others and repeated
    rows stay.
    """

    @F.arrow_udf("struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">")
    def scan(texts: pa.Array) -> pa.Array:
        key = ("licenses", tuple(phrases.items()), tuple(notices.items()), error_share)
        scanner = once_per_worker(key, lambda: Scanner(phrases, notices, error_share))
        rows = [scanner.scan(t) for t in texts.to_pylist()]
        column = lambda name, kind: pa.array([r[name] for r in rows], kind)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int64())])
        return pa.StructArray.from_arrays(
            [column(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
            + [column(n, pa.list_(pa.string())) for n in ("base_labels", "labels")]
            + [column("score", pa.float64()), column("spans", pa.list_(span))],
            list(FIELDS),
        )

    return add_fields(docs, scan(F.col(text)), FIELDS)


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("license_spans").cast("long").alias("n_notices"),
    )
