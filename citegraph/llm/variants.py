"""Grouping of spelling variants: generated edits probed against Bloom filters, survivors joined with the vocabulary."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import quoted, stage, table, text_pieces

#: Words have at least so many code points and occurrences; a form has at least RATIO times the occurrences.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in PERIOD pairs of document and run loses a letter.
PERIOD = 199
#: Letters of words: a-z and the code points C0 to FF, each one byte in Latin-1.
ALPHABET = np.r_[ord("a") : ord("z") + 1, 0xC0:0x100].astype(np.uint8)
#: Distinct words that a counting task holds before it passes their counts on.
HELD = 200_000
#: Words from LONG on share the last shard of the filters, which has more bits for a word, as they have more edits.
LONG = 64
#: Bits for a word, and bits set by it, in the shards of ordinary and of long words.
DENSITY, LONG_DENSITY = (16, 4), (64, 8)
#: 64-bit blocks of the filters that are sent at once (32 MB); further ones follow in further rounds.
ROUND_BLOCKS = 1 << 22
#: Letters of words that a task turns into edits at once.
LETTERS = 1 << 17

_RUN, _BREAK = re.compile(rb"[a-z\xc0-\xff]+"), re.compile(rb"[^a-z\xc0-\xff]")


# --- words --------------------------------------------------------------------------------------------
def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, period: int | None = PERIOD,
) -> DataFrame:
    """(word, n): how often each word occurs in all texts.

    Words are maximal runs of A-Z, a-z and C0-FF, with only A-Z lower-cased.  With a ``period``, a run whose checksum
    h = crc32("<key>:<run>") is divisible by it loses its code point h % length first.  Shorter and rarer words are
    left out.  Null texts have no words, a null key counts as ''; long texts are read piece by piece.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

        def flushed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for name, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: Counter = Counter()
                # Beyond Latin-1 every character is a break; bytes.lower changes A-Z only.
                for piece in text_pieces(text_.as_py().encode("latin-1", "replace").lower(), _BREAK):
                    own.update(runs.findall(piece))
                if period:
                    start = zlib.crc32(f"{name}:".encode())
                    for run in own:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % period:
                            counts[run] += own[run]
                        elif len(run) > least_length:
                            at = h % len(run)
                            counts[run[:at] + run[at + 1 :]] += own[run]
                else:
                    counts.update(own)
                if len(counts) >= HELD:
                    yield flushed()
        yield flushed()

    texts = docs.select(F.coalesce(quoted(key).cast("string"), F.lit("")), F.coalesce(quoted(text).cast("string"), F.lit("")))
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- hashes -------------------------------------------------------------------------------------------
def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE, np.uint64)])


def _bits(h: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit mask with up to ``count`` bits that depend on ``h``."""
    g, mask = _mixed(h + np.uint64(0x9E3779B97F4A7C15)), np.zeros(h.shape, np.uint64)
    for k in range(count):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return mask


class Shards:
    """Where the filter of each word length lies in one common range of blocks."""

    def __init__(self, words_by_length: dict[int, int]) -> None:
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.total = 0
        for length in sorted(words_by_length):
            self.first[length] = self.total
            self.blocks[length] = math.ceil(words_by_length[length] * self.density(length)[0] / 64)
            self.total += self.blocks[length]

    @staticmethod
    def density(length: int) -> tuple[int, int]:
        return LONG_DENSITY if length >= LONG else DENSITY

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Block and bits of hashed words of a length; nothing if no word is so long."""
        length = min(length, LONG)
        if length not in self.first:
            return None
        h = _mixed(h)
        # The upper half of the hash, scaled to the number of blocks; both factors stay below 2^32.
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        return block.astype(np.int64) + self.first[length], _bits(h, self.density(length)[1])


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(length, positions, words) of a column, in portions of bounded size."""
    encoded = [w.encode("latin-1") for w in words.to_pylist()]
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(encoded):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        step = max(1, LETTERS // length)
        for k in range(0, len(at), step):
            yield length, np.array(at[k : k + step]), [encoded[i] for i in at[k : k + step]]


# --- filters ------------------------------------------------------------------------------------------
def _filter_blocks(words: DataFrame, shards: Shards) -> DataFrame:
    """(block, bits) of the filters of all word lengths."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, portion in _by_length(batch.column(0)):
                h = (_LETTER[_letters(portion, length)] * _powers(length)).sum(axis=1, dtype=np.uint64)
                block, bits = shards.place(h, length)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    return words.select("word").mapInArrow(hashed, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))


def _candidates(words: DataFrame, blocks: DataFrame, shards: Shards, start: int, stop: int) -> DataFrame:
    """(word, n, other): edits of words that pass the filter blocks from ``start`` up to ``stop``.

    Of the two directions of a pair only one is generated: a letter is deleted, or replaced by a greater one.
    """
    found = blocks.filter((F.col("block") >= start) & (F.col("block") < stop)).toArrow()
    held = np.zeros(stop - start, np.uint64)
    held[found["block"].to_numpy() - start] = found["bits"].to_numpy().view(np.uint64)
    sent = words.sparkSession.sparkContext.broadcast(held)

    def passing(h: np.ndarray, length: int) -> np.ndarray:
        placed = shards.place(h, length)
        if placed is None:
            return np.zeros(h.shape, bool)
        block, bits = placed[0] - start, placed[1]
        here = (block >= 0) & (block < stop - start)
        return here & ((sent.value[np.where(here, block, 0)] & bits) == bits)

    def edits(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their edits) for each position."""
        n, length = letters.shape
        powers = _powers(length)
        terms = _LETTER[letters] * powers
        whole = terms.sum(axis=1, dtype=np.uint64)
        shifted = np.zeros((n, length + 1), np.uint64)  # what follows a position, moved one to the left
        if length > 1:
            moved = _LETTER[letters[:, 1:]] * powers[:-1]
            shifted[:, : length - 1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        ahead = np.zeros(n, np.uint64)
        for i in range(length):
            # One of a run of equal letters is enough.
            first = np.ones(n, bool) if i == 0 else letters[:, i] != letters[:, i - 1]
            rows = np.flatnonzero(first & passing(ahead + shifted[:, i], length - 1))
            if len(rows):
                yield rows, np.delete(letters[rows], i, axis=1)
            ahead = ahead + terms[:, i]
            greater = ALPHABET[None, :] > letters[:, i : i + 1]
            rows, which = np.nonzero(greater)
            h = whole[rows] - terms[rows, i] + _LETTER[ALPHABET[which]] * powers[i]
            ok = passing(h, length)
            if ok.any():
                changed = letters[rows[ok]]
                changed[:, i] = ALPHABET[which[ok]]
                yield rows[ok], changed

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, portion in _by_length(batch.column(0)):
                for rows, changed in edits(_letters(portion, len(portion[0]))):
                    source = pa.array(at[rows])
                    others = pa.array([c.tobytes().decode("latin-1") for c in changed], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(source), batch.column(1).take(source), others], ["word", "n", "other"]
                    )

    return words.select("word", "n").mapInArrow(probe, "word string, n long, other string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each two of ``words`` (word, n; staged, distinct) that differ by exactly one inserted,
    deleted or replaced code point, once.

    Each word length has a blocked Bloom filter (16 bits for a word, 64 from 64 letters on).  The filters are sent in
    rounds of at most 32 MB, and words generate their edits once a round; edits of which no filter knows anything end
    there.  The others are joined with the words themselves, which removes what a filter let through by chance.
    """
    length = F.least(F.length("word"), F.lit(LONG)).alias("length")
    shards = Shards({r.length: r.words for r in words.groupBy(length).agg(F.count(F.lit(1)).alias("words")).collect()})
    blocks = stage(_filter_blocks(words, shards)) if shards.total > ROUND_BLOCKS else _filter_blocks(words, shards)
    found = None
    for start in range(0, max(shards.total, 1), ROUND_BLOCKS):
        part = _candidates(words, blocks, shards, start, min(start + ROUND_BLOCKS, shards.total))
        found = part if found is None else found.union(part)
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(known, "other").select("word", "n", "other", "other_n")


# --- forms --------------------------------------------------------------------------------------------
def _last(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): where following ``form`` from each word ends.

    Every step multiplies the count by ``ratio`` at least, which bounds their number; each round doubles the steps.
    """
    steps = 1 + math.floor(math.log(max(most, 1), ratio))
    current = stage(links.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = stage(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return current


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of ``words`` (word, n).

    ``n_near`` counts the words at an edit distance of one.  The form is the one of these with the most occurrences
    (of equals the first in code-point order), if it has at least ``ratio`` (2 or more) times the word's own; else
    null.  The root is what following the forms leads to, the word itself if it has none.

    Words hold letters of one byte in Latin-1, as those of ``count_words`` do.  Null words are left out, counts of a
    repeated word are added; a table without rows gives none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = stage(words.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    both = F.array(
        F.struct(F.col("word").alias("word"), F.col("other_n").alias("m"), F.col("other").alias("other")),
        F.struct(F.col("other").alias("word"), F.col("n").alias("m"), F.col("word").alias("other")),
    )
    best = near_words(words).select(F.inline(both)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best")
    )

    def if_large(c: Column) -> Column:
        return F.when(-F.col("best.minus") >= ratio * F.col("n"), c)

    formed = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            if_large(F.col("best.other")).alias("form"), if_large(-F.col("best.minus")).alias("form_n"),
        )
    )
    most = formed.agg(F.max("form_n")).first()[0]
    roots = _last(formed.filter("form is not null"), most or 0, ratio)
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return group_variants(count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")


# The checksum of RFC 1952 as a fold over bytes, since the other engine has no function for it.
ORACLE = rf"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS n))),
docs AS (
    SELECT coalesce(CAST(doc_id AS varchar), '') AS doc_id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM docs)
    WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
        regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: CAST('0x' || h AS bigint))),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h FROM runs, crc_table),
words AS (
    SELECT word, CAST(sum(n) AS bigint) AS n
    FROM (SELECT n, CASE WHEN h % {PERIOD} = 0
        THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(minus := -m, other := other)) AS b FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= {RATIO} * w.n THEN b.other END AS form,
        CASE WHEN -b.minus >= {RATIO} * w.n THEN -b.minus END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, CAST(form_n AS bigint) AS form_n FROM formed JOIN ends USING (word)
"""
