"""Cross-entropy difference between a target and a background bigram model with one vocabulary."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citegraph.llm.common import give_back, once_per_worker, quoted, stage, table

#: Words that every task holds: the most frequent ones.  Bigrams whose counts every task holds: those of the most frequent
#: words among themselves, so that no other bigram has more than a small share of all.  The models have no limit: other
#: bigrams and words are counted in buckets, which they are sent to.
VOCABULARY, BIGRAMS = 1 << 16, 1 << 16
#: Words of a block, whose texts are taken apart together; texts of a block; words of a bucket, on average; buckets that one
#: task sums up at most, one after the other, so that a text's sums come back from fewer tasks.
BLOCK, BLOCK_TEXTS, BUCKET, GROUP = 1 << 19, 1 << 17, 1 << 20, 4
#: A small corpus has a bucket for every core as long as buckets have so many words.
LEAST_BUCKET = 1 << 17
#: Strength of the backing off: bigrams to words, words to equal shares.
BIGRAM_WEIGHT, WORD_WEIGHT = 50.0, 1000.0
#: Up to so many target keys are sent to every executor; beyond that the join is a shuffle.
BROADCAST_KEYS = 1_000_000
#: Distinct words that a counting task holds before it passes their counts on.
HELD = 100_000

RARE, BEGIN = 0, 1  # the first two word numbers
BASE = VOCABULARY + 2

# Bytes to normalised bytes: A-Z to a-z, ASCII that is no letter or digit to a space (fixed values).
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def lm_words(text: str | None) -> list[bytes]:
    return _split((text or "").encode())


def _split(data: bytes | None) -> list[bytes]:
    return data.translate(_NORMAL).split() if data else []


# --- counting -----------------------------------------------------------------------------------------
def _count_words(texts: DataFrame) -> DataFrame:
    """(word, n, t, e, et): how often each word occurs, and ends a text, in all and in target texts.

    ``texts`` is (text as bytes, wanted).  These are counts of each task, several rows for a word; the empty word stands for the
    texts that have words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            words = list(counts[0])
            columns = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *columns], ["word", "n", "t", "e", "et"])

        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _split(text.as_py())
                if words:
                    _add(counts[0], counts[2], words)
                    if wanted:
                        _add(counts[1], counts[3], words)
                if len(counts[0]) >= HELD:
                    yield flushed()
        yield flushed()
        give_back()

    return texts.mapInArrow(run, "word binary, n long, t long, e long, et long")


def _add(counts: Counter, ends: Counter, words: list[bytes]) -> None:
    counts.update(words)
    counts[b""] += 1
    ends[words[-1]] += 1


def _most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """The rows of ``counted`` with the highest ``n``, at most ``limit``: all above a limit of ``n``, so ties stay together.

    The limit is read off a histogram whose bucket bounds are whole numbers of two digits, a few hundred rows.
    """
    digits = F.length(F.col("n").cast("string"))
    low = F.pow(F.lit(10), F.greatest(digits - 2, F.lit(0))).cast("long")
    bound = (F.col("n") - F.col("n") % low).alias("bound")
    histogram = counted.groupBy(bound).agg(F.count(F.lit(1)).alias("rows")).collect()
    total, least = 0, None
    for row in sorted(histogram, key=lambda r: -r["bound"]):
        total += row["rows"]
        if total > limit:
            break
        least = row["bound"]
    return counted.filter(F.col("n") >= least) if least is not None else counted.limit(0)


def _marked(docs: DataFrame, targets: DataFrame, key: str, *columns: Column) -> DataFrame:
    """(columns, wanted): of every row, and whether its key is in ``targets``."""
    targets = targets.select(quoted(key).alias("mark")).filter(F.col("mark").isNotNull()).distinct()
    if targets.count() <= BROADCAST_KEYS:
        targets = F.broadcast(targets)
    rows = docs.select(*columns, quoted(key).alias("key"))
    return rows.join(targets, F.col("key") == F.col("mark"), "left").withColumn("wanted", F.col("mark").isNotNull()).drop("key", "mark")


# --- models -------------------------------------------------------------------------------------------
class Frequent:
    """What every task holds of both models: counts of the background (0) and the target (1)."""

    def __init__(self, words: list[bytes], word_counts: np.ndarray, context_counts: np.ndarray, totals: np.ndarray, size: int,
                 buckets: int):
        self.words, self.key = words, uuid.uuid4().hex
        self.word_counts, self.context_counts, self.totals, self.size = word_counts, context_counts, totals, size
        self.buckets = buckets
        #: The beginning and the first words, whose bigrams are held: the numbers from ``BEGIN`` to this one.
        self.heads = math.isqrt(BIGRAMS)
        # The larger corpus is weighed down to the size of the smaller one, so that both models back off alike.
        self.scales = totals.min() / totals if totals.min() else np.ones(2)

    def singles(self, side: int, counts: np.ndarray, lengths: np.ndarray, without: np.ndarray) -> np.ndarray:
        """The smoothed counts that bigrams back off to: of words with ``counts``, in texts of ``lengths`` words, without
        ``without`` (0 or 1) times the text itself, which ``counts`` leave out already."""
        scale = self.scales[side]
        total = scale * np.maximum(self.totals[side] - without * lengths, 0.0)
        return BIGRAM_WEIGHT * (scale * np.maximum(counts, 0) + WORD_WEIGHT / self.size) / (total + WORD_WEIGHT)

    def contexts(self, side: int, counts: np.ndarray) -> np.ndarray:
        return np.log(self.scales[side] * np.maximum(counts, 0) + BIGRAM_WEIGHT)

    def head(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The places of the bigrams of heads."""
        return (after.astype(np.int64) - BEGIN) * self.heads + before - BEGIN


class Model:
    """Both models: ``frequent`` is held by every task, ``spread`` has the bigrams and rare words of all texts (``_spread``).

    ``source`` is what they come from, so that the same texts need not be taken apart again to be judged.
    """

    def __init__(self, frequent: Frequent, spread: DataFrame, source: tuple):
        self.frequent, self.spread, self.source = frequent, spread, source

    def is_of(self, source: tuple) -> bool:
        return all(a is b or (isinstance(a, (str, bool)) and a == b) for a, b in zip(self.source, source))


def train(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> Model:
    """Both models, counted over all of ``docs`` and over those whose key is in ``targets``.

    Counts of words are summed inside each task before they are shuffled, so a frequent word is one row per task.  A context
    has the count of its word without the texts that end in it.  ``keep_text`` as in ``score``, for the same texts.
    """
    spark = docs.sparkSession
    texts = _marked(docs, targets, key, quoted(text).cast("binary").alias("text"))
    sums = [F.sum(c).alias(c) for c in ("n", "t", "e", "et")]
    counted = stage(_count_words(texts).groupBy("word").agg(*sums))
    begun = counted.filter(F.length("word") == 0).first()
    words = counted.filter(F.length("word") > 0).select(
        "word", "n", "t", (F.col("n") - F.col("e")).alias("cn"), (F.col("t") - F.col("et")).alias("ct")
    )
    known = sorted(_most_frequent(words, VOCABULARY).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    listed = [bytes(r["word"]) for r in known]
    all_words = words.agg(F.sum("n"), F.sum("t"), F.count(F.lit(1))).first()
    word_counts, context_counts = np.zeros((len(listed) + 2, 2)), np.zeros((len(listed) + 2, 2))
    word_counts[2:] = np.array([[r["n"], r["t"]] for r in known]).reshape(-1, 2)
    context_counts[2:] = np.array([[r["cn"], r["ct"]] for r in known]).reshape(-1, 2)
    if begun:
        context_counts[BEGIN] = begun["n"], begun["t"]
    totals = np.array([all_words[0] or 0, all_words[1] or 0], np.float64)
    n, cores = int(totals[0]), spark.sparkContext.defaultParallelism
    buckets = max(1, -(-n // BUCKET), min(cores, n // LEAST_BUCKET))
    frequent = Frequent(listed, word_counts, context_counts, totals, all_words[2] + 1, buckets)
    spread = _spread(docs, targets, frequent, key, text, keep_text)
    return Model(frequent, spread, (docs, targets, key, text, keep_text))


# --- texts taken apart --------------------------------------------------------------------------------
class _Numbers(dict):
    """The numbers of the frequent words; other words are numbered from ``BASE`` on as they come, until ``forget``."""

    def __init__(self, words: list[bytes]):
        super().__init__((word, i + 2) for i, word in enumerate(words))
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = BASE + len(self.rare)
        self.rare.append(word)
        return number

    def forget(self) -> None:
        for word in self.rare:
            del self[word]
        self.rare = []


#: What is known of a bigram in a text: the text's place in its block, its number of words and whether it is a target (the
#: last bit), the next word, the word before it, how often they and how often the next word occur in the text.  A rare word
#: has a record of its own, with ``RARE`` before it and its count as a context.
_RECORD = ("at", "size", "after", "before", "times", "own")


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compress better."""
    return np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T).tobytes()


def _numbers(data: bytes, start: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.array(np.frombuffer(data, np.uint8, size * n, start).reshape(size, n).T, order="C").view(kind)[:, 0]


def _to_bytes(records: np.ndarray, words: list[bytes]) -> tuple[int, bytes]:
    """Length and compressed bytes of records, in the order of their texts, and of the rare words that they name."""
    at, size, *others = records
    step = np.diff(at, prepend=-1)
    planes = [_planes(np.ascontiguousarray(x, "<i4")) for x in (step, size[step > 0], *others)]
    data = b"".join(planes) + b" ".join(words)
    return len(data), pa.compress(data, "zstd", asbytes=True)


def _from_bytes(n: int, raw: int, data: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = pa.decompress(data, raw, "zstd", asbytes=True)
    records = np.empty((len(_RECORD), n), np.int32)
    step = _numbers(data, 0, n, "<i4")
    texts = np.count_nonzero(step)
    records[0] = np.cumsum(step) - 1
    records[1] = _numbers(data, 4 * n, texts, "<i4")[np.cumsum(step > 0) - 1]
    for i in range(2, len(_RECORD)):
        records[i] = _numbers(data, 4 * (texts + (i - 1) * n), n, "<i4")
    return records, data[4 * (texts + (len(_RECORD) - 1) * n) :].split()


def _sums_to_bytes(at: np.ndarray, sums: np.ndarray) -> bytes:
    """Compressed bytes of texts' sums, as whole numbers of a unit far below what the losses show."""
    unit = 2.0 ** max(-36, math.frexp(np.abs(sums).max())[1] - 50)
    whole = [_planes(np.rint(x / unit).astype("<i8")) for x in sums.T]
    steps = _planes(np.diff(at, prepend=0).astype("<i4"))
    return pa.compress(np.float64(unit).tobytes() + steps + b"".join(whole), "zstd", asbytes=True)


def _sums_from_bytes(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(data, 8 + 20 * n, "zstd", asbytes=True)
    unit = np.frombuffer(data, np.float64, 1)[0]
    sums = [_numbers(data, 8 + 4 * n + 8 * n * i, n, "<i8") * unit for i in range(2)]
    return np.cumsum(_numbers(data, 8, n, "<i4")), np.stack(sums, axis=1)


def _taken_apart(frequent: Frequent, texts: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of a block's bigrams and rare words, and for each text the sums of log shares in background and target
    as if no bigram had a count.

    A bigram's share is its smoothed count divided by that of its context, so that both may be summed apart.  The sums are
    without rare words, as next word and as context.  A model that has counted the text itself is asked without it.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    after = np.concatenate(texts)
    some = np.flatnonzero(lengths)
    ends = np.cumsum(lengths)
    before = np.roll(after, 1)
    before[(ends - lengths)[some]] = BEGIN
    last = np.zeros(len(texts), np.int64)
    last[some] = after[ends[some] - 1]
    at = np.repeat(np.arange(len(texts)), lengths)
    # A block has at most BLOCK words and BLOCK_TEXTS texts, or one text: 63 bits are enough.
    bits = int(after.max(initial=BEGIN)).bit_length()
    codes = at << 2 * bits | after << bits | before
    codes.sort()
    del before, after, at
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    times = np.diff(first, append=len(codes))
    codes = codes[first]
    before, after, at = codes & (1 << bits) - 1, codes >> bits & (1 << bits) - 1, codes >> 2 * bits
    first = np.flatnonzero(np.diff(codes >> bits, prepend=-1))
    own = np.add.reduceat(times, first) if len(first) else times
    # The words of each text: how often it has them, alone and as a context.
    word_at, word = at[first], after[first]
    around = own - (word == last[word_at])
    sums = np.zeros((len(texts), 2))
    known = np.flatnonzero(word < BASE)
    k_at, k_word, k_own, k_around = word_at[known], word[known], own[known], around[known]
    for side, left_out in enumerate((np.ones(len(texts), np.int64), wanted.astype(np.int64))):
        without = left_out[k_at]
        gains = k_own * np.log(
            frequent.singles(side, frequent.word_counts[k_word, side] - without * k_own, lengths[k_at], without)
        ) - k_around * frequent.contexts(side, frequent.context_counts[k_word, side] - without * k_around)
        begins = frequent.contexts(side, frequent.context_counts[BEGIN, side] - left_out)
        sums[:, side] = np.bincount(k_at, gains, len(texts)) - begins
    sizes = lengths << 1 | wanted
    own_of_pair = np.repeat(own, np.diff(first, append=len(codes)))
    rare = np.flatnonzero(word >= BASE)
    records = np.empty((len(_RECORD), len(codes) + len(rare)), np.int32)
    for row, x in enumerate((at, sizes[at], after, before, times, own_of_pair)):
        records[row, : len(codes)] = x
    for row, x in enumerate((word_at[rare], sizes[word_at[rare]], word[rare], RARE, around[rare], own[rare])):
        records[row, len(codes) :] = x
    return records, sums


def _by_bucket(frequent: Frequent, records: np.ndarray, rare: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(bucket, records, rare words that they name) of a block, by text; bucket -1 has the bigrams of heads.

    Records with a rare word go where that word belongs, by its next word first: so the bucket of a rare word sees each
    text that has it, and the bucket of a bigram each text that has that.
    """
    at, _, after, before, _, _ = records
    homes = np.fromiter((zlib.crc32(w) % frequent.buckets for w in rare), np.int64, len(rare))
    mixed = (after.astype(np.uint64) * np.uint64(BASE) + before.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    bucket = (mixed % np.uint64(frequent.buckets)).astype(np.int64)
    bucket[(after <= frequent.heads) & (before <= frequent.heads) & (before >= BEGIN)] = -1
    for word in (before, after):
        named = np.flatnonzero(word >= BASE)
        bucket[named] = homes[word[named] - BASE]
    order = np.argsort((bucket + 1) << 32 | at, kind="stable")
    records, bucket = records[:, order], bucket[order]
    # The rare words are numbered anew in each bucket.
    places = [(row, np.flatnonzero(records[row] >= BASE)) for row in (2, 3)]
    named = np.concatenate([bucket[i] << 32 | (records[row, i] - BASE) for row, i in places])
    names, number = np.unique(named, return_inverse=True)
    start, starts = 0, np.searchsorted(names >> 32, np.arange(frequent.buckets + 1))
    for row, i in places:
        records[row, i] = BASE + number[start : start + len(i)] - starts[bucket[i]]
        start += len(i)
    found, first = np.unique(bucket, return_index=True)
    for b, part in zip(found.tolist(), np.split(records, first[1:], axis=1)):
        yield b, part, [rare[i] for i in (names[starts[b] : starts[b + 1]] & 0xFFFFFFFF).tolist()] if b >= 0 else []


_SPREAD = (
    "block long, bucket int, at int, words long, wanted boolean, background double, target double, n int, raw int, "
    "heads binary, data binary"
)


def _spread(docs: DataFrame, targets: DataFrame, frequent: Frequent, key: str, text: str, keep_text: bool) -> DataFrame:
    """Each text taken apart once, staged.  Rows of three kinds, all with the block that they are from: a text's (with
    ``at``; its columns as c0, c1 ..., words and sums), a block's records for a bucket (``data``), and those of its bigrams
    of heads (``heads``)."""
    # Numbered, as names may clash with those added here.
    kept = [(i, c) for i, c in enumerate(docs.columns) if keep_text or c != text]
    numbered = [quoted(c).alias(f"c{i}") for i, c in kept]
    rows = _marked(docs, targets, key, *numbered, quoted(text).cast("binary").alias("text"))
    schema = StructType([*rows.select(*[F.col(f"c{i}") for i, _ in kept]).schema, *StructType.fromDDL(_SPREAD)])
    for field in schema:
        field.nullable = True
    sent, names = docs.sparkSession.sparkContext.broadcast(frequent), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        numbers = once_per_worker(("lm", frequent.key), lambda: _Numbers(frequent.words))
        numbers.forget()  # what a task that failed has left
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        block, size = TaskContext.get().partitionId() << 32, 0

        def taken(count: int, **columns) -> pa.RecordBatch:
            """A batch of ``count`` rows, with nulls in all other columns."""
            return pa.RecordBatch.from_arrays(
                [columns[c] if c in columns else pa.nulls(count, types[c]) for c in names], names
            )

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal block, size, held, texts
            rows = pa.Table.from_batches(held).combine_chunks()
            wanted = rows["wanted"].to_numpy(zero_copy_only=False).astype(np.int64)
            records, sums = _taken_apart(frequent, texts, wanted)
            lengths = np.array([len(t) for t in texts], np.int64)
            column = lambda c: rows[c].chunk(0) if rows[c].num_chunks else pa.nulls(0, types[c])
            n, own = len(texts), {c: column(c) for c in (*names, "wanted") if c in rows.column_names}
            empty = lengths == 0
            yield taken(
                n, **own, block=pa.repeat(pa.scalar(block, pa.int64()), n), at=pa.array(np.arange(n, dtype=np.int32)),
                words=pa.array(lengths), background=pa.array(sums[:, 0], mask=empty), target=pa.array(sums[:, 1], mask=empty),
            )
            for bucket, part, words in _by_bucket(frequent, records, numbers.rare):
                raw, data = _to_bytes(part, words)
                where = {"heads": pa.array([data], pa.binary())} if bucket < 0 else {
                    "bucket": pa.array([bucket], pa.int32()), "data": pa.array([data], pa.binary())
                }
                yield taken(
                    1, block=pa.array([block], pa.int64()), n=pa.array([part.shape[1]], pa.int32()),
                    raw=pa.array([raw], pa.int32()), **where,
                )
            numbers.forget()
            block, size, held, texts = block + 1, 0, [], []
            del rows, own, records
            give_back(("lm", frequent.key))

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            if not types:
                types = {f.name: f.type for f in batch.schema} | dict(
                    block=pa.int64(), bucket=pa.int32(), at=pa.int32(), words=pa.int64(), background=pa.float64(),
                    target=pa.float64(), n=pa.int32(), raw=pa.int32(), heads=pa.binary(), data=pa.binary(),
                )
            start, others = 0, batch.select([c for c in batch.schema.names if c != "text"])
            for i, value in enumerate(batch.column("text")):
                words = _split(value.as_py())
                if texts and (size + len(words) > BLOCK or len(texts) >= BLOCK_TEXTS):
                    held.append(others.slice(start, i - start))
                    yield from flushed()
                    start = i
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(words)
            held.append(others.slice(start))
        if texts:
            yield from flushed()
        give_back()

    return stage(rows.mapInArrow(run, schema))


# --- scores -------------------------------------------------------------------------------------------
def _gains(frequent: Frequent, records: np.ndarray, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What counts of bigrams (``pairs``) add to both sums of their texts, with the counts of their next ``words``."""
    _, size, _, _, times, own = records
    out = np.zeros((records.shape[1], 2))
    for side, without in enumerate((np.ones(len(size), np.int64), size & 1)):
        counts = np.maximum(pairs[:, side] - without * times, 0)
        some = np.flatnonzero(counts > 0)
        o, k = without[some], times[some]
        singles = frequent.singles(side, words[some, side] - o * own[some], size[some] >> 1, o)
        out[some, side] = k * np.log1p(frequent.scales[side] * counts[some] / singles)
    return out


_SUMS = "block long, n int, sums binary"


def _by_text(places: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of equal places, which lie beside each other; texts that gain nothing are left out."""
    first = np.flatnonzero(np.diff(places, prepend=-1))
    totals = np.add.reduceat(gains, first, axis=0) if len(first) else gains
    some = np.flatnonzero(totals.any(axis=1))
    return places[first[some]], totals[some]


def _by_block(blocks: np.ndarray, places: np.ndarray, sums: np.ndarray) -> dict[str, pa.Array]:
    """The ``_SUMS`` of texts at ``places``: number of the block in ``blocks`` and place in the block, in this order."""
    found, first = np.unique(places >> 32, return_index=True)
    at = np.split(places & 0xFFFFFFFF, first[1:])
    data = [_sums_to_bytes(a, s) for a, s in zip(at, np.split(sums, first[1:]))] if len(found) else []
    return {
        "block": pa.array(blocks[found], pa.int64()), "n": pa.array([len(a) for a in at][: len(found)], pa.int32()),
        "sums": pa.array(data, pa.binary()),
    }


def _head_counts(spread: DataFrame, frequent: Frequent) -> np.ndarray:
    """How often the heads follow each other, in all and in target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((heads * heads, 2))
        for batch in batches:
            for row in batch.to_pylist():
                _, size, after, before, times, _ = _from_bytes(row["n"], row["raw"], row["heads"])[0]
                place = (after.astype(np.int64) - BEGIN) * heads + before - BEGIN
                counts[:, 0] += np.bincount(place, times, len(counts))
                counts[:, 1] += np.bincount(place, times * (size & 1), len(counts))
        some = np.flatnonzero(counts[:, 0])
        n, t = counts[some].astype(np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n), pa.array(t)], ["place", "n", "t"])

    heads, out = frequent.heads, np.zeros((frequent.heads**2, 2))
    rows = spread.filter(F.col("heads").isNotNull()).select("n", "raw", "heads").mapInArrow(run, "place int, n long, t long")
    found = rows.groupBy("place").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    out[found["place"].to_numpy()] = np.stack([found["n"].to_numpy(), found["t"].to_numpy()], axis=1)
    return out


def _more(model: Model, asked: DataFrame) -> DataFrame:
    """(block, at, more_background, more_target): what counts of bigrams, and rare words, add to the sums of the texts of
    ``asked``, which is spread like those of the model, or is the same."""
    same = asked is model.spread
    context, frequent = asked.sparkSession.sparkContext, model.frequent
    sent, heads = context.broadcast(frequent), context.broadcast(_head_counts(model.spread, frequent))

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                records, _ = _from_bytes(row["n"], row["raw"], row["heads"])
                pairs = heads.value[frequent.head(records[3], records[2])]
                gains = _gains(frequent, records, pairs, frequent.word_counts[records[2]])
                yield pa.RecordBatch.from_pydict(_by_block(np.array([row["block"]]), *_by_text(records[0].astype(np.int64), gains)))

    def of_group(rows: pa.Table) -> pa.Table:
        blocks, number = np.unique(rows["block"].to_numpy(), return_inverse=True)
        rows = rows.append_column("number", pa.array(number))
        buckets = rows["bucket"].to_numpy()
        found = []
        for b in np.unique(buckets):
            found.append(of_bucket(rows.filter(pa.array(buckets == b))))
            give_back()
        places, which = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        gains = np.concatenate([g for _, g in found])
        sums = np.stack([np.bincount(which, gains[:, side], len(places)) for side in (0, 1)], axis=1)
        return pa.table(_by_block(blocks, places, sums))

    def of_bucket(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The places of texts and what the bucket adds to their sums."""
        frequent = sent.value
        rare: dict[bytes, int] = {}
        parts = []
        for n, raw, data in zip(*(rows[c].to_pylist() for c in ("n", "raw")), rows["data"]):
            records, words = _from_bytes(n, raw, data.as_py())
            number = np.array([rare.setdefault(w, len(rare)) for w in words], np.int32)
            for word in records[2:4]:
                named = np.flatnonzero(word >= BASE)
                word[named] = BASE + number[word[named] - BASE]
            parts.append(records)
        lengths = np.array([p.shape[1] for p in parts])
        records = np.concatenate(parts, axis=1)
        del parts
        counted, is_asked = (np.repeat(rows[c].to_numpy(zero_copy_only=False), lengths) for c in ("counted", "asked"))
        at, size, after, before, times, own = records
        # The rare words, alone and as contexts; a text's other words are held.
        words, contexts = np.zeros((BASE + len(rare), 2)), np.zeros((BASE + len(rare), 2))
        words[: len(frequent.words) + 2] = frequent.word_counts
        alone = np.flatnonzero(before == RARE)
        for side, which in enumerate((counted[alone], counted[alone] & (size[alone] & 1 > 0))):
            i = alone[which]
            words[BASE:, side] = np.bincount(after[i] - BASE, own[i], len(rare))
            contexts[BASE:, side] = np.bincount(after[i] - BASE, times[i], len(rare))
        gains = np.zeros((len(at), 2))
        alone = alone[is_asked[alone]]
        a_after, a_own, a_times = after[alone], own[alone], times[alone]
        for side, without in enumerate((np.ones(len(alone), np.int64), size[alone] & 1)):
            singles = frequent.singles(side, words[a_after, side] - without * a_own, size[alone] >> 1, without)
            around = frequent.contexts(side, contexts[a_after, side] - without * a_times)
            gains[alone, side] = a_own * np.log(singles) - a_times * around
        # The bigrams, those of the same two words beside each other.
        pairs = np.flatnonzero(before != RARE)
        codes = after[pairs].astype(np.int64) << 32 | before[pairs]
        order = np.argsort(codes)
        pairs, codes = pairs[order], codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        if len(first):
            repeats = np.diff(first, append=len(codes))
            n = np.where(counted[pairs], times[pairs], 0)
            totals = np.stack([np.add.reduceat(x, first) for x in (n, n * (size[pairs] & 1))], axis=1)
            # One that occurs in a single text is known to that text only, which is asked without it.
            some = np.repeat((repeats > 1), repeats) & is_asked[pairs]
            totals, pairs = np.repeat(totals, repeats, axis=0)[some], pairs[some]
            gains[pairs] = _gains(frequent, records[:, pairs], totals, words[after[pairs]])
        return _by_text(np.repeat(rows["number"].to_numpy(), lengths) << 32 | at, gains)

    def added(rows: pa.Table) -> pa.Table:
        found = [_sums_from_bytes(n, x.as_py()) for n, x in zip(rows["n"].to_pylist(), rows["sums"])]
        at, sums = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        n = int(at.max()) + 1
        return pa.table({
            "block": pa.repeat(rows["block"][0], n), "at": pa.array(np.arange(n, dtype=np.int32)),
            "more_background": np.bincount(at, sums[:, 0], n), "more_target": np.bincount(at, sums[:, 1], n),
        })

    def in_buckets(spread: DataFrame, counted: bool, is_asked: bool) -> DataFrame:
        rows = spread.filter(F.col("bucket").isNotNull()).select("bucket", "block", "n", "raw", "data")
        return rows.withColumns({"counted": F.lit(counted), "asked": F.lit(is_asked)})

    records = in_buckets(asked, same, True)
    if not same:
        records = records.unionByName(in_buckets(model.spread, True, False))
    cores = asked.sparkSession.sparkContext.defaultParallelism
    group = F.expr(f"bucket div {max(1, min(GROUP, frequent.buckets // cores))}").alias("group")
    sums = records.groupBy(group).applyInArrow(of_group, _SUMS)
    held = asked.filter(F.col("heads").isNotNull()).select("block", "n", "raw", "heads").mapInArrow(of_heads, _SUMS)
    schema = "block long, at int, more_background double, more_target double"
    return sums.unionByName(held).groupBy("block").applyInArrow(added, schema)


FIELDS = ("n_lm_words", "background_loss", "target_loss", "difference")


def score(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the mean loss per word under both models and their ``difference``: low is like the target.

    Both are bigram models with the same vocabulary, bigrams, smoothing, counting and, by weight, size; they know every
    word and every bigram.  No text is judged by counts of its own: the background is asked
    without them, and so is the target for texts that belong to it.  Null and empty texts have 0 words and null losses;
    without targets all words have equal shares in the target.  Rows with a null key are no targets; rows that repeat a
    key are targets together.  Columns of these names are replaced; the rows are staged, without their text on request.
    """
    model = model or train(docs, targets, key, text, keep_text)
    source = (docs, targets, key, text, keep_text)
    asked = model.spread if model.is_of(source) else _spread(docs, targets, model.frequent, key, text, keep_text)
    joined = asked.filter(F.col("at").isNotNull()).join(_more(model, asked), ["block", "at"], "left")
    loss = {v: -(F.col(v) + F.coalesce(f"more_{v}", F.lit(0.0))) / F.col("words") for v in ("background", "target")}
    fields = (F.col("words"), loss["background"], loss["target"], loss["target"] - loss["background"])
    replaced = {f.lower() for f in FIELDS}
    kept = [(i, c) for i, c in enumerate(docs.columns) if keep_text or c != text]
    back = [F.col(f"c{i}").alias(c) for i, c in kept if c.lower() not in replaced]
    return joined.select(*back, *[value.alias(name) for value, name in zip(fields, FIELDS)])


def op10_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents labelled as good and not toxic; background: all documents."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    targets = labels.filter("quality = 1 and toxic = 0").select("doc_id")
    found = score(docs, targets, model=train(docs, targets), keep_text=False)
    return found.select("doc_id", "n_lm_words", *[F.round(c, 9).alias(c) for c in FIELDS[1:]])
