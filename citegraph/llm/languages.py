"""Language identification: a linear-chain conditional random field labels the words of a text."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import add_fields, give_back, once_per_worker, quoted, table

#: Slots of hashed features; each language has one weight per slot.
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
#: The training sample: texts per language, texts in all, characters taken from a text.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS, SAMPLE_CHARACTERS = 120, 6000, 3000
#: Words per language in the lexicon, which comes from the sample too.
LEXICON = 5000
EPOCHS, BATCH, LENGTH, RATE = 4, 256, 32, 0.3
#: Words that go through one step of the recursions together; documents are cut into stretches of that many words.
STRETCH = 64
#: Words whose scores a worker keeps.
REMEMBERED = 200_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+").findall


_BASE = np.uint64(0x9E3779B97F4A7C15)
_OPEN, _CLOSE = ord("^"), ord("$")  # no word holds these


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of the hashed features of many words, in the order of the words.

    A word in lower case stands between two marks.  Its features are all 2- to 4-grams, those that touch a mark being
    the affixes of one to three letters, and the whole word.
    """
    marked = ("^" + "$^".join([w.lower() for w in words]) + "$").encode("utf-32-le", "surrogatepass")
    letters = np.frombuffer(marked, np.uint32).astype(np.uint64)
    owner = np.cumsum(letters == _OPEN) - 1
    closed = letters == _CLOSE
    slots, owners = [], []
    code, inside = letters, np.ones(len(letters), bool)
    for n in (2, 3, 4):
        code = code[:-1] * _BASE + letters[n - 1 :]
        inside = inside[:-1] & ~closed[n - 2 : len(letters) - 1]
        slots.append(code[inside] + np.uint64(n))
        owners.append(owner[: len(code)][inside])
    starts = np.flatnonzero(letters == _OPEN)
    place = (np.arange(len(letters)) - starts[owner]).astype(np.uint64)
    slots.append(np.add.reduceat(letters * (place * _BASE | np.uint64(1)), starts))
    owners.append(np.arange(len(words)))
    mixed = np.concatenate(slots)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed[order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), owner[order]


class Field:
    """Weights of the features, transitions between languages and the start, and the lexicon."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        # The last k slots say in which language's lexicon a word is.
        self.weights = np.zeros((SLOTS + k, k), np.float32)
        self.moves, self.start = np.zeros((k, k)), np.zeros(k)
        self.key = uuid.uuid4().hex

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slot, word number), in the order of the words; listed words have one more."""
        slots, owner = word_features(words)
        listed = [(SLOTS + self.lexicon[w], i) for i, w in enumerate(x.lower() for x in words) if w in self.lexicon]
        if listed:
            more = np.array(listed)
            slots, owner = np.concatenate([slots, more[:, 0]]), np.concatenate([owner, more[:, 1]])
            order = np.argsort(owner, kind="stable")
            slots, owner = slots[order], owner[order]
        return slots, owner

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, k): the sum of each word's weights over the root of their number."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        # Some thousand words at a time, as a word has dozens of features.
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            slots, owner = self.features(part)
            firsts = np.searchsorted(owner, np.arange(len(part)))
            sums = np.add.reduceat(self.weights[slots], firsts, axis=0)
            out[start : start + len(part)] = sums / np.sqrt(np.bincount(owner).astype(np.float32))[:, None]
        return out


def _posteriors(scores: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences (n, length, k): label posteriors, summed expected moves."""
    n, length, k = scores.shape
    step = np.exp(moves - moves.max())
    emitted = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, behind = np.empty_like(emitted), np.ones_like(emitted)
    now = np.exp(start - start.max()) * emitted[:, 0]
    for t in range(length):
        if t:
            now = (now @ step) * emitted[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[:, t] = now
    expected = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        later = emitted[:, t] * behind[:, t]
        pair = ahead[:, t - 1, :, None] * step * later[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        before = later @ step.T
        behind[:, t - 1] = before / before.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=2, keepdims=True), expected


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Field:
    """Train on (language, text) pairs.

    Every word of a text carries its language.  Sequences are put together from runs of 2 to 20 words of texts in random
    languages, so that moves between languages are seen; half of them stay in one language.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({language for language, _ in samples})
    number = {language: i for i, language in enumerate(languages)}
    texts = [[] for _ in languages]
    counts = [Counter() for _ in languages]
    for language, text in sorted(samples):
        words = _WORDS(text)
        if words:
            texts[number[language]].append(words)
            counts[number[language]].update(w.lower() for w in words)
    # A lexicon holds the frequent words that are mostly seen in its language.
    total, lexicon = Counter(), {}
    for c in counts:
        total.update(c)
    for i, c in enumerate(counts):
        for word, times in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if times >= 3 and times >= 0.8 * total[word]:
                lexicon[word] = i
    field = Field(languages, lexicon)
    k = len(languages)
    pools = [t for t in texts if t]
    if k < 2 or not pools:
        return field
    numbers: dict[str, int] = {}
    streams = [np.array([numbers.setdefault(w, len(numbers)) for text in t for w in text], np.int64) for t in texts]
    held = [i for i in range(k) if len(streams[i])]
    sequences = max(BATCH, sum(map(len, streams)) // LENGTH)
    words, labels = np.empty((sequences, LENGTH), np.int64), np.empty((sequences, LENGTH), np.int64)
    for s in range(sequences):
        at, language = 0, held[s % len(held)]
        while at < LENGTH:
            run = LENGTH if s // len(held) % 2 else int(rng.integers(2, 21))
            run = min(run, LENGTH - at)
            begin = int(rng.integers(0, max(1, len(streams[language]) - run)))
            words[s, at : at + run] = np.resize(streams[language][begin : begin + run], run)
            labels[s, at : at + run] = language
            at += run
            language = held[int(rng.integers(len(held)))]
    flat, owner = field.features(list(numbers))
    sizes = np.bincount(owner)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scale = 1 / np.sqrt(sizes)
    seen = np.full(field.weights.shape, 1e-3, np.float64)
    seen_moves, seen_start = np.full((k, k), 1e-3), np.full(k, 1e-3)
    onehot = np.eye(k)
    for _ in range(EPOCHS):
        order = rng.permutation(sequences)
        for part in np.array_split(order, max(1, sequences // BATCH)):
            used, which = np.unique(words[part], return_inverse=True)
            lengths = sizes[used]
            bounds = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat_ids = flat[np.repeat(starts[used] - bounds, lengths) + np.arange(lengths.sum())]
            scores = np.add.reduceat(field.weights[flat_ids], bounds, axis=0) * scale[used, None]
            scores = scores[which.reshape(-1)].reshape(len(part), LENGTH, k).astype(np.float64)
            beliefs, expected = _posteriors(scores, field.moves, field.start)
            truth = onehot[labels[part]]
            wrong = (truth - beliefs).reshape(-1, k)
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, which.reshape(-1), wrong)
            pushed = np.repeat(per_word * scale[used, None], lengths, axis=0)
            slots, slot_of = np.unique(flat_ids, return_inverse=True)
            gradient = np.zeros((len(slots), k))
            for j in range(k):
                gradient[:, j] = np.bincount(slot_of, pushed[:, j], len(slots))
            gradient -= 1e-3 * field.weights[slots]
            seen[slots] += gradient**2
            field.weights[slots] += RATE * gradient / np.sqrt(seen[slots])
            moved = np.zeros((k, k))
            np.add.at(moved, (labels[part][:, :-1].ravel(), labels[part][:, 1:].ravel()), 1)
            for parameter, accumulated, gradient in (
                (field.moves, seen_moves, moved - expected),
                (field.start, seen_start, (truth[:, 0] - beliefs[:, 0]).sum(axis=0)),
            ):
                accumulated += gradient**2
                parameter += RATE * gradient / np.sqrt(accumulated)
    return field


# --- labelling ----------------------------------------------------------------------------------------
def label(field: Field, emissions: list[np.ndarray], labels: bool = False) -> tuple[np.ndarray, list]:
    """Mean posterior of each language for every sequence of emissions (words, k); the best label of each word.

    The recursions are exact and run over all sequences at once.  Sequences are cut into stretches; first every stretch is
    summed up in one matrix, then the stretches of a sequence are chained, then all are gone through again with
    what reaches them from both sides.  So a long text takes as many steps as a short one plus one per stretch.
    """
    k = len(field.languages)
    sizes = np.array([len(e) for e in emissions])
    parts = -(-sizes // STRETCH)
    first = np.concatenate([[0], np.cumsum(parts)])
    n = int(first[-1])
    if not n:
        return np.zeros((len(emissions), k)), [np.empty(0, np.int64)] * len(emissions)
    scores = np.zeros((n, STRETCH, k), np.float32)
    used = np.zeros((n, STRETCH), bool)
    for i, e in enumerate(emissions):
        scores[first[i] : first[i + 1]].reshape(-1, k)[: len(e)] = e
        used[first[i] : first[i + 1]].reshape(-1)[: len(e)] = True
    emitted = np.exp(scores - scores.max(axis=2, keepdims=True))
    emitted[~used] = 1
    step = np.exp(field.moves - field.moves.max()).astype(np.float32)
    heads = np.zeros(n, bool)
    heads[first[:-1][parts > 0]] = True
    start = np.exp(field.start - field.start.max()).astype(np.float32)

    whole = np.broadcast_to(np.eye(k, dtype=np.float32), (n, k, k)).copy()
    for t in range(STRETCH):
        moved = whole @ step
        if t == 0:
            moved[heads] = whole[heads]
        moved = moved * emitted[:, t, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        whole = np.where(used[:, t, None, None], moved, whole)
    # What reaches each stretch from the left, and what lies to the right of it.
    left, right = np.empty((n, k), np.float32), np.ones((n, k), np.float32)
    longest = int(parts.max())
    now = np.broadcast_to(start, (len(emissions), k)).copy()
    for p in range(longest):
        has = np.flatnonzero(parts > p)
        at = first[has] + p
        left[at] = now[has]
        onward = (now[has][:, None, :] @ whole[at])[:, 0]
        now[has] = onward / onward.sum(axis=1, keepdims=True)
    now = np.ones((len(emissions), k), np.float32)
    for p in range(longest - 1, -1, -1):
        has = np.flatnonzero(parts > p)
        at = first[has] + p
        right[at] = now[has]
        back = (whole[at] @ now[has][:, :, None])[:, :, 0]
        now[has] = back / back.sum(axis=1, keepdims=True)

    ahead = np.empty((STRETCH, n, k), np.float32)
    now = left
    for t in range(STRETCH):
        moved = now @ step
        if t == 0:
            moved[heads] = now[heads]
        moved = moved * emitted[:, t]
        moved /= moved.sum(axis=1, keepdims=True)
        now = np.where(used[:, t, None], moved, now)
        ahead[t] = now
    summed = np.zeros((n, k))
    best = np.zeros((n, STRETCH), np.int64) if labels else None
    now = right
    for t in range(STRETCH - 1, -1, -1):
        belief = ahead[t] * now
        belief /= belief.sum(axis=1, keepdims=True)
        summed += np.where(used[:, t, None], belief, 0)
        if labels:
            best[:, t] = belief.argmax(axis=1)
        later = (emitted[:, t] * now) @ step.T
        later /= later.sum(axis=1, keepdims=True)
        now = np.where(used[:, t, None], later, now)
    means = np.zeros((len(emissions), k))
    np.add.at(means, np.repeat(np.arange(len(emissions)), parts), summed)
    means /= np.maximum(sizes, 1)[:, None]
    if not labels:
        return means, []
    return means, [best[first[i] : first[i + 1]].reshape(-1)[: sizes[i]] for i in range(len(emissions))]


def training_sample(docs: DataFrame, text: str, language: str, training: Column) -> list[tuple[str, str]]:
    """At most ``SAMPLE_TEXTS`` (language, stretch of text) pairs of the rows that ``training`` lets through.

    Distinct texts are drawn by a hash, the same number for each language, so copies count once and the result does not
    depend on how the rows are dealt out.
    """
    known = docs.filter(training & quoted(language).isNotNull() & quoted(text).isNotNull())
    hashed = known.select(quoted(language).alias("language"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("t"))
    sizes = hashed.groupBy("language").agg(F.approx_count_distinct("h").alias("texts"))
    names = sizes.count()
    if not names:
        return []
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // names))
    # Most texts drop out by their hash alone, before those of one language meet: about twice as many as are needed stay.
    chance = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    lucky = hashed.select("language", "h").join(sizes, "language").filter(chance * F.col("texts") < 2 * each)
    order = F.row_number().over(Window.partitionBy("language").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    drawn = lucky.select("language", "h").distinct().withColumn("place", order).filter(F.col("place") <= each)
    # At most SAMPLE_TEXTS rows, or one for each language if there are more of these.
    chosen = hashed.join(F.broadcast(drawn.drop("place")), ["language", "h"])
    spare = F.greatest(F.length("t") - SAMPLE_CHARACTERS, F.lit(0)) + 1
    begin = (F.pmod(F.col("h"), spare) + 1).cast("int")
    taken = chosen.select("language", "h", F.substr("t", begin, F.lit(SAMPLE_CHARACTERS)).alias("t"))
    rows = taken.groupBy("language", "h").agg(F.min("t").alias("t")).collect()
    return [(r.language, r.t) for r in rows]


FIELDS = ("lang_pred", "score")


def identify(docs: DataFrame, field: Field, text: str = "text", segments: str | None = None) -> DataFrame:
    """``docs`` with the language of each whole text, ``lang_pred``, and its mean word posterior, ``score`` (0 to 1).

    Null texts and texts without a letter are "und" with score 0, and so are all if the field knows no language.
    ``segments`` names a column for the labelled runs of words (first, last, language), words counted from 0; a null or
    empty text has none.  Ties go to the language that sorts first.  Columns of these names are replaced, others and
    repeated rows stay.  Work is linear in the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    key, k = field.key, len(field.languages)
    block = max(STRETCH, 2_000_000 // max(1, k * k))
    run = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("language", pa.string())])

    def runs(best: np.ndarray, languages: list[str]) -> list[dict]:
        if not len(best):
            return []
        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
        return [{"first": a, "last": b - 1, "language": languages[best[a]]} for a, b in zip(cuts, cuts[1:])]

    @F.arrow_udf("lang_pred string, score double, segments array<struct<first:long,last:long,language:string>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        known = once_per_worker(("languages", key), dict)
        for texts in batches:
            predicted, scores, found = [], [], []
            held: list[list[str]] = []

            def settle() -> None:
                new = [w for w in set(chain.from_iterable(held)) if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    # What is no longer held is computed again.
                    known.clear()
                    new = list(set(chain.from_iterable(held)))
                rows = model.emissions(new)
                known.update(zip(new, map(np.ndarray.tobytes, rows)))
                emissions = [np.frombuffer(b"".join([known[w] for w in ws]), np.float32).reshape(-1, max(1, k)) for ws in held]
                means, best = label(model, emissions, segments is not None)
                for i, mean in enumerate(means):
                    top = int(mean.argmax()) if held[i] else None
                    predicted.append(UNKNOWN if top is None else model.languages[top])
                    scores.append(0.0 if top is None else float(min(1.0, mean[top])))
                    found.append(runs(best[i], model.languages) if segments is not None else None)
                held.clear()

            words_held = 0
            for scalar in texts:
                value = scalar.as_py()
                words = _WORDS(value) if value and k else []
                if words and not any(c.isalpha() for w in words for c in w):
                    words = []
                held.append(words)
                words_held += len(words) + STRETCH
                if words_held >= block:
                    settle()
                    words_held = 0
            if held:
                settle()
            give_back(("languages", key))
            yield pa.StructArray.from_arrays(
                [pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(found, pa.list_(run))],
                ["lang_pred", "score", "segments"],
            )

    made = predict(F.col(text))
    added = [made["lang_pred"].alias("lang_pred"), made["score"].alias("score")]
    names = [*FIELDS]
    if segments:
        added.append(made["segments"].alias(segments))
        names.append(segments)
    return add_fields(docs, F.struct(*added), names)


def held_out(key: str) -> Column:
    """One row in five is never learned from."""
    return F.coalesce(F.crc32(quoted(key).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Field:
    """A field fitted on a bounded sample of the rows that have a language and are not held out."""
    may = F.crc32(quoted(key).cast("string")) % 5 != 0
    return fit(training_sample(docs, text, language, may))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
