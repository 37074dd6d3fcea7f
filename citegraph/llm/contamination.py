"""Benchmark decontamination by windows of words; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import fresh, quoted, sent_if_small, stage, table, without

# What separates words (fixed value): every ASCII character that is neither a digit nor a letter.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 13
#: Up to so many bytes the windows of all benchmark items are sent to every executor.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _SEPARATORS + "+"), "")


def benchmark_windows(benchmark: DataFrame, text: str, item: str, size: int) -> DataFrame:
    """(gram, length, hash, items): every distinct window with the sorted items it occurs in."""
    name = F.coalesce(F.col(item).cast("string"), F.lit(""))
    split = benchmark.select(name.alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = split.select(
        "item", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("gram")
    )
    return windows.groupBy("length", F.array_join("gram", " ").alias("gram"), F.xxhash64("gram").alias("hash")).agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _window_hits(docs: DataFrame, key: list[str], text: str, windows: DataFrame) -> DataFrame:
    """(key, start, stop, items) of every place in the documents where a window occurs.

    ``key`` says which text it is: rows with equal keys have equal texts.
    """
    size = windows.agg(F.sum(F.length("gram") + F.length(F.array_join("items", ",")) + 64)).first()[0] or 0
    # At most as many lengths as a window has words; without windows any length finds nothing.
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect()) or [1]
    split = docs.select(*key, words(F.col(text)).alias("words"))
    whole = lambda n: F.col("start") + n <= F.size("words")
    hashed = lambda n: F.xxhash64(F.slice("words", F.col("start") + 1, n))

    def places(*also: str) -> DataFrame:
        """(key, also, start, n, h): the hash of every window of every document."""
        placed = split.select(*key, "words", F.posexplode("words").alias("start", "word"))
        if len(lengths) == 1:
            n = lengths[0]
            return placed.filter(whole(n)).select(*key, *also, "start", F.lit(n).alias("n"), hashed(n).alias("h"))
        probes = F.array(*[F.when(whole(n), F.struct(F.lit(n).alias("n"), hashed(n).alias("h"))) for n in lengths])
        placed = placed.select(*key, "words", "start", F.explode(probes).alias("probe")).filter("probe is not null")
        return placed.select(*key, *also, "start", "probe.n", "probe.h")

    # The hash finds, the words themselves decide.
    found = (F.col("h") == F.col("hash")) & (F.col("n") == F.col("length"))
    same = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("gram")
    if size <= BROADCAST_BYTES:
        hits = places("words").join(F.broadcast(windows), found & same)
    else:
        # Only hashes and places are shuffled; the words are fetched for what the hashes have found.
        hits = places().join(windows, found).select(*key, "start", "n", "gram", "items").alias("h")
        equal = [f"h.`{k}` <=> s.`{k}`" for k in key]
        joined = hits.join(split.alias("s"), F.expr(" and ".join(equal))).filter(same)
        hits = joined.select(*[F.col(f"h.`{k}`") for k in key], "start", "n", "items")
    return hits.select(*key, "start", (F.col("start") + F.col("n")).alias("stop"), "items")


def _covered(spans: Column) -> Column:
    """How many words lie in at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    grow = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["last"]))).alias("n"),
        F.greatest(s["last"], x["stop"]).alias("last"),
    )
    return F.aggregate(spans, zero, grow, lambda s: s["n"])


FIELDS = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    benchmark_text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with what they share with the benchmark.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; words are compared with A-Z
    in lower case.  The hashes of all windows are probed with the hash of every window of every document, and the
    words decide.  Added: ``n_words``; ``hit_spans``, the word ranges (start, stop) of found windows; ``n_hit``, the
    words in at least one of them; ``hit_items``, the sorted names of the items found; ``contaminated``, if at least
    one word and one in twenty is hit.

    The table of windows goes to every executor if it has at most ``BROADCAST_BYTES``; beyond that the hashes of the
    documents' windows are shuffled, and words only for those found.  Only hits are shuffled otherwise, grouped by key and a hash of the text, so rows
    that share a key, or lack one, are judged each by its own text, and repeated rows alike.  Null and empty texts and
    items have no words; without items nothing is hit.  A null item name counts as "".  Columns called like the
    added ones are replaced, all others stay.
    """
    mark, name = fresh(docs, "text_hash"), fresh(docs, "row_key")
    marked = docs.select(*without(docs, FIELDS), F.xxhash64(F.col(text)).alias(mark), quoted(key).alias(name))
    marked = marked.withColumn("n_words", F.size(words(F.col(text))))
    windows = benchmark_windows(benchmark, benchmark_text, item, window)
    source = docs.select(quoted(key).alias(name), F.xxhash64(F.col(text)).alias(mark), F.col(text).alias("text"))
    hits = _window_hits(source, [name, mark], "text", windows)
    by_doc = hits.groupBy(name, mark).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("hit_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
    )
    by_doc = by_doc.withColumn("n_hit", _covered(F.col("hit_spans"))).alias("b")
    own = marked.alias("a")
    found = own.join(by_doc, F.expr(f"a.{name} <=> b.{name} and a.{mark} <=> b.{mark}"), "left")
    n_words, n_hit = F.col("a.n_words").cast("long"), F.coalesce("b.n_hit", F.lit(0)).cast("long")
    kept = [F.col(f"a.`{c}`") for c in marked.columns if c not in (mark, name, "n_words")]
    empty = lambda kind: F.array().cast(kind)
    return found.select(
        *kept,
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("b.hit_items", empty("array<string>")).alias("hit_items"),
        F.coalesce("b.hit_spans", empty("array<struct<start:int,stop:int>>")).alias("hit_spans"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, as they are.

    Only the keys of contaminated texts meet the documents; unless these are too many to be sent, no text is shuffled.
    """
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    # The hash is made first, so that the text itself need not pass the join that counts the hits.
    named = fresh(docs, "dirty_hash")
    source = docs.select(quoted(key).alias(key), quoted(text).alias(text), F.xxhash64(quoted(text)).alias(named))
    found = find_contamination(source, benchmark, **options).filter("contaminated")
    dirty = stage(found.select(quoted(key).alias("dirty_key"), F.col(named).alias("dirty_hash")).distinct())
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    same = (F.col("row")[key].eqNullSafe(F.col("dirty_key"))) & (F.xxhash64(F.col("row")[text]) == F.col("dirty_hash"))
    kept = packed.join(sent_if_small(dirty), same, "left_anti")
    return kept.select([F.col("row")[c].alias(c) for c in docs.columns])


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``find_contamination`` with the hit words, and what stands before each, cut out of the text."""
    pieces = F.regexp_extract_all(text, F.lit(f"{_SEPARATORS}*{_WORD}+"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("hit_spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    rest = F.regexp_extract(text, f"{_SEPARATORS}*$", 0)
    return found.withColumn(text, F.when(F.col("n_hit") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col(text)))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SPLIT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH item_words AS (
    SELECT coalesce(CAST(item_id AS varchar), '') AS item, {_SPLIT} AS w FROM benchmark),
grams AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
        unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2),
            lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS gram
    FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
places AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM grams))),
hits AS (SELECT r, item, n, i FROM places JOIN grams USING (n, gram)),
hit_words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
