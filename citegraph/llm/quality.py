"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import add_fields, fresh, quoted, stage, table, without

# Word separators and symbols of the contract (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    distinct = int(codes.max()) + 1
    windows = codes[:-2] * distinct + codes[1:-1]
    if distinct >= 1 << 20:  # three codes would not fit 64 bits
        windows = pd.factorize(windows)[0].astype(np.int64)
    windows = windows * distinct + codes[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(times[which] > 1)
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[repeated + shift] = True
    return int(marked.sum())


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    # Bytes split at exactly the white space meant here.
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the ``FEATURES`` of each whole text; null and empty texts have zeros.

    Columns of these names are replaced, all others and repeated rows stay.
    """

    @F.arrow_udf("struct<" + ",".join(f"{f}:long" for f in FEATURES) + ">")
    def features(texts: pa.Array) -> pa.Array:
        rows = np.fromiter(chain.from_iterable(map(text_features, texts.to_pylist())), np.int64).reshape(-1, len(FEATURES))
        return pa.StructArray.from_arrays([pa.array(column) for column in rows.T], list(FEATURES))

    return add_fields(docs, features(F.col(text)), FEATURES)


# --- sketches -----------------------------------------------------------------------------------------
#: Values up to 2 ** (PRECISION + 1) have a bucket each; larger ones share it with others within 1 / 2 ** PRECISION.
PRECISION = 7


def bucket(value: Column) -> Column:
    """The smallest value of the log-linear bucket that a non-negative integer falls into.

    Bucket counts are a quantile sketch whose merge is addition: the order of merging never changes it.
    """
    shift = F.greatest(F.length(F.bin(value)) - F.lit(PRECISION + 1), F.lit(0)).cast("int")
    low = F.call_function("shiftright", value, shift)
    return F.call_function("shiftleft", low, shift)


# name: (value as a whole number, lowest spread that counts, side).  Ratios are per 1,000 words.  The spread is a floor
# for the distance of the quartiles, so that a group of nearly equal texts does not reject each small difference.
RATIOS = {
    "symbols": ("n_symbols * 1000 div n_words", 100, "high"),
    "dup_lines": ("n_dup_lines * 1000 div n_words", 20, "high"),
    "repeats": ("n_repeat_words * 1000 div n_words", 100, "high"),
    "word_length": ("word_chars * 1000 div n_words", 1000, "both"),
}
#: Groups of fewer rows are judged by their language, and languages of fewer rows by all rows.
LEAST_ROWS = 200
#: Distance from the quartiles, in quartile distances, from which on a value is an outlier.
REACH = 3


def sketches(measured: DataFrame, language: str, source: str) -> DataFrame:
    """(language, source, rule, bucket, rows): one sketch per language, source and rule, over all rows with words."""
    values = [
        F.struct(F.lit(rule).alias("rule"), bucket(F.expr(expression)).alias("bucket"))
        for rule, (expression, _, _) in RATIOS.items()
    ]
    counted = measured.filter("n_words > 0").select(
        quoted(language).alias("language"), quoted(source).alias("source"), F.inline(F.array(*values))
    )
    return counted.groupBy("language", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("rows"))


def quantiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group its rows and, per name, the smallest bucket at or below which that share of its rows lies."""
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("rows").alias("rows"))
    # A sketch has at most a few thousand buckets, however many rows it stands for.
    listed = merged.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "rows"))).alias("buckets"), F.sum("rows").alias("rows")
    )

    def at(share: float) -> Column:
        need = F.ceil(F.col("rows") * F.lit(int(share * 100)) / 100)
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
        step = lambda s, b: F.struct(
            (s["seen"] + b["rows"]).alias("seen"),
            F.coalesce(s["value"], F.when(s["seen"] + b["rows"] >= need, b["bucket"])).alias("value"),
        )
        return F.aggregate("buckets", zero, step, lambda s: s["value"])

    return listed.select(*by, "rows", *[at(share).alias(name) for name, share in shares.items()])


def thresholds(sketch: DataFrame) -> DataFrame:
    """(language, source, limits): for every group the lowest and highest value that passes, by rule.

    The quartiles come from the group's own sketch, or where it has under ``LEAST_ROWS`` rows from the merged sketch of
    its language, or from that of all rows.  A value passes up to ``REACH`` quartile distances beyond the quartiles.
    """
    shares = {"q1": 0.25, "q3": 0.75}
    own = quantiles(sketch, ["language", "source", "rule"], shares).alias("o")
    lang = quantiles(sketch, ["language", "rule"], shares).alias("l")
    every = quantiles(sketch, ["rule"], shares).alias("e")
    joined = own.join(lang, F.expr("o.language <=> l.language and o.rule = l.rule")).join(every, F.expr("o.rule = e.rule"))
    pick = lambda q: F.expr(
        f"case when o.rows >= {LEAST_ROWS} then o.{q} when l.rows >= {LEAST_ROWS} then l.{q} else e.{q} end"
    )
    floors = F.create_map(*[F.lit(x) for rule, (_, floor, _) in RATIOS.items() for x in (rule, floor)])
    limited = joined.select("o.language", "o.source", F.col("o.rule").alias("rule"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    reach = F.lit(REACH) * F.greatest(F.col("q3") - F.col("q1"), floors[F.col("rule")].cast("long"))
    # Rules by name: one row per group, whatever rules there are.
    columns = []
    for rule in RATIOS:
        mine = F.col("rule") == rule
        columns.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"{rule}_low"))
        columns.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"{rule}_high"))
    return limited.groupBy("language", "source").agg(*columns)


def judge(measured: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """The result of ``measure`` with ``base_failed``, ``broken_rules`` (sorted names) and ``kept``.

    The fixed rules fail texts of under 50 words and texts most of whose words are repeated.  All others are compared
    with the limits of their language and source (nulls are groups of their own), which come from sketches over all
    rows.  Null and empty texts fail.  Documents are joined with their limits, one row per language and source; this
    table is left to the engine, as nothing bounds the number of sources.  Columns of these names are replaced, others
    and repeated rows stay.
    """
    measured = measured.select(*without(measured, ("base_failed", "broken_rules", "kept")))
    limits = thresholds(sketches(measured, language, source)).alias("t")
    lang, src = fresh(measured, "group_language"), fresh(measured, "group_source")
    keyed = measured.withColumn(lang, quoted(language)).withColumn(src, quoted(source)).alias("d")
    joined = keyed.join(limits, F.expr(f"d.{lang} <=> t.language and d.{src} <=> t.source"), "left")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    broken = []
    for rule, (expression, _, side) in RATIOS.items():
        value = F.expr(f"case when n_words > 0 then {expression} end")
        bad = value > F.col(f"t.{rule}_high")
        if side == "both":
            bad = bad | (value < F.col(f"t.{rule}_low"))
        broken.append(F.when(bad, F.lit(rule)))
    found = joined.select(
        *[F.col(f"d.`{c}`") for c in measured.columns],
        failed.alias("base_failed"),
        F.sort_array(F.array_compact(F.array(*broken))).alias("broken_rules"),
    )
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def filter_quality(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, as they are; features are staged, so that every text is read once."""
    row = docs.select(
        F.struct("*").alias("row"), quoted(text).alias("text"), quoted(language).alias("lang"), quoted(source).alias("source")
    )
    found = judge(stage(measure(row).drop("text")))
    return found.filter("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    # Sketches and verdicts both need the features; texts are read once.
    measured = stage(measure(docs).drop("text"))
    return judge(measured).select(
        "doc_id", *FEATURES, "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules")
    )


# The same rules in the other engine's words.
_LIST = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_VALUES = ", ".join(f"('{rule}', {floor}, '{side}')" for rule, (_, floor, side) in RATIOS.items())
_BUCKET = "(v >> greatest(len(bin(v)) - {0}, 0)) << greatest(len(bin(v)) - {0}, 0)".format(PRECISION + 1)
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_LIST} AS w FROM documents),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM (
        SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs))),
repeats AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM windows WHERE times > 1) GROUP BY r),
lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
features AS (
    SELECT r, doc_id, lang, source, CAST(len(w) AS bigint) AS n_words,
        CAST(length(array_to_string(w, '')) AS bigint) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS bigint) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS bigint) AS n_repeat_words
    FROM docs LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)),
rules AS (SELECT * FROM (VALUES {_VALUES}) AS t(rule, floor, side)),
ratios AS (
    {" UNION ALL ".join(f"SELECT r, lang, source, '{rule}' AS rule, {expression.replace(' div ', ' // ')} AS v FROM features WHERE n_words > 0" for rule, (expression, _, _) in RATIOS.items())}),
sketch AS (SELECT lang, source, rule, {_BUCKET} AS b FROM ratios),
own AS (
    SELECT lang, source, rule, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3
    FROM sketch GROUP BY ALL),
by_lang AS (
    SELECT lang, rule, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM sketch GROUP BY ALL),
overall AS (SELECT rule, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM sketch GROUP BY ALL),
quartiles AS (
    SELECT o.lang, o.source, o.rule, floor, side,
        CASE WHEN o.n >= {LEAST_ROWS} THEN o.q1 WHEN l.n >= {LEAST_ROWS} THEN l.q1 ELSE e.q1 END AS q1,
        CASE WHEN o.n >= {LEAST_ROWS} THEN o.q3 WHEN l.n >= {LEAST_ROWS} THEN l.q3 ELSE e.q3 END AS q3
    FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule
        JOIN overall e ON e.rule = o.rule JOIN rules u ON u.rule = o.rule),
broken AS (
    SELECT r, string_agg(v.rule, ',' ORDER BY v.rule) AS broken_rules
    FROM ratios v JOIN quartiles q ON v.rule = q.rule AND v.lang IS NOT DISTINCT FROM q.lang
        AND v.source IS NOT DISTINCT FROM q.source
    WHERE v.v > q3 + {REACH} * greatest(q3 - q1, floor) OR side = 'both' AND v.v < q1 - {REACH} * greatest(q3 - q1, floor)
    GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND broken_rules IS NULL AS kept,
    coalesce(broken_rules, '') AS broken_rules
FROM features LEFT JOIN broken USING (r)
"""
