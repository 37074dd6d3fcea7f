"""How far the sources of a language differ in their use of terms, with pair sums over a frequent-pattern tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import quoted, stage, table, text_pieces

#: Shares are whole numbers out of SCALE, so that their squares fit into 64 bits.
SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Distinct terms that a counting task holds, and node-ancestor combinations that a tree task holds, before it passes
#: their sums on.
HELD, COMBINATIONS = 200_000, 1 << 17
#: A counter's number holds the rows above this bit, and the occurrences in them below.
ROWS = 40

# ASCII letters and everything beyond ASCII; in UTF-8 the latter are the bytes from 128 on.
_TERM, _BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


# --- counting -----------------------------------------------------------------------------------------
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): what each task has counted, several rows for a term."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    distinct, row = 0, 1 << ROWS

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            both = np.fromiter(counts.values(), np.int64, len(counts))
            columns = [
                pa.repeat(lang, len(counts)), pa.repeat(source, len(counts)),
                pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(both & (row - 1)), pa.array(both >> ROWS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            counts = held.setdefault((lang, source), {})
            own: Counter = Counter()
            for piece in text_pieces(text.as_py().lower(), _BREAK):  # bytes: only A-Z change
                own.update(_TERM.findall(piece))
            before, known = len(counts), counts.get
            for term, n in own.items():
                counts[term] = known(term, 0) + n + row
            distinct += len(counts) - before
            if distinct >= HELD:
                yield from flushed()
                distinct = 0
    yield from flushed()


def term_rows(named: DataFrame, least_documents: int) -> DataFrame:
    """(lang, term, source, n, total, first) of the kept terms; ``first`` marks one of a term's rows.

    Tasks add up what they have read; then one exchange by language and term serves both the counts by source and
    their totals.  A term has one row per source there.
    """
    counted = named.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    term = Window.partitionBy("lang", "term")
    return (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({
            "docs": F.sum("docs").over(term), "total": F.sum("n").over(term),
            "first": F.min("source").over(term) == F.col("source"),
        })
        .filter(F.col("docs") >= least_documents)
        .drop("docs")
    )


# --- exact arithmetic ---------------------------------------------------------------------------------
def _share(n: str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + terms)); counts of any size stay exact."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({size} + {terms} as decimal(20,0))"
    )


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _exact_sum(value: str) -> Column:
    return F.sum(F.col(value).cast("decimal(38,0)"))


# --- the tree -----------------------------------------------------------------------------------------
class _Tree:
    """A frequent-pattern tree of which only the open path is held.

    Rows arrive in order, so a node is complete as soon as a row leaves its path.  It then carries the number of terms
    that share the path down to it, and its corrections with all its ancestors are taken once, times that number.
    """

    def __init__(self) -> None:
        self.places, self.shares, self.zeros, self.terms = [], [], [], []
        self.nodes, self.above = [], ([], [], [])

    def close(self, depth: int) -> None:
        """Complete all nodes below ``depth``."""
        while len(self.places) > depth:
            k, n = len(self.places) - 1, self.terms.pop()
            node = (self.places[k], self.shares[k], self.zeros[k], n, k)
            del self.places[k], self.shares[k], self.zeros[k]
            if k:
                self.terms[-1] += n
                self.nodes.append(node)
                for held, path in zip(self.above, (self.places, self.shares, self.zeros)):
                    held.extend(path)

    def insert(self, places: list[int], shares: list[int], zeros: list[int], terms: int) -> None:
        shared, limit = 0, min(len(places), len(self.places))
        while shared < limit and places[shared] == self.places[shared] and shares[shared] == self.shares[shared]:
            shared += 1
        self.close(shared)
        self.places += places[shared:]
        self.shares += shares[shared:]
        self.zeros += zeros[shared:]
        self.terms += [0] * (len(places) - shared)
        self.terms[-1] += terms

    def sums(self, lang: str) -> pa.RecordBatch:
        """Sums of the corrections of complete nodes, for both directions of each pair of sources."""
        nodes = np.array(self.nodes, np.int64).reshape(-1, 5)
        b, pb, zb, n = (np.repeat(c, nodes[:, 4]) for c in nodes.T[:4])
        a, p, za = (np.array(c, np.int64) for c in self.above)
        self.nodes, self.above = [], ([], [], [])

        def gap(p, q):
            return (p - q) ** 2 // q

        one = gap(p, pb) - gap(p, zb) - gap(za, pb) + gap(za, zb)
        two = gap(pb, p) - gap(pb, za) - gap(zb, p) + gap(zb, za)
        first, second = np.concatenate([a, b]), np.concatenate([b, a])
        value = np.concatenate([one * n, two * n])
        order = np.lexsort((second, first))
        first, second, value = first[order], second[order], value[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(value, starts) if len(starts) else value
        columns = [pa.array([lang] * len(starts), pa.string()), *map(pa.array, (first[starts], second[starts], sums))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (lang, path, terms) to sums of (lang, a, b, value)."""
    tree, lang = _Tree(), ""
    for batch in batches:
        items = batch.column("path").flatten()
        places, shares, zeros = (items.field(n).to_pylist() for n in ("place", "p", "zero"))
        ends = np.cumsum(batch.column("path").value_lengths().to_numpy()).tolist()
        start = 0
        for own, stop, terms in zip(batch.column("lang").to_pylist(), ends, batch.column("terms").to_pylist()):
            if own != lang:
                tree.close(0)
                yield tree.sums(lang)
                lang = own
            tree.insert(places[start:stop], shares[start:stop], zeros[start:stop], terms)
            start = stop
            if len(tree.above[0]) >= COMBINATIONS:
                yield tree.sums(lang)
    tree.close(0)
    yield tree.sums(lang)


# --- the audit ----------------------------------------------------------------------------------------
def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source from every other one of its language
    (part ``pair``, item: the other source), and the terms that it uses more than the language does (part ``term``).

    A language keeps the terms that at least ``least_documents`` of its rows contain.  A source's share of a term is
    p = 1 + floor(10^9 (n + 1) / (N + V)): n occurrences, N of all kept terms there, V kept terms.  The distance is the
    sum of floor((p - q)^2 / q) over all kept terms, q being the other source's share; a term's value is the same
    fraction against the share in the whole language, for terms with p > q; the ``top`` of each source are returned.

    A pair's distance is V times the distance of two absent terms, plus what each source's own counts change, plus a
    correction for terms that both contain.  Only the last needs terms and pairs together.  It is summed over a tree
    of the terms' rows (shares by source, larger sources first): rows are grouped, ordered by range and cut into
    partitions, each of which is a piece of the tree; a node counts once for each of its ancestors, however many
    terms pass through it.  Sums are added, so a path cut by a partition's border changes nothing.

    Null text, lang and source count as ''.  Rows count as documents, repeated ones too.  Texts are taken whole, long
    ones piece by piece; empty ones and tables without rows give sources without terms, or nothing.  A source without
    kept terms has distance 0 or that of its even shares; equal values are ranked by the item in UTF-8 order.  Other
    columns are not read.
    """
    named = docs.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = stage(term_rows(named, least_documents))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = rows.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    by_size = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    groups = stage(
        named.select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["size", "terms", "lang_size"])
        .withColumn("place", F.row_number().over(by_size).cast("long"))
        .withColumn("zero", F.when(F.col("terms") > 0, _share("0", "size", "terms")).otherwise(F.lit(1)))
    )
    entries = stage(
        rows.join(groups, ["lang", "source"])
        .select(
            "lang", "source", "term", "place", "zero",
            _share("n", "size", "terms").alias("p"), _share("total", "lang_size", "terms").alias("q"),
        )
    )
    return _pairs(groups, entries).unionByName(_terms(entries, top))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def _terms(entries: DataFrame, top: int) -> DataFrame:
    over = entries.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value")
    )
    return _ranked(over).filter(F.col("rank") <= top)


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    paths = (
        entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "zero"))).alias("path"))
        .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
        .filter(F.size("path") > 1)
    )
    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = ordered.mapInArrow(_pair_corrections, "lang string, a long, b long, value long")

    other = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"), F.col("zero").alias("z"))
    own = entries.groupBy("lang", "place", "p", "zero").agg(F.count(F.lit(1)).alias("n")).join(other, "lang").filter("place <> b")
    forth, back = (F.expr(f"n * ({x} - {y})") for x, y in ((_gap("p", "z"), _gap("zero", "z")), (_gap("z", "p"), _gap("z", "zero"))))
    ways = F.array(
        F.struct(F.col("place").alias("a"), F.col("b").alias("b"), forth.alias("value")),
        F.struct(F.col("b").alias("a"), F.col("place").alias("b"), back.alias("value")),
    )
    single = own.select("lang", F.inline(ways))
    changes = single.unionByName(both).groupBy("lang", "a", "b").agg(_exact_sum("value").alias("change"))

    base = (
        groups.select("lang", "source", F.col("place").alias("a"), "zero", "terms").join(other, "lang").filter("a <> b")
        .select("lang", "source", "a", "b", "item", F.expr(f"cast(terms as decimal(20,0)) * {_gap('zero', 'z')}").alias("base"))
    )
    value = (F.col("base") + F.coalesce("change", F.lit(0))).cast("long")
    pairs = base.join(changes, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return _ranked(pairs)


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents").select("lang", "source", "text"))


ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
tokens AS (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM kept GROUP BY lang),
sized AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v)::HUGEINT AS p,
        1 + ({SCALE}::HUGEINT * (k.total + 1)) // (l.lang_size + l.v)::HUGEINT AS q
    FROM sized s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM sized a JOIN sized b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS bigint) AS value, CAST(rank AS integer) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
