"""Near duplicates: an inverted join over signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import give_back, once_per_worker, quoted, sent_if_small, stage, table

SHINGLE = 5
#: Coordinates of a signature, and how many of them two documents must share to be compared further.
COORDINATES, MATCHES = 64, 40
#: Coordinates under which documents are posted, and how many of them they must share.
POSTED, COLLISIONS = 16, 6
#: Documents of one posting list, or of one cluster, that are compared at a time; shingles likewise.
POSTING_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 1024, 512, 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


# --- shingles and signatures --------------------------------------------------------------------------
def lowered_words(text: str) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space; bytes know no other letters and no other white space."""
    return text.encode().lower().split()


def words_key(words: list[bytes]) -> bytes:
    """16 bytes that stand for the word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle has are one together."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = mixed * _MIX + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _FINAL
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _factors() -> np.ndarray:
    """One odd factor per coordinate; multiplication by it reorders all 64-bit numbers."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i) | 1 for i in range(COORDINATES)], np.uint64)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest reordered shingle of each coordinate."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = factors[:, None] * shingles[None, start : start + 4096]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text_hash, n_shingles, node, posts, sketch): ``node`` stands for the word sequence, null without words."""

    @F.arrow_udf("n_shingles long, node binary, posts array<long>, sketch binary")
    def sign(texts: pa.Array) -> pa.Array:
        give_back("factors")
        factors = once_per_worker("factors", _factors)
        salts = np.arange(POSTED, dtype=np.uint64) * _MIX
        sizes, nodes, posts, sketches = [], [], [], []
        for value in texts:
            words = lowered_words(value.as_py() or "")
            if not words:
                sizes.append(0), nodes.append(None), posts.append(None), sketches.append(None)
                continue
            shingles = shingle_set(words)
            least = signature(shingles, factors)
            sizes.append(len(shingles)), nodes.append(words_key(words))
            posts.append((least[:POSTED] * _FINAL + salts).view(np.int64))
            sketches.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(posts, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary()),
            ],
            ["n_shingles", "node", "posts", "sketch"],
        )

    done = docs.select(quoted(key).cast("long").alias("doc"), F.xxhash64(quoted(text)).alias("text_hash"), sign(quoted(text)).alias("s"))
    return done.select("doc", "text_hash", "s.*")


# --- whole groups in sorted partitions ----------------------------------------------------------------
def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal ``by`` values; a run may span batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table_ = pa.Table.from_batches([batch])
        n = table_.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in by:
            values = table_[name].combine_chunks()
            codes = np.asarray(values.dictionary_encode().indices) if not pa.types.is_integer(values.type) else np.asarray(values)
            change[1:] |= codes[1:] != codes[:-1]
        if held and any(held[-1][name][-1] != table_[name][0] for name in by):
            change[0] = True
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if a == 0 and b == 0:
                yield pa.concat_tables(held)
                held = []
                continue
            if b < n:
                yield pa.concat_tables([*held, table_.slice(a, b - a)])
                held = []
            elif b > a:
                held.append(table_.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _stars(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) for the connected groups of 0..n-1 under the given pairs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _blocked(rows: DataFrame, blocks: Column, node: str) -> DataFrame:
    """Every row once for each pair of blocks that its own block takes part in: columns ``i`` <= ``j`` and ``own``."""
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    spread = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def _compare(rows: DataFrame, group: str, payload: str, pairs: Callable[[pa.Table, np.ndarray], tuple]) -> DataFrame:
    """(a, b) edges that connect what ``pairs`` finds in each (group, i, j); as many as there are members at most."""
    by = [group, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in _groups(batches, by):
            if t.num_rows > 1:
                first = np.asarray(t["own"]) == t["i"][0].as_py()
                nodes = t["node"].to_pylist()
                for x, y in _stars(t.num_rows, *pairs(t, first)):
                    a.append(nodes[x])
                    b.append(nodes[y])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = rows.select(*by, "node", "own", payload).repartition(*by).sortWithinPartitions(*by, "node")
    return dealt.mapInArrow(run, "a binary, b binary")


def _crossing(table_: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides: the same block twice, or one block against the other."""
    if table_["i"][0].as_py() == table_["j"][0].as_py():
        every = np.arange(table_.num_rows)
        return every, every
    return np.flatnonzero(first), np.flatnonzero(~first)


def _alike_signatures(t: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in at least ``MATCHES`` coordinates."""
    left, right = _crossing(t, first)
    sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
    x, y = sketches[left], sketches[right]
    same = np.zeros((len(left), len(right)), np.int16)
    for c in range(COORDINATES):
        same += x[:, c, None] == y[None, :, c]
    a, b = np.nonzero(same >= MATCHES)
    return left[a], right[b]


def _alike_sets(threshold: int) -> Callable:
    def pairs(t: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows whose sets share at least ``threshold`` hundredths of their union."""
        left, right = _crossing(t, first)
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one row only add nothing; the others are numbered anew.
        shared = times > 1
        number = np.cumsum(shared) - 1
        use = shared[column]
        owner, column = owner[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(left), len(right)))
        total = int(shared.sum())
        for start in range(0, total, 1024):
            a, b = np.searchsorted(column, [start, start + 1024])
            present = np.zeros((len(sets), min(1024, total - start)), np.float32)
            present[owner[a:b], column[a:b] - start] = 1
            common += present[left] @ present[right].T
        common = common.astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - common
        x, y = np.nonzero(100 * common >= threshold * union)
        return left[x], right[y]

    return pairs


# --- connected components -----------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Large and small stars alternate until nothing changes: every node points its larger neighbours, then itself and
    its smaller ones, to the smallest node it knows.  Rounds grow with the logarithm of the longest path.
    """
    def oriented(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(oriented(edges))
    before, current = None, state(now)
    while current != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pointed = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stage(oriented(pointed))
        before, current = current, state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.toDF("node", "label").union(roots)


# --- the operator -------------------------------------------------------------------------------------
def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b): edges that connect all classes which agree in ``MATCHES`` coordinates.

    Each class is posted under its first coordinates.  A class all of whose coordinates are its own meets nobody.  Of m
    coordinates that it has in common with others, the m - ``COLLISIONS`` + 1 rarest are merged and the most frequent
    are skipped: two classes that collide ``COLLISIONS`` times meet in one of them.
    """
    posts = classes.select("node", F.explode("posts").alias("post"))
    shared = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = posts.join(shared, "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("p"))
    ranked = ranked.filter(F.size("p") >= COLLISIONS)
    prefix = ranked.select("node", F.explode(F.slice("p", 1, F.size("p") - COLLISIONS + 1)).alias("p")).select("node", "p.*")
    lists = prefix.join(classes.select("node", "sketch"), "node")
    return _compare(_blocked(lists, F.ceil(F.col("n") / POSTING_BLOCK), "node"), "post", "sketch", _alike_signatures)


def shingle_sets(docs: DataFrame, key: str, text: str, needed: DataFrame) -> DataFrame:
    """(node, shingles) for the rows whose key and text are in the stored ``needed`` (doc, text_hash).

    Only the texts of these rows are looked at.  Where there are too many to be sent as keys, texts are shuffled once.
    """

    @F.arrow_udf("node binary, shingles binary")
    def sets(texts: pa.Array) -> pa.Array:
        give_back()
        nodes, found = [], []
        for value in texts:
            words = lowered_words(value.as_py())
            nodes.append(words_key(words))
            found.append(shingle_set(words).tobytes())
        return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["node", "shingles"])

    rows = docs.select(quoted(key).cast("long").alias("doc"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("text"))
    wanted = sent_if_small(needed).alias("w")
    picked = rows.alias("r").join(wanted, F.expr("r.doc <=> w.doc and r.text_hash = w.text_hash"), "left_semi")
    # Else a later filter on the node would be asked of all texts, before the join.
    sets = sets.asNondeterministic()
    made = picked.select(sets(F.col("text")).alias("s")).select("s.*")
    # Repeated rows give the same set again.
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _linked(docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """(doc, text_hash, n_shingles, node, label, component) for every row; ``label`` names its component."""
    if threshold < 80:
        raise ValueError("the signature thresholds are chosen for links of 80 hundredths or more")
    rows = stage(signed(docs, key, text))
    classes = stage(
        rows.filter("node is not null").groupBy("node").agg(
            F.min("doc").alias("smallest"),
            F.min(F.struct("doc", "text_hash")).alias("row"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("posts").alias("posts"),
            F.first("sketch").alias("sketch"),
        )
    )
    clusters = components(candidate_edges(classes))
    inside = clusters.join(classes.select("node", "n_shingles", "row.doc", "row.text_hash"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES))
    sizes = inside.groupBy("label").agg(blocks.alias("blocks"))
    inside = stage(inside.select("node", "label", "doc", "text_hash").join(sizes, "label"))
    sets = shingle_sets(docs, key, text, inside.select("doc", "text_hash"))
    dealt = _blocked(inside.select("node", "label", "blocks").join(sets, "node"), F.col("blocks"), "node")
    linked = components(_compare(dealt, "label", "shingles", _alike_sets(threshold)))
    known = classes.select("node", "smallest").join(linked, "node", "left")
    known = known.select("node", "smallest", F.coalesce("label", "node").alias("label"))
    least = known.groupBy("label").agg(F.min("smallest").alias("component"))
    known = known.select("node", "label").join(least, "label")
    return rows.select("doc", "text_hash", "n_shingles", "node").join(known, "node", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Rows with the same word sequence are one class.  Classes meet in the posting lists of their signature coordinates
    (``candidate_edges``); those connected there form clusters, inside which all pairs are compared on their whole
    shingle sets, block by block, with exact arithmetic.  Neither step returns pairs, only edges that connect what is
    alike, so a group of n copies costs n rows.  A link of ``threshold`` hundredths escapes with a probability below
    one in 100,000.  ``component_id`` is the smallest key that links lead to; a component of null keys has a null id.

    Null and empty texts have no shingles, are linked with nothing, are their own component and are kept.  ``kept`` marks
    the rows whose key is the component's id, so rows that repeat key and text are alike.  Other columns play no part.
    """
    out = _linked(docs, key, text, threshold)
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component"))
    return out.select(
        F.col("doc").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.col("doc").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 85) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest key; rows without words all stay.

    Of rows that repeat key and text one stays.  A key that stands for several texts is no link between them.
    """
    rows = _linked(docs, key, text, threshold).filter("node is not null")
    rows = stage(rows.groupBy("doc", "text_hash", "label").agg(F.count(F.lit(1)).alias("copies")))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("first"))
    first = first.select("label", F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash"))
    chosen = F.expr("r.label = f.label and r.doc <=> f.doc and r.text_hash = f.text_hash")
    judged = rows.alias("r").join(first.alias("f"), chosen, "left").select(
        F.col("r.doc").alias("kept_doc"), F.col("r.text_hash").alias("kept_hash"),
        F.col("f.label").isNotNull().alias("kept_one"), "r.copies",
    )
    # Most rows stay as they are and are not listed; a text goes nowhere unless too many are.
    listed = stage(judged.filter("not kept_one or copies > 1").select("kept_doc", "kept_hash", "kept_one"))
    sent = sent_if_small(listed).alias("l")
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    hashed = packed.withColumn("hash", F.xxhash64(F.col("row")[text])).withColumn("doc", F.col("row")[key].cast("long"))
    met = hashed.alias("d").join(sent, F.expr("d.doc <=> l.kept_doc and d.hash = l.kept_hash"), "left")
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    stay = met.filter("kept_one is null").select(columns)
    if listed.filter("kept_one").isEmpty():
        return stay
    # Of repeated rows one each; the others are gone before they meet.
    copies = met.filter("kept_one").groupBy("doc", "hash").agg(F.first("row").alias("row"))
    return stay.unionByName(copies.select(columns))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
