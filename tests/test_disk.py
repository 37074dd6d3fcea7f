"""What is left on disk while a query runs, and that cutting the work into more parts gives the same."""

from __future__ import annotations

import glob
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_svd_matrix import small_blocks, sparse  # noqa: F401 - a fixture

from citegraph.operators import svd, vectors
from citegraph.queries.graph import Graph
from citegraph.session import discard, materialise, shared_folder, staging
from citegraph.sources import records


def shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    stored = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_discarded_table_is_gone(spark):
    stored = materialise(spark.range(3).toDF("x"))
    (folder,) = {name.rpartition("/")[0].removeprefix("file://") for name in stored.inputFiles()}
    assert glob.glob(f"{folder}/*.parquet")
    discard(stored)
    assert not glob.glob(f"{folder}*")


@pytest.mark.parametrize("side", ["rows", "columns"])
def test_only_the_last_pass_is_kept(spark, make, small_blocks, monkeypatch, side):  # noqa: F811
    monkeypatch.setattr(svd, "WIDTH", 64)
    _, entries = sparse(make)
    folder = f"{shared_folder(spark).removeprefix('file:').rstrip('/')}/{spark.sparkContext.applicationId}"
    kept = []
    for passes in (1, 4):
        with staging(spark):
            before = set(glob.glob(f"{folder}/*"))
            svd.truncated_svd(entries, k=4, passes=passes, oversample=2, on=side)
            kept.append(len(set(glob.glob(f"{folder}/*")) - before))
    assert kept[0] == kept[1] > 0


@pytest.mark.parametrize("counted", [False, True])
def test_a_block_may_have_several_pieces(spark, make, small_blocks, monkeypatch, counted):  # noqa: F811
    """Rows that a task gathers in parts, in any order, and blocks of several rows: the same matrix and products."""
    for name, value in (("WIDTH", 64), ("PIECE", 50), ("GATHERED", 60)):
        monkeypatch.setattr(svd, name, value)
    a, entries = sparse(make)
    if counted:
        a = np.ceil(a * 300)
        items = F.collect_list(F.struct("col", F.ceil(F.col("weight") * 300).cast("int").alias("tf"))).alias("items")
        matrix, sums = svd.RowBlocks.of_counts(entries.groupBy("row").agg(items), 3)
        totals = {r["key"]: (r["tf"], r["df"]) for r in sums.collect()}
        assert totals == {f"c{j}": (a[:, j].sum(), np.count_nonzero(a[:, j])) for j in range(a.shape[1])}
    else:
        matrix = svd.RowBlocks.of(entries.orderBy(F.hash("col")))
    assert matrix.blocks.count() > 2 * matrix.blocks.select("block").distinct().count()
    assert max(r["n"] for r in matrix.blocks.select((F.length("w") / F.length("c")).alias("n")).collect()) <= (0.5 if counted else 2)
    found = np.zeros(a.shape)
    for row in matrix.entries().collect():
        found[row["row"], int(row["col"][1:])] += row["weight"]
    assert np.array_equal(found, a)
    names = {}
    for r in matrix.blocks.orderBy("block", "first").collect():
        assert r["first"] == len(names.setdefault(r["block"], []))
        names[r["block"]] += r["names"]
    x, z = np.zeros((len(a), 6)), np.zeros((len(a), 6))
    for r in matrix.row_gram_product(materialise(matrix.placed_start(6)), "x", np.eye(6)).collect():
        x[names[r["block"]]], z[names[r["block"]]] = (np.frombuffer(r[n]).reshape(-1, 6) for n in "xz")
    assert np.allclose(z, a @ (a.T @ x)) and np.abs(x).max() > 0


def test_weights_do_not_travel_entry_by_entry(spark, make, monkeypatch):
    """Repeated, empty and missing texts, other column names; the weights are those of the model's own transform."""
    monkeypatch.setattr(vectors, "_CHARACTERS", 1)
    monkeypatch.setattr(svd, "LEAST_ENTRIES", 20)
    rows = [(f"d{i}", " ".join(f"w{(i * j) % (5 + i % 7)}" for j in range(i % 6)) or None) for i in range(40)]
    docs = make("name string, words string", *rows, ("x", "the"), ("y", "w1 w1 w2"))
    for limit in (None, 4):
        expected = vectors.fit_tfidf(docs, limit, ("the",), "words").transform(docs, "name", "words")
        found = vectors.tfidf_weights(docs, limit, ("the",), "name", "words")
        assert found.columns == expected.columns == ["name", "term", "weight"]
        both = [{(r["name"], r["term"]): r["weight"] for r in f.collect()} for f in (found, expected)]
        assert both[0] == pytest.approx(both[1], abs=1e-12) and len(both[0]) == found.count()
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


FOLDER = "/root/testdata/sf0.001"


def test_a_text_travels_to_its_record_without_its_index(spark):
    plan = Graph(spark, FOLDER).raw._jdf.queryExecution().optimizedPlan().toString().splitlines()
    built = min(i for i, line in enumerate(plan) if "map_from_entries" in line)
    dealt = [i for i, line in enumerate(plan) if "Repartition" in line and "doc_id" in line]
    assert dealt and built < min(dealt) and not any("map_from_entries" in line for line in plan[min(dealt) :])


def test_topics_are_named_before_links_meet_them(spark, tmp_path):
    for name in ("part", "lineitem"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        # Links occur twice, some lead to no part.
        table = table.unionByName(table) if name == "lineitem" else table.filter("p_partkey % 7 > 0")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    g = Graph(spark, str(tmp_path))
    names = g.fields_of_study.withColumnRenamed("id", "field_of_study_id")
    expected = {tuple(r) for r in g.paper_fos.join(names, "field_of_study_id").select("paper_id", "name", "field_of_study_id").collect()}
    found = [(r["o_orderkey"], t["DFN"], t["FId"]) for r in g._topics.collect() for t in r["F"]]
    assert len(found) == len(set(found)) and set(found) == expected
    assert all(r["F"] == sorted(r["F"]) for r in g._topics.collect())
    reads = re.findall(r"ReadSchema: \S+", g._topics._jdf.queryExecution().executedPlan().toString())
    assert sum("l_partkey" in columns for columns in reads) == 1


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffles(spark)
    records.write_records(Graph(spark, FOLDER).landed(people=True, topics=True), str(tmp_path / "landed"))
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_documents_with_similar_words_lie_together(spark, make, monkeypatch):
    monkeypatch.setattr(vectors, "_CHARACTERS", 1)
    monkeypatch.setattr(svd, "LEAST_ENTRIES", 200)
    rng = np.random.default_rng(2)
    kinds = [("the", "a"), ("der", "b"), ("de", "c"), ("och", "d")]
    rows = [(i, " ".join([kinds[i % 4][0]] * 5 + [f"{kinds[i % 4][1]}{w}" for w in rng.integers(0, 60, 20)])) for i in range(400)]
    docs = make("id long, abstract string", *rows, (400, ""), (401, None))

    def shared(docs):
        _, matrix, n = vectors._tfidf_blocks(docs, None, ())
        blocks = [r["block"] for r in matrix.blocks.select("block").distinct().collect()]
        assert len(blocks) > 4 and 0 <= min(blocks) and max(blocks) < matrix.count
        return matrix.needs.count(), n

    placed, n = shared(docs)
    monkeypatch.setattr(vectors, "_placed_items", lambda texts, *rest: vectors._items(texts))
    anywhere, m = shared(docs)
    assert n == m == 400 and placed < 0.6 * anywhere


def test_a_document_has_one_block(spark, make, monkeypatch):
    """Texts with one id stay together, and the matrix of placed weights has the blocks that they name."""
    monkeypatch.setattr(vectors, "_CHARACTERS", 1)
    monkeypatch.setattr(svd, "LEAST_ENTRIES", 20)
    rows = [(i, f"w{i % 3} " * 4 + f"x{i % 11} y{i % 5}") for i in range(60)]
    for more in ((), ((7, "w2 w2 z1"), (7, "q1 q1 q1"))):
        docs = make("id long, abstract string", *rows, *more)
        weights = materialise(vectors.tfidf_weights(docs, stop_words=(), placed=True))
        blocks = {(r["id"], r["block"]) for r in weights.select("id", "block").distinct().collect()}
        assert weights.columns == ["id", "term", "weight", "block"] and len(blocks) == 60 and len({b for _, b in blocks}) > 1
        matrix = svd.RowBlocks.of(weights.selectExpr("id AS row", "term AS col", "weight", "block"))
        assert {(i, r["block"]) for r in matrix.blocks.collect() for i in r["names"]} == blocks
        found = [vectors.svd_vectors(w, 3, 3, 5, 0.0, "documents")[2] for w in (weights, weights.drop("block"))]
        assert np.allclose(found[0].values, found[1].values) and np.allclose(found[0].residuals, found[1].residuals, atol=1e-9)
