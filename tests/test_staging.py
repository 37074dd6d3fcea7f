"""What is staged goes, and a table survives a replacement that breaks off."""

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citegraph import session
from citegraph.sources.store import COMPLETE, Store


def staged(spark):
    folder = Path(session.shared_folder(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    return set(os.listdir(folder)) if folder.exists() else set()


def test_nothing_staged_is_left_behind(spark):
    before = staged(spark)
    with session.staging(spark):
        first = session.materialise(spark.range(5))
        with session.staging(spark):
            inner = session.materialise(first.withColumn("x", F.col("id") * 2))
            kept = session.materialise(inner.filter("x > 4"), outlive=True)
            assert len(staged(spark) - before) == 3
        # The inner block's own file is gone, its result belongs to the outer block.
        assert len(staged(spark) - before) == 2 and kept.count() == 2
    assert staged(spark) == before


def test_an_error_leaves_nothing_either(spark):
    before = staged(spark)
    with pytest.raises(ValueError), session.staging(spark):
        session.materialise(spark.range(5))
        raise ValueError
    assert staged(spark) == before


def test_a_result_outside_of_any_block_stays(spark):
    kept = session.materialise(spark.range(3))
    with session.staging(spark):
        also = session.materialise(spark.range(4), outlive=True)
    assert (kept.count(), also.count()) == (3, 4)


def test_a_machine_local_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def names(store):
    return sorted(r["name"] for r in store.read("authors").collect())


def authors(make, *pairs):
    return make("id long, name string", *pairs)


@pytest.mark.parametrize("stop", ["while writing", "before the mark"])
def test_a_replacement_that_breaks_off_changes_nothing(spark, make, tmp_path, monkeypatch, stop):
    store = Store(spark, str(tmp_path))
    store.append(authors(make, (1, "a")), "authors")
    store.refresh(authors(make, (1, "a"), (2, "b")), "authors")
    if stop == "while writing":
        failing = F.udf(lambda n: 1 // 0 if n == "b" else n, "string")
        with pytest.raises(Exception):
            store.update(store.read("authors").withColumn("name", failing("name")), "authors")
    else:
        store._write(authors(make, (9, "half")), "authors", f"{tmp_path}/authors.v2", "overwrite")
    assert names(store) == ["a", "b"]
    # The next run takes the place of the broken one.
    store.update(store.read("authors").withColumn("name", F.upper("name")), "authors")
    assert names(store) == ["A", "B"]


def test_running_readers_keep_their_files(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_empty("authors")
    for k in range(4):
        reader = store.read("authors")
        store.refresh(authors(make, *[(i, str(k)) for i in range(k + 1)]), "authors")
        assert reader.count() == k
    store.append(authors(make, (7, "new")), "authors")
    assert len(names(store)) == 5
    # The live version and the one before; older ones are gone.
    assert sorted(p.name for p in tmp_path.iterdir()) == ["authors.v3", "authors.v4"]
    assert (tmp_path / "authors.v4" / COMPLETE).exists()


def test_a_lost_stage_is_an_error_and_not_an_empty_result(spark):
    kept = session.materialise(spark.range(50).repartition(2))
    for path in kept.inputFiles():
        os.remove(path.removeprefix("file:").removeprefix("//"))
    with pytest.raises(Exception):
        kept.agg(F.sum("id")).collect()
    shutil.rmtree(os.path.dirname(path.removeprefix("file:").removeprefix("//")), ignore_errors=True)
