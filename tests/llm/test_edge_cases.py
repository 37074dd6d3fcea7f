"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citegraph.llm import contamination, languages, licenses, lm, near, pieces, pii, quality, shards, tokens
from citegraph.llm.registry import QUERIES

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet consectetur " * 6000 + "x" * 200_000
ROWS = [
    (None, None, None, None, None),
    (None, "a text without a key or a language that is long enough to be one", None, "s", 1),
    (1, "", "en", None, 0),
    (2, " \n\t ", "en", "s", 4),
    (3, LONG, "en", "s", len(LONG)),
    (3, LONG, "en", "s", len(LONG)),
    (4, "1234 5678 !!", "de", "s", 12),
    (5, "twice the same row", "en", "s", 18),
    (5, "twice the same row", "en", "s", 18),
    (5, "the same key but another text", "fr", "s", 29),
    (6, "a tie a tie a tie a tie", "en", "s", 23),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = [
    "n_tokens", "score", "labels", "shard", "slot", "pii", "component_id", "kept", "lang_pred", "n_words", "n_hit",
    "piece_ids", "decoded", "difference", "row", "added", "text_hash", "node", "label", "mark", "best", "range", "lost",
    "item", "gram", "start", "stop", "words", "hash", "kept_doc", "is_target", "language", "h", "t", "s", "doc", "clean",
]


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("i", "twice the same row"), (None, "a tie"), ("n", None)], "item_id string, text string")


@pytest.fixture(scope="module")
def field():
    return languages.fit([("en", "twice the same row " * 20), ("fr", "le la les des " * 20)])


def texts(df, column):
    return sorted(((r.text or "")[:20], r[column]) for r in df.collect())


def the_operators(docs, benchmark, field):
    targets = docs.filter("doc_id = 5").select("doc_id")
    return {
        "tokens": tokens.count_tokens(docs, BPE),
        "licenses": licenses.scan_licenses(docs),
        "shards": shards.assign_shards(docs, "doc_id", [1.0, 2.0, 0.5], grown="grown_shard"),
        "pii": pii.find_personal_data(docs),
        "languages": languages.identify(docs, field, segments="label"),
        "quality": quality.judge(quality.measure(docs)),
        "contamination": contamination.find_contamination(docs, benchmark),
        "pieces": pieces.decode(pieces.encode(docs, MODEL), MODEL),
        "lm": lm.score(docs, targets),
    }


def test_every_row_stays_and_other_columns_are_untouched(messy, benchmark, field):
    for name, out in the_operators(messy, benchmark, field).items():
        rows = out.collect()
        assert len(rows) == len(ROWS), name
        assert {c for c in messy.columns} <= set(out.columns), name
        assert all(r["gram"] == r["node"] == r["clean"] == "other" for r in rows), name


def test_empty_tables_give_empty_results(empty, benchmark, field):
    for name, out in the_operators(empty, benchmark, field).items():
        assert out.count() == 0, name
    assert near.near_duplicates(empty).count() == 0
    assert near.drop_near_duplicates(empty).count() == 0
    assert shards.number_slots(empty.withColumn("shard", F.lit(0)), "shard", ["doc_id"]).count() == 0


def test_defined_results(messy, benchmark, field):
    out = the_operators(messy, benchmark, field)
    none = lambda df, column: {r[column] for r in df.filter("text is null or text = ''").collect()}
    assert none(out["tokens"], "n_tokens") == {0}
    assert none(out["licenses"], "n_words") == {0} and none(out["licenses"], "score") == {0.0}
    assert none(out["languages"], "lang_pred") == {"und"}
    assert [r.lang_pred for r in out["languages"].filter("doc_id in (2, 4)").collect()] == ["und", "und"]
    assert none(out["lm"], "difference") == {None} and none(out["lm"], "n_lm_words") == {0}
    assert all(r.pii == [] for r in out["pii"].filter("text is null or text = ''").collect())
    assert all(r.decoded == r.text for r in out["pieces"].collect())
    assert {tuple(r.hit_items) for r in out["contamination"].filter("doc_id = 5").collect()} == {("i",), ()}
    assert [r.hit_items for r in out["contamination"].filter("doc_id = 6").collect()] == [[""]]
    assert none(out["quality"], "base_failed") == {True}
    assert len({r.shard for r in out["shards"].filter("doc_id is null").collect()}) == 1


def test_near_duplicates_of_messy_rows(messy):
    out = near.near_duplicates(messy).collect()
    assert len(out) == len(ROWS)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by_id[None] == {(None, True)} and by_id[1] == {(1, True)} and by_id[5] == {(5, True)} and by_id[3] == {(3, True)}
    left = near.drop_near_duplicates(messy)
    assert left.dtypes == messy.dtypes
    kept = sorted((r.doc_id or 0, (r.text or "")[:10]) for r in left.collect())
    # Repeated rows are one, another text under the same key is its own, texts without words all stay.
    assert [k[0] for k in kept] == [0, 0, 1, 2, 3, 4, 5, 5, 6]


def test_slots_are_gapless_for_repeated_rows(spark):
    rows = [(None, 1)] * 500 + [(7, 2)] * 300 + [(i, i) for i in range(200)]
    placed = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", [1.0] * 5, grown="grown")
    out = shards.number_slots(placed, "shard", ["doc_id", "size", "grown"]).collect()
    assert len(out) == len(rows)
    for s in range(5):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown in (r.shard, 5) for r in out)


def test_shards_follow_their_weights(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    out = shards.assign_shards(docs, "doc_id", [1.0, 3.0]).groupBy("shard").count().collect()
    counts = {r.shard: r["count"] for r in out}
    assert 0.73 < counts[1] / 20_000 < 0.77
    before = {r.doc_id: r.shard for r in shards.assign_shards(docs, "doc_id", [1.0, 3.0]).collect()}
    after = {r.doc_id: r.shard for r in shards.assign_shards(docs, "doc_id", [1.0, 3.0, 2.0]).collect()}
    assert all(after[i] in (before[i], 2) for i in before)
    with pytest.raises(ValueError):
        shards.assign_shards(docs, "doc_id", [1.0, 0.0])


def test_quality_filter_returns_rows_as_they_are(messy):
    out = quality.filter_quality(messy)
    assert out.dtypes == messy.dtypes and out.count() <= len(ROWS)


def test_no_languages_no_targets_no_items(messy, benchmark):
    none = messy.limit(0)
    assert {r.lang_pred for r in languages.identify(messy, languages.learn(none)).collect()} == {"und"}
    assert lm.score(messy, none.select("doc_id")).count() == len(ROWS)
    assert {r.n_hit for r in contamination.find_contamination(messy, benchmark.limit(0)).collect()} == {0}


@pytest.mark.parametrize("rows", [ROWS, []])
def test_queries_and_pipeline_over_messy_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    items = [("i", "twice the same row")] if rows else []
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(5, 1, 0), (None, 1, 0), (3, None, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, query in QUERIES.items():
        found = query(spark, str(tmp_path)).count()
        # One row per document, or one per word and one per group, item and part.
        assert found == len(rows) or name in ("op12_spelling_variants", "op13_source_divergence"), name
        assert rows or not found, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() <= len(rows)
