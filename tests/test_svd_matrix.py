"""The block-wise decomposition against numpy."""

import numpy as np
import pytest

from citegraph.operators import svd, vectors
from citegraph.session import materialise


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ENTRIES", 300), ("BUCKET_VECTORS", 30), ("WIDTH", 4), ("CHUNK", 64)):
        monkeypatch.setattr(svd, name, value)


def sparse(make, shape=(120, 60), seed=1, kinds=("long", "string")):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(shape) < 0.15, rng.random(shape), 0.0) * np.linspace(1, 0.05, shape[1]) ** 5
    a[3] = 0.1 * rng.random(shape[1])  # a row with every column
    rows = [(int(i), f"c{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return a, make(f"row {kinds[0]}, col {kinds[1]}, weight double", *rows)


def test_products_equal_numpy(make, small_blocks):
    a, entries = sparse(make)
    matrix = svd.RowBlocks.of(entries)
    assert matrix.blocks.count() > 2
    width = 10
    x = {r["key"]: np.frombuffer(r["x"]) for r in matrix.start(width).collect()}
    dense = np.array([x[f"c{j}"] for j in range(a.shape[1])])
    assert np.abs(dense).max() <= 0.5 and len({tuple(v) for v in dense}) == len(dense)
    got = {r["key"]: (np.frombuffer(r["x"]), np.frombuffer(r["z"])) for r in matrix.gram_product(matrix.start(width), width).collect()}
    assert np.allclose([got[f"c{j}"][0] for j in range(a.shape[1])], dense)
    assert np.allclose([got[f"c{j}"][1] for j in range(a.shape[1])], a.T @ a @ dense)
    rows = {r["name"]: r["vector"] for r in matrix.rows(matrix.start(width), width).collect()}
    assert np.allclose([rows[i] for i in range(len(a)) if a[i].any()], (a @ dense)[a.any(axis=1)])


def test_it_converges_to_the_singular_values(make, small_blocks):
    a, entries = sparse(make)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    found = svd.truncated_svd(entries, k=10, passes=30, oversample=20, tolerance=1e-7)
    assert found.passes < 30 and found.residuals.max() <= 1e-7
    assert np.allclose(found.values, s[:10], rtol=1e-9)
    v = {r["key"]: np.array(r["vector"]) for r in found.column_vectors().collect()}
    v = np.array([v[f"c{j}"] for j in range(a.shape[1])])
    assert np.abs(v @ v.T - vt[:10].T @ vt[:10]).max() < 1e-5
    # A v = sigma u, whatever the signs.
    rows = {r["name"]: np.array(r["vector"]) for r in found.row_vectors().collect()}
    ours = np.array([rows.get(i, np.zeros(10)) for i in range(len(a))])
    assert np.allclose(ours, a @ v) and np.allclose((ours**2).sum(axis=0), s[:10] ** 2)


def test_the_residual_bounds_the_error_of_few_passes(make, small_blocks):
    a, entries = sparse(make)
    s = np.linalg.svd(a, compute_uv=False)
    found = svd.truncated_svd(entries, k=10, passes=1, oversample=2)
    nearest = np.abs(found.values[:, None] ** 2 - s[None, :] ** 2).min(axis=1)
    assert (nearest <= found.residuals * found.values[0] ** 2 + 1e-9).all() and found.residuals.max() > 1e-3


def test_more_columns_than_rank_give_zeros(make):
    rows = [(f"r{i}", i % 2, 1.0 + i % 2) for i in range(6)]
    found = svd.truncated_svd(make("row string, col int, weight double", *rows), k=4, passes=2, oversample=2)
    assert np.allclose(found.values, [np.sqrt(12), np.sqrt(3), 0, 0])


def test_both_sides_give_the_same_geometry(make, small_blocks):
    a, entries = sparse(make)
    weights = entries.selectExpr("row AS id", "col AS term", "weight")
    grams = []
    for side in ("documents", "terms"):
        documents, terms, found = vectors.svd_vectors(weights, 5, 30, 15, 1e-7, side)
        got = {r["id"]: np.array(r["vector"]) for r in documents.collect()}
        d = np.array([got.get(i, np.zeros(5)) for i in range(len(a))])
        v = {r["term"]: np.array(r["vector"]) for r in terms.collect()}
        v = np.array([v[f"c{j}"] for j in range(a.shape[1])])
        assert np.allclose(v.T @ v, np.eye(5), atol=1e-6) and np.allclose(a @ v, d, atol=1e-6)
        grams.append(d @ d.T)
    assert np.allclose(*grams, atol=1e-5)


def test_a_vector_is_sent_once_for_each_block(make, small_blocks):
    a, entries = sparse(make)
    matrix = svd.RowBlocks.of(entries)
    sent, blocks = matrix.needs.count(), matrix.blocks.count()
    assert sent <= blocks * a.shape[1] < np.count_nonzero(a)


def test_rows_stay_with_their_blocks(make, small_blocks, monkeypatch):
    monkeypatch.setattr(svd, "WIDTH", 64)
    a, entries = sparse(make)
    matrix = svd.RowBlocks.of(entries)
    start = materialise(matrix.placed_start(6))
    names = {r["block"]: r["names"] for r in matrix.blocks.collect()}
    both = matrix.row_gram_product(start, "x", np.eye(6))
    x, z = np.zeros((len(a), 6)), np.zeros((len(a), 6))
    for r in both.collect():
        x[names[r["block"]]], z[names[r["block"]]] = (np.frombuffer(r[n]).reshape(-1, 6) for n in "xz")
    assert np.allclose(z, a @ (a.T @ x)) and (np.abs(x).max(axis=1) > 0).tolist() == a.any(axis=1).tolist()
    # The matrix is read from its buckets: only what the rows give the columns is shuffled.
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Bucketed: true") == 2
    # A column that one block has alone is not sent.
    sent, needed = sum(len(r["shared"]) // 4 for r in start.collect()), matrix.needs.groupBy("key").count().filter("count > 1")
    assert sent == needed.selectExpr("sum(count) AS n").first()["n"]
    # Few products and the wide form: the same vectors, up to sign.
    near = svd.truncated_svd(entries, k=4, passes=1, oversample=2, on="rows")
    monkeypatch.setattr(svd, "WIDTH", 4)
    wide = svd.truncated_svd(entries, k=4, passes=1, oversample=2, on="rows")
    assert np.allclose(near.values, wide.values) and np.allclose(near.residuals, wide.residuals, atol=1e-9)
    found = [{r["name"]: np.abs(r["vector"]) for r in f.row_vectors().collect()} for f in (near, wide)]
    assert all(np.allclose(v, found[1][n]) for n, v in found[0].items()) and len(found[0]) == len(found[1])
    found = [{r["key"]: np.abs(r["vector"]) for r in f.column_vectors().collect()} for f in (near, wide)]
    assert all(np.allclose(v, found[1][n]) for n, v in found[0].items()) and len(found[0]) == len(found[1])


def test_weights_in_blocks_equal_those_in_rows(make, small_blocks, monkeypatch):
    """The matrix of the text vectors without a row for each entry; with stop words, unknown terms, repeated and empty texts."""
    rows = [(i, " ".join(f"w{(i * j) % (5 + i % 7)} the x{j % 3}" for j in range(i % 6))) for i in range(40)]
    docs = make("id int, abstract string", *rows, (40, None), (41, "the"), (42, "w1 w1 w2"))
    monkeypatch.setattr(vectors, "_CHARACTERS", 1)
    monkeypatch.setattr(svd, "LEAST_ENTRIES", 20)
    for limit in (None, 6):
        fitted = vectors.fit_tfidf(docs, limit, ("the",))
        expected = {(r.id, r.term): r.weight for r in fitted.transform(docs).collect()}
        model, matrix, n = vectors._tfidf_blocks(docs, limit, ("the",))
        assert {tuple(r) for r in model.terms.collect()} == {tuple(r) for r in fitted.terms.collect()}
        blocks = matrix.blocks.toArrow()
        assert 1 < len(blocks) <= 16 and n == len({i for i, _ in expected})
        found = {}
        for i in range(len(blocks)):
            r, c, w, names, keys = svd._entries(blocks.slice(i, 1).combine_chunks())
            found |= {(names[a].as_py(), keys[b].as_py()): x for a, b, x in zip(r.tolist(), c.tolist(), w.tolist())}
        assert found == pytest.approx(expected, abs=1e-12)
