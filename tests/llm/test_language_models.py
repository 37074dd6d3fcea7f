"""Language models whose vocabulary and bigrams pass what a task holds, against brute force."""

import math
from collections import Counter

import pytest

from citegraph.llm import lm
from citegraph.llm.registry import QUERIES


def losses(docs, targets):
    """{id: (background, target)} of (id, words); every word, bigram and context counts, a text's own ones do not."""
    words, pairs, contexts = ([Counter(), Counter()] for _ in range(3))
    pairs_of = lambda w: list(zip(["<begin>", *w], w))
    for i, w in docs:
        for side in (0, 1) if i in targets else (0,):
            words[side].update(w)
            pairs[side].update(pairs_of(w))
    for side in (0, 1):
        for p, n in pairs[side].items():
            contexts[side][p[0]] += n
    size, totals = len(words[0]) + 1, [sum(c.values()) for c in words]
    found = {}
    for i, w in docs:
        own, own_pairs, own_contexts = Counter(w), Counter(pairs_of(w)), Counter()
        for p, n in own_pairs.items():
            own_contexts[p[0]] += n
        both = []
        for side in (0, 1):
            out, scale, value = int(side == 0 or i in targets), min(totals) / totals[side], 0.0
            total = scale * (totals[side] - out * len(w))
            for p, n in own_pairs.items():
                single = (scale * (words[side][p[1]] - out * own[p[1]]) + lm.WORD_WEIGHT / size) / (total + lm.WORD_WEIGHT)
                count = pairs[side][p] - out * n
                context = contexts[side][p[0]] - out * own_contexts[p[0]]
                value -= n * math.log((scale * count + lm.BIGRAM_WEIGHT * single) / (scale * context + lm.BIGRAM_WEIGHT))
            both.append(value / len(w))
        found[i] = tuple(both)
    return found


def test_a_vocabulary_beyond_what_a_task_holds_counts_whole(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    docs = [(r.doc_id, [w.decode() for w in lm.lm_words(r.text)]) for r in docs]
    docs = [(i, w) for i, w in docs if w]
    assert len({w for _, words in docs for w in words}) > lm.VOCABULARY
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    expected = losses(docs, {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()})
    found = {r.doc_id: r for r in QUERIES["op10_cross_entropy_difference"](spark, folder).collect()}
    for i, both in expected.items():
        assert (found[i].background_loss, found[i].target_loss) == pytest.approx(both, abs=1e-7)


@pytest.mark.parametrize("words, bigrams", [(0, 0), (5, 0), (5, 3), (12, 6)])
def test_losses_do_not_hang_on_what_a_task_holds(spark, monkeypatch, words, bigrams):
    monkeypatch.setattr(lm, "VOCABULARY", words)
    monkeypatch.setattr(lm, "BIGRAMS", bigrams)
    texts = [(i, " ".join(f"é{(i * j * j + j) % (3 + i % 11)} the w{j % 4}" for j in range(i % 9 + 1))) for i in range(60)]
    texts += [(60, "once only here"), (61, "the the the")]
    docs, targets = [(i, t.split()) for i, t in texts], {i for i, _ in texts if i % 3 == 0}
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = lm.score(frame, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()
    expected = losses(docs, targets)
    assert len(found) == len(texts)
    for r in found:
        assert (r.background_loss, r.target_loss) == pytest.approx(expected[r.doc_id], abs=1e-9)


def test_bigrams_that_occur_once_count_in_the_contexts_they_share(spark):
    texts = [(i, f"the only{i} the again") for i in range(40)] + [(40, "the end"), (41, "the")]
    docs, targets = [(i, t.split()) for i, t in texts], {1, 2, 41}
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(frame, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()}
    for i, both in losses(docs, targets).items():
        assert (found[i].background_loss, found[i].target_loss) == pytest.approx(both, abs=1e-9)


@pytest.mark.parametrize("words, bigrams", [(5, 4), (1 << 16, 1 << 16)])
def test_losses_do_not_hang_on_blocks_and_buckets(spark, monkeypatch, words, bigrams):
    for name, value in (("VOCABULARY", words), ("BIGRAMS", bigrams), ("BLOCK", 40), ("BLOCK_TEXTS", 3), ("BUCKET", 50), ("GROUP", 2)):
        monkeypatch.setattr(lm, name, value)
    texts = [(i, " ".join(f"é{(i * j * j + j) % (3 + i % 11)} the w{j % 4} x{i}" for j in range(i % 23))) for i in range(60)]
    docs, targets = [(i, t.split()) for i, t in texts if t], {i for i, _ in texts if i % 3 == 0}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(2, "doc_id")
    found = lm.score(frame, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()
    assert {(r.doc_id, r.text) for r in found} == set(texts)
    expected = losses(docs, targets)
    for r in found:
        assert (r.background_loss, r.target_loss) == pytest.approx(expected.get(r.doc_id, (None, None)), abs=1e-9)


def test_bigrams_are_not_rows(spark):
    """Neither what is staged nor what is shuffled has a row for each bigram of a text."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs, docs.filter("doc_id % 3 = 0").select("doc_id"))
    others = model.spread.filter("at is null").count()
    assert model.spread.count() - others == docs.count()
    assert others < 2_000 < 100_000 < model.frequent.totals[0]


def test_other_texts_are_judged_by_a_model(spark):
    """A text that the model has not counted, with words and bigrams that it has."""
    texts = [(i, f"the cat number n{i % 5} sat") for i in range(40)] + [(40 + i, f"a dog number n{i % 5} ran") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.train(docs, docs.filter("doc_id < 40").select("doc_id"))
    new = spark.createDataFrame([(100, "the cat sat"), (101, "a dog ran"), (102, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(new, new.filter("false").select("doc_id"), model=model).collect()}
    assert found[100].difference < 0 < found[101].difference and found[102].difference is None
