"""The compression classifier, spelling variants and source divergence against brute force and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.llm import common, compression, divergence, variants
from citegraph.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def clashing(df, *names):
    return df.withColumns({n: F.lit("other") for n in names})


# --- compression --------------------------------------------------------------------------------------
def test_held_out_quality(spark):
    found = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, FOLDER).collect()}
    labels = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.doc_id in found and r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    held = [(found[r.doc_id], r.quality) for r in labels if found[r.doc_id].held_out]
    assert len(held) > 50 and sum(r.predicted == q for r, q in held) / len(held) > 0.93
    assert abs(np.mean([r.score for r, _ in held]) - np.mean([q for _, q in held])) < 0.06


def test_labels_of_held_out_documents_are_never_read(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    before = {r.doc_id: r.score for r in QUERIES["op11_quality_classifier"](spark, str(tmp_path)).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned.write.mode("overwrite").parquet(str(tmp_path / "turned"))
    spark.read.parquet(str(tmp_path / "turned")).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    assert before == {r.doc_id: r.score for r in QUERIES["op11_quality_classifier"](spark, str(tmp_path)).collect()}


def test_scores_of_odd_texts_and_without_labels(spark):
    texts = [(1, None), (2, ""), (3, "x" * 300_000), (4, "the same"), (4, "the same"), (None, "no key")]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"), "score", "label", "turn", "added", "gain")
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    model = compression.learn(docs, nothing)
    out = compression.judge(docs, model)
    assert out.columns[:2] == ["doc_id", "text"] and {r.score for r in out.collect()} == {0.5}
    assert all(r.label == r.turn == r.gain == "other" for r in out.collect())
    assert compression.judge(docs.limit(0), model).count() == 0
    # Both labels for one key, other labels and null keys teach nothing.
    labels = spark.createDataFrame([(4, 0), (4, 1), (None, 1), (3, 7), (2, None)], "doc_id long, quality int")
    assert compression.learn(docs, labels).dictionaries == model.dictionaries
    one_label = compression.judge(docs, compression.learn(docs, spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, quality int")))
    scores = {(r.doc_id, r.score) for r in one_label.collect()}
    assert len([i for i, _ in scores if i == 4]) == 1 and all(0 <= s <= 1 for _, s in scores)


def test_the_end_of_a_long_text_counts_as_much_as_its_start():
    passages = [b"good words in a row, again and again %d. " % i for i in range(400)]
    good = compression._compressor(compression._train_dictionary([b"".join(passages[i : i + 20]) for i in range(0, 400, 5)]))
    bad = compression._compressor(b"@@@@ #### %%%% &&&& " * 50)
    sizes = []
    for text in (b"".join(passages) + b"@#%& " * 3000, b"@#%& " * 3000 + b"".join(passages)):
        blocks = list(compression._blocks(text, compression.BLOCK))
        assert b"".join(blocks) == text
        sizes.append(sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks))
    assert min(sizes) > 0.8 * max(sizes) > 0


# --- variants -----------------------------------------------------------------------------------------
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        close = [o for o in counts if near(w, o)]
        best = min(close, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(close), form, counts.get(form))
    roots = {}
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        roots[w] = root
    return {w: (*v, roots[w]) for w, v in out.items()}


def words_around(seed, n):
    r = random.Random(seed)
    letters = "abcdeé÷ÿ"
    words = {"".join(r.choice(letters) for _ in range(r.randrange(6, 9))) for _ in range(n // 4)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "b" * 70, "b" * 71, "b" * 69 + "c", "d" * 3000, "d" * 2999 + "e", "d" * 3001}
    for w in list(words):
        for _ in range(3):
            i = r.randrange(len(w))
            words.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + r.choice(letters) + w[i:]]))
    return {w: r.choice([5, 5, 6, 25, 30, 30, 150, 800, 4000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("blocks", [1 << 22, 9])
def test_groups_equal_brute_force(spark, monkeypatch, blocks):
    # A few blocks a round: the filters of one length then come in several rounds.
    monkeypatch.setattr(variants, "ROUND_BLOCKS", blocks)
    counts = words_around(3, 120 if blocks > 100 else 60)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group_variants(words).collect()}
    expected = grouped(counts)
    assert found == expected
    assert any(v[2] and v[4] != v[2] for v in expected.values()), "a chain of forms is part of the test"


def test_forms_chain_and_ties_take_the_first_word(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "zzzzzz": 5, "zzzzzy": 25, "zzzzza": 25, "alonely": 9}
    words = spark.createDataFrame([*counts.items(), (None, 7)], "word string, n long")
    found = {r.word: (r.form, r.root) for r in variants.group_variants(words).collect()}
    assert found["abcdef"] == ("abcdeg", "abcihg") and found["zzzzzz"] == ("zzzzza", "zzzzza") and found["alonely"] == (None, "alonely")
    assert variants.group_variants(words.limit(0)).count() == 0


def test_the_filter_knows_every_word():
    r = np.random.default_rng(1)
    words = ["".join(chr(c) for c in r.choice(variants.ALPHABET, r.integers(6, 70))) for _ in range(2000)]
    shards = variants.Shards(dict(Counter(min(len(w), variants.LONG) for w in words)))
    bits, seen = np.zeros(shards.total, np.uint64), []
    for w in words:
        m = np.frombuffer(w.encode("latin-1"), np.uint8)[None, :]
        h = (variants._LETTER[m] * variants._powers(len(w))).sum(axis=1, dtype=np.uint64)
        block, mask = shards.place(h, len(w))
        bits[block] |= mask
        seen.append((block, mask))
    assert all(((bits[b] & m) == m).all() for b, m in seen)
    strange, n = 0, 20_000
    h = r.integers(0, 1 << 63, n, dtype=np.uint64)
    block, mask = shards.place(h, 9)
    strange = ((bits[block] & mask) == mask).mean()
    assert strange < 0.05


def test_words_are_counted_with_lost_letters(spark):
    texts = [(i, "Straße Überall STRASSEN naïvely xyz " * (i % 3 + 1)) for i in range(300)] + [(None, "Nullkey"), (5, None), (6, "")]
    texts.append((7, "Längeres " * 200_000))
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"), "word", "n")
    expected = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in variants.count_words(docs).collect()} == expected


# --- divergence ---------------------------------------------------------------------------------------
def audited(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = [s for g, s in groups if g == lang]
        every = Counter()
        for s in others:
            every.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (size + len(kept)) for t in kept}

        p, q = share(counts[lang, source]), share(every)
        pairs = []
        for s in others:
            if s != source:
                o = share(counts[lang, s])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), s.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)] + ["日本", "The", "THE"]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([10, 60, 93])]) for _ in range(r.randrange(30))), r.choice("xy"),
             "hot" if i % 3 else f"s{r.randrange(6)}") for i in range(150)]
    rows += [(1, "rare words here", "z", "a"), (2, None, "z", "b"), (3, "", None, None), (None, "hot", "x", None), (4, "12 .. ", "x", "empty")]
    return rows + [(9, "repeated row", "y", "hot")] * 5 + [(10, "long text " * 150_000, "y", "s1")]


@pytest.mark.parametrize("combinations, top", [(1 << 17, 200), (7, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, combinations, top):
    monkeypatch.setattr(divergence, "COMBINATIONS", combinations)
    monkeypatch.setattr(divergence, "HELD", 40 if combinations < 100 else divergence.HELD)
    rows = corpus(top)
    docs = clashing(spark.createDataFrame(rows, SCHEMA), "term", "place", "n", "item", "zero", "value").repartition(4)
    assert sorted(map(tuple, divergence.audit(docs, top=top).collect())) == audited(rows, top=top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_the_tree_takes_a_shared_path_once():
    tree = divergence._Tree()
    paths = [([1, 2, 3], 4), ([1, 2, 3, 5], 1), ([1, 2, 4], 2), ([2, 3], 7)]
    for places, n in paths:
        tree.insert(places, [10 * p + 5 for p in places], [3] * len(places), n)
    tree.close(0)
    # Nodes below the first level: 1-2, 1-2-3, 1-2-3-5, 1-2-4 and 2-3, each with its multiplicity.
    assert sorted((a, n, k) for a, _, _, n, k in tree.nodes) == [(2, 7, 1), (3, 5, 2), (3, 7, 1), (4, 2, 2), (5, 1, 3)]
    gap = lambda p, q: (p - q) ** 2 // q
    expected = Counter()
    for places, n in paths:
        for i in places:
            for j in places:
                if i != j:
                    p, q = 10 * i + 5, 10 * j + 5
                    expected[i, j] += n * (gap(p, q) - gap(p, 3) - gap(3, q) + gap(3, 3))
    found = tree.sums("x").to_pylist()
    assert {(r["a"], r["b"]): r["value"] for r in found} == dict(expected) and not tree.nodes


def test_long_texts_are_cut_between_words():
    data = (b"word " * 300_000) + b"x" * 2_000_000 + b" end"
    pieces = list(common.text_pieces(data, re.compile(rb"[^a-z]"), 1 << 16))
    assert b"".join(pieces) == data and len(pieces) > 20
    assert [w for p in pieces for w in re.findall(rb"[a-z]+", p)] == re.findall(rb"[a-z]+", data)
