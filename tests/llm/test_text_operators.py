"""The operators that look at one text at a time, against plain restatements of their rules and against libraries."""

import itertools
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from citegraph.llm import languages, licenses, pieces, pii, tokens

TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
ODD = [
    "", " ", "\n", "  \n\n x  ", "a<|endoftext|>b <|endoftext|>  c", "日本語テキスト" * 50, "a" * 5000, "é́ ü ß ½ Ⅷ ٣",
    "😀😀 I'll don't", "tab\tand\x0bvt", "<0x41> ▁x ▁", "՘ 𐞻 newer", "0" * 300, "\x1c\x1d\x85\xa0x",
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def mixed(seed, alphabet, n, longest):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


# --- token counts -------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return tokens.TokenCounter(file.read())


def test_token_counts_equal_the_library(counter):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + ODD + mixed(1, "ab \n'sét1.é<|", 1500, 60)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == expected


def test_merging_follows_rank_then_place():
    merger = tokens.PairMerger([["a", "a"], ["aa", "b"], ["b", "b"]])
    assert merger.count("aaab") == 3  # (aa) a b: the left pair goes first, which leaves no "aa b"
    assert merger.count("aabb") == 2  # (aa b) b after the rank order
    assert merger.count("") == 0 and merger.count("b") == 1


def test_a_long_stretch_is_counted(counter):
    assert counter.count("x1é" * 100_000) > 100_000


# --- license scans ------------------------------------------------------------------------------------
def base_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places, labels = [], set()
    for phrase, name in licenses.PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(name)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.PHRASES, licenses.NOTICES, 0.12)


def test_phrases_are_counted_at_all_their_places(scanner):
    r = random.Random(4)
    made = [" ".join(r.choice(["CC", "by", "cc-by", "All", "rights", "reserved.", "É"]) for _ in range(30)) for _ in range(300)]
    for text in TEXTS + ODD + made + [None]:
        found = scanner.scan(text)
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == base_scan(text)
        assert set(found["base_labels"]) <= set(found["labels"]) and 0 <= found["score"] <= 1


def edit(r, text, errors):
    for _ in range(errors):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_every_notice_with_the_allowed_errors_is_found(scanner):
    r = random.Random(8)
    for number, (notice, name, k, pattern) in enumerate(scanner.finder.notices):
        for errors in range(k + 1):
            near = edit(r, notice, errors)
            text = f"word word {near} more words"
            # An edit beside a space may join or split words, which the verification sees the same way.
            joined = " ".join(text.split())
            if pattern.search(joined):
                assert any(h[2] == name for h in scanner.finder.find(joined)), (near, number)


def test_notice_spans_point_into_the_source(scanner):
    text = "Ünïted: Released under the   MIT-License! Foo"
    found = scanner.scan(text)["spans"]
    assert any(s["label"] == "mit" and text[s["start"] : s["end"]].endswith("MIT-License") for s in found)


def test_repeated_notices_stay_cheap(scanner):
    assert scanner.scan("permission is hereby granted " * 3000)["labels"] == []


# --- personal data ------------------------------------------------------------------------------------
# As the contract gives them (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                found.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    for text in TEXTS + ODD + mixed(3, "a1@.+- (9b2)0é", 8000, 80):
        assert pii.personal_data(text)[0] == base_spans(text)


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("jane at example dot org ok", "email", "jane at example dot org"),
        ("bob [at] host.com", "email", "bob [at] host.com"),
        ("j@ехample.com", "email", "j@ехample.com"),
        (" ivаn＠example．com", "email", "ivаn＠example．com"),
        ("call plus four nine one five five one two three four five six now", "phone", "plus four nine one five five one two three four five six"),
        ("card 4539​1488 0343 6467!", "card", "4539​1488 0343 6467"),
        ("at 10.O.0.1 ok", "ip", "10.O.0.1"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("tel +４９ (１５５) 5551234567", "phone", "+４９ (１５５) 5551234567"),
    ],
)
def test_disguises_are_mapped_back(text, kind, span):
    base, more = pii.personal_data(text)
    assert not base
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in more] == [(kind, span)]


@pytest.mark.parametrize(
    "text", ["look at example.com please", "meet at noon", "one two three four", "the dot at the end", "wir sind um acht da", "1l2 O"]
)
def test_prose_is_left_alone(text):
    assert pii.personal_data(text) == ([], [])


@pytest.mark.parametrize("unit", ["1", "a", "1.", "@", "+1", "a@", "one ", "a dot ", "a at ", "a."])
def test_personal_data_takes_linear_time(unit):
    pii.personal_data(unit * (200_000 // len(unit)))


def test_rewriting_maps_every_offset_back():
    step = pii.Rewritten("abcdef", [(1, 3, "X"), (4, 5, "")])
    assert step.text == "aXdf"
    assert [step.back(i, i + 1) for i in range(4)] == [(0, 1), (1, 3), (3, 4), (5, 6)]


# --- pieces -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    return pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_the_trie_holds_exactly_the_pieces(model):
    trie = model["trie"]

    def get(key):
        state = 0
        for byte in key:
            child = trie.base[state] + byte
            if trie.check[child] != state + 1:
                return None
            state = child
        return trie.value[state]

    spelled = set(model["byte_ids"])
    words = {w: i for i, w in enumerate(model["words"]) if w and i not in spelled}
    assert all(get(w) == i for w, i in words.items())
    assert all(get(w + b"\xff") is None for w in words)


def test_paths_are_the_best_and_decode_to_the_text(model):
    spelled = set(model["byte_ids"])
    words = {w.decode(): i for i, w in enumerate(model["words"]) if w and i not in spelled}
    longest = max(map(len, words))
    segmenter = pieces.Segmenter(model)

    def best(text):
        @lru_cache(None)
        def go(i):
            if i == len(text):
                return 0.0
            ends = range(i + 1, min(len(text), i + longest) + 1)
            options = [model["logs"][words[text[i:j]]] + go(j) for j in ends if text[i:j] in words]
            if text[i] not in words:
                options.append(len(text[i].encode()) * model["byte_log"] + go(i + 1))
            return max(options)

        return go(0)

    r = random.Random(2)
    parts = ["a", "the", " ", "  ", "é", "\n", "▁", "日", "in", "tion", "😀", "<0x41>"]
    for text in ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(400)]:
        ids, score, in_bytes = segmenter.encode(text)
        assert score == pytest.approx(best(" " + text)) and in_bytes == sum(i in spelled for i in ids.tolist())
        assert b"".join(model["words"][i] for i in ids).decode() == " " + text


# --- languages ----------------------------------------------------------------------------------------
def a_field(k=3):
    field = languages.Field([f"l{i}" for i in range(k)], {})
    rng = np.random.default_rng(3)
    field.moves, field.start = rng.normal(size=(k, k)), rng.normal(size=k)
    return field, rng


def test_posteriors_equal_the_sum_over_all_labellings():
    field, rng = a_field()
    emissions = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 5, 7, 0)]
    means, best = languages.label(field, emissions, labels=True)
    for e, mean, labels in zip(emissions, means, best):
        total, post = 0.0, np.zeros_like(e, dtype=float)
        for path in itertools.product(range(3), repeat=len(e)):
            weight = np.exp(
                sum(e[i, y] for i, y in enumerate(path))
                + (field.start[path[0]] if path else 0)
                + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
            )
            total += weight
            for i, y in enumerate(path):
                post[i, y] += weight
        if len(e):
            assert mean == pytest.approx((post / total).mean(axis=0), abs=1e-5)
            assert labels.tolist() == (post / total).argmax(axis=1).tolist()


def test_stretches_change_nothing():
    field, rng = a_field()
    e = rng.normal(size=(1000, 3)).astype(np.float32)
    long, _ = languages._posteriors(e[None].astype(float), field.moves, field.start)
    means, best = languages.label(field, [e[:10], e, e[:64], e[:65]], labels=True)
    assert means[1] == pytest.approx(long[0].mean(axis=0), abs=1e-5)
    assert (best[1] == long[0].argmax(axis=1)).mean() > 0.999
    assert means[3] == pytest.approx(languages._posteriors(e[None, :65].astype(float), field.moves, field.start)[0][0].mean(axis=0), abs=1e-5)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["Haus", "a", "ÉTÉ", "日本語", "haus", "x" * 300]
    slots, owner = languages.word_features(words)
    for i, word in enumerate(words):
        alone = languages.word_features([word])[0].tolist()
        assert slots[owner == i].tolist() == alone
        n = len(word)
        # 2-, 3- and 4-grams of the marked word, and the word itself.
        assert len(alone) == sum(max(0, n + 2 - size + 1) for size in (2, 3, 4)) + 1
    assert slots[owner == 0].tolist() == slots[owner == 4].tolist()


def test_switches_are_found():
    samples = [("x", "aba abba baab bab aab " * 30), ("y", "lol oll llo olo lool " * 30)]
    field = languages.fit(samples)
    words = "aba bab abba lol olo llo lool aab baab".split()
    labels = languages.label(field, [field.emissions(words)], labels=True)[1][0]
    assert [field.languages[i] for i in labels] == list("xxxyyyyxx")


def test_the_same_sample_gives_the_same_field():
    samples = [("x", "aba abba baab " * 9), ("y", "lol oll llo " * 9)]
    a, b = languages.fit(samples), languages.fit(samples[::-1])
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()
    assert Counter(a.lexicon) == Counter(b.lexicon)
