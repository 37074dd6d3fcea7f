"""Personal data of which only a part is disguised."""

import pytest
from pyspark.sql import functions as F

from citegraph.llm import pii


def found(text):
    base, more = pii.personal_data(text)
    return [text[a:b] for a, _, b in base], [(pii.KINDS[k], text[a:b]) for a, k, b in more]


@pytest.mark.parametrize(
    "text, plain, whole",
    [
        ("ivаn.petrov@example.com", "n.petrov@example.com", "ivаn.petrov@example.com"),
        ("ivan@example.cоm", "ivan@example.c", "ivan@example.cоm"),
        ("ivan@mail.example (dot) com", "ivan@mail.example", "ivan@mail.example (dot) com"),
        ("iv.аn@mail.example (dot) com", "n@mail.example", "iv.аn@mail.example (dot) com"),
    ],
)
def test_an_address_disguised_in_one_part_is_found_whole(spark, text, plain, whole):
    assert found(f"to {text}, now") == ([plain], [("email", whole)])
    docs = pii.find_personal_data(spark.createDataFrame([(f"to {text}, now",)], "text string"))
    assert docs.select(pii.redacted(F.col("text"), F.col("pii"))).first()[0] == "to [email], now"


def test_a_disguised_span_beside_a_plain_one_of_another_kind_stays():
    assert found("10.0.0.1@hоst.example.com") == (["10.0.0.1"], [("email", "10.0.0.1@hоst.example.com")])


@pytest.mark.parametrize(
    "text, kind, whole",
    [
        ("call plus one 555 010 2020 now", "phone", "plus one 555 010 2020"),
        ("call plus one 5550102020 now", "phone", "plus one 5550102020"),
        ("call +44 20 7946 oh 95 eight now", "phone", "+44 20 7946 oh 95 eight"),
        ("call +44 20 7946 095 eight now", "phone", "+44 20 7946 095 eight"),
        ("card 4539 1488 0343 646 seven ok", "card", "4539 1488 0343 646 seven"),
    ],
)
def test_one_spelled_digit_is_enough(text, kind, whole):
    assert found(text)[1] == [(kind, whole)]


def test_a_word_behind_a_disguised_number_does_not_hide_it():
    assert ("card", "4539​1488 0343 6467") in found("card 4539​1488 0343 6467 one of mine")[1]


@pytest.mark.parametrize(
    "text", ["one 2020 report", "in 2020 one of 30 and 4 or five", "+1 or two, three", "page 12 two 13", "one, 2, three, 4 and 5"]
)
def test_prose_with_some_digits_is_left_alone(text):
    assert found(text) == ([], [])
