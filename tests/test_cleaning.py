"""Cleaning takes time in proportion to the text and computes each step once."""

import time

import pytest
from pyspark.sql import functions as F

from siftstone.operators import cleaning


def cleaned(spark, strategy, t):
    return cleaning.cleaned(spark.createDataFrame([(t,)], "text string"), strategy)


@pytest.mark.parametrize("strategy", ["deep", "medical_guideline_deep"])
def test_lines_are_judged_once(spark, strategy):
    plan = cleaned(spark, strategy, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Author/Task Force Member affiliations?") == 1


def test_long_blanks_and_many_repeated_lines(spark):
    began = time.time()
    assert cleaned(spark, "deep", f"Dose{' ' * 200_000}stays.{chr(0x2003) * 1000}").first().text == "Dose stays."
    lines = [f"Line {i % 20_000}" for i in range(60_000)] + ["Last twice", "last Twice", ""]
    got = spark.createDataFrame([(lines,)], "x array<string>").select(cleaning.unrepeated(F.col("x"), 80).alias("x")).first().x
    assert got == ["Last twice", "last Twice", ""]
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a \t\t b\t\tc", "a b c"),
        ("o\x00ne\r\ntwo\rthree", "one two three"),
        ("þ 5 – 7 • x￾", "+ 5 - 7 - x"),
        ("a-\nb-\nc þ-\nd é-\nö", "ab- c +- d éö"),
        ("　\x85one \nİdoi:x two", "one"),
        ("( a\n\n) , b ;c :d", "(a), b;c:d"),
        ("Long text that names HTTP://X.org/a and WWW.y.z and A.B@c.de " + "word " * 40 + ".", None),
    ],
)
def test_odd_texts(spark, text, want):
    got = cleaned(spark, "deep", text).first().text
    assert got == (want if want is not None else "")
